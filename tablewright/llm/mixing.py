"""Mixing documents to target token weights by soft domain membership. DataFrame operations only.

A naive Bayes classifier is fitted on labelled documents and gives every document a posterior over the domains ``good``,
``low`` and ``toxic``. Its features are the share of distinct words and the numbers of indicator words of each domain;
indicators are the words whose odds differ most between labelled domains.

Rates r >= 0 per document are then fitted so that the expected tokens per domain, T_j = sum r n p_j, match the targets
t_j = weight_j x budget: projected gradient descent on f = sum_j (T_j - t_j)^2 / S_j, with S_j the tokens of domain j at rate 1.
Every round each document takes a step r - p.h and is projected to r >= 0. In the norm weighted by tokens the gradient of a rate is
p.g with g_j = 2 (T_j - t_j) / S_j, and h = g / 2 is a step that always descends; longer ones, and h scaled by the inverse second
moments of the documents that are free to move, are tried along with it, all in one aggregate, and the best is taken. Where targets
cannot be reached (a positive lower bound proves it), the optimum lies on few kinds of documents and steps grow slow; a round then also tries to shrink all rates by
one factor and to raise those of the posteriors with the steepest gradients so far, by least squares over these few. A round of two
aggregates gives f and a lower bound of its minimum by duality; the fit ends when they agree to ``GAP`` of f, or f is below
``TOLERANCE`` of the targets. Only documents with the same posteriors share a rate, so the rounds run over a table of different
posteriors with their tokens. A few sums per domain reach the driver.

Rates become whole copies by a hash of id and text: floor(rate), and one more for a share of the documents that is its fraction.

Bounds: about ``LABELLED_DOCS`` labelled documents are used for fitting (chosen by a hash of the id, all if fewer), and
``INDICATORS`` words per domain. Everything else covers all rows.

Rules: null text counts as empty (0 tokens; posterior from the priors). Labels with a null id, quality or toxic flag are not
used; of repeated labels of an id the largest values count. Repeated documents get the same rate. Without any label every
domain is equally likely. A domain without tokens cannot be matched and is left out of the fit. Targets that no rates reach are
met as nearly as f can be, however few documents that leaves. A budget of 0 gives rates of 0. Names starting with
``__mix`` are reserved; other columns, of any name, are kept by ``mix``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import ascii_lower, stored

DOMAINS = ("good", "low", "toxic")
#: Shares of tokens wanted from each domain.
TARGETS = {"good": 0.92, "low": 0.07, "toxic": 0.01}
LABELLED_DOCS = 20_000
INDICATORS = 40
LEAST_SUPPORT = 5
#: Least log odds of an indicator word.
LEAST_ODDS = 1.5
#: The fit ends when f is this near to its lower bound (as a share of f) ...
GAP = 1e-5
#: ... or every domain this near to its target (as a share of the domain's tokens).
TOLERANCE = 1e-6
#: Rounds after which rates are written, so that later rounds start from there.
WRITTEN_EVERY = 8
#: Lengths of steps that are tried together.
SCALED_STEPS, PLAIN_STEPS = (4.0, 1.0, 0.25, 1 / 16), (1.0, 16.0, 256.0, 4096.0)
#: Posteriors whose rates a corrective step may raise, and the round from which on it is tried in any case.
STEEPEST, SLOW = 12, 40
_FEATURES = ("__mix_x0", *(f"__mix_hits_{d}" for d in DOMAINS))
_PS = tuple(f"__mix_p_{d}" for d in DOMAINS)
TOKENS, RATE, CHANCE = "__mix_tokens", "__mix_rate", "__mix_chance"


def words_of(text: str) -> Column:
    """Words ``[^ \\t-\\r]+`` of the text, A-Z lower-cased; no empty ones."""
    return F.filter(F.split(ascii_lower(text), r"[\x09-\x0d ]+"), lambda w: w != "")


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").otherwise("low")


@dataclass
class Classifier:
    """Indicator words per domain; prior, means and variances of the features per domain."""

    indicators: dict[str, list[str]]
    priors: dict[str, float] = field(default_factory=dict)
    means: dict[str, list[float]] = field(default_factory=dict)
    spreads: dict[str, list[float]] = field(default_factory=dict)

    def features(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with the number of words and the features."""
        rows = docs.withColumn("__mix_words", words_of(text)).withColumn("__mix_kinds", F.array_distinct("__mix_words"))
        hits = {
            f"__mix_hits_{d}": F.log1p(F.size(F.array_intersect("__mix_kinds", F.array(*(F.lit(w) for w in self.indicators[d])).cast("array<string>"))))
            for d in DOMAINS
        }
        distinct = F.size("__mix_kinds") / F.greatest(F.size("__mix_words"), F.lit(1))
        return rows.withColumns({TOKENS: F.size("__mix_words").cast("long"), "__mix_x0": distinct, **hits}).drop("__mix_words", "__mix_kinds")

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """``rows`` with one posterior per domain, in steps of a millionth."""
        logs = {}
        for d in DOMAINS:
            parts = [F.lit(math.log(self.priors[d]))]
            for x, m, v in zip(_FEATURES, self.means[d], self.spreads[d], strict=True):
                parts.append(-F.lit(0.5 * math.log(2 * math.pi * v)) - (F.col(x) - F.lit(m)) * (F.col(x) - F.lit(m)) * F.lit(0.5 / v))
            logs[f"__mix_l_{d}"] = sum(parts[1:], parts[0])
        rows = rows.withColumns(logs)
        best = F.greatest(*logs)
        rows = rows.withColumns({p: F.exp(F.col(name) - best) for p, name in zip(_PS, logs, strict=True)}).drop(*logs)
        total = sum((F.col(p) for p in _PS[1:]), F.col(_PS[0]))
        return rows.withColumns({p: F.round(F.col(p) / total, 6) for p in _PS}).drop(*_FEATURES)


def _labelled(labels: DataFrame, id_col: str, bound: int) -> DataFrame:
    """__mix_id and domain of the labelled ids that are used."""
    rows = labels.select(F.col(id_col).alias("__mix_id"), F.col("quality").alias("q"), F.col("toxic").alias("t"))
    rows = rows.filter("__mix_id IS NOT NULL AND q IS NOT NULL AND t IS NOT NULL").groupBy("__mix_id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    found = rows.count()
    if found > bound:
        rows = rows.filter(F.pmod(F.xxhash64("__mix_id"), F.lit(1_000_000)) < int(1_000_000 * bound / found))
    return rows.select("__mix_id", domain_of(F.col("q"), F.col("t")).alias("domain"))


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", bound: int = LABELLED_DOCS) -> Classifier:
    """Indicator words, then means and variances per domain, from the labelled documents."""
    sample = stored(_labelled(labels, id_col, bound), "mix-labels")  # about ``bound`` rows of two small columns
    plain = docs.select(F.col(id_col).alias("__mix_id"), F.col(text).alias("text"))
    rows = stored(plain.join(F.broadcast(sample), "__mix_id"), "mix-labelled")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    kinds = rows.select("domain", F.explode(F.array_distinct(words_of("text"))).alias("word"))
    counts = kinds.groupBy("word").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS))
    indicators: dict[str, list[str]] = {}
    for d in DOMAINS:
        inside, outside = sizes.get(d, 0), total - sizes.get(d, 0)
        rest = sum((F.col(o) for o in DOMAINS if o != d), F.lit(0)).cast("double")
        gain = F.log((F.col(d) + 0.5) / (inside + 1.0)) - F.log((rest + 0.5) / (outside + 1.0))
        # odds, weighed by how often they decide something
        top = counts.filter((F.col(d) >= LEAST_SUPPORT) & (gain >= LEAST_ODDS)).select("word", (gain * F.sqrt(F.col(d))).alias("gain"))
        indicators[d] = [r["word"] for r in top.orderBy(F.desc("gain"), "word").limit(INDICATORS).collect()]
    model = Classifier(indicators)
    shown = model.features(rows, "text").groupBy("domain").agg(*(f(x).alias(f"{n}{i}") for i, x in enumerate(_FEATURES) for n, f in (("m", F.avg), ("v", F.var_pop))))
    by = {r["domain"]: r for r in shown.collect()}
    for d in DOMAINS:
        r = by.get(d)
        model.priors[d] = (sizes.get(d, 0) + 1) / (total + len(DOMAINS))
        model.means[d] = [r[f"m{i}"] if r else 0.0 for i in range(len(_FEATURES))]
        model.spreads[d] = [max(r[f"v{i}"] if r else 1.0, 1e-2) for i in range(len(_FEATURES))]
    if not total:
        model.means = {d: [0.0] * len(_FEATURES) for d in DOMAINS}
    return model


@dataclass(frozen=True)
class Step:
    """r becomes max(0, keep r - p.h + lift [p = at])."""

    h: tuple[float, ...] = (0.0, 0.0, 0.0)
    keep: float = 1.0
    lift: float = 0.0
    at: tuple[float, ...] = (-1.0, -1.0, -1.0)

    def column(self, rate: Column) -> Column:
        moved = F.lit(self.keep) * rate - sum((F.col(p) * F.lit(float(x)) for p, x in zip(_PS, self.h, strict=True)), F.lit(0.0))
        if self.lift:
            same = [F.col(p) == F.lit(float(x)) for p, x in zip(_PS, self.at, strict=True)]
            moved = moved + F.when(same[0] & same[1] & same[2], F.lit(self.lift)).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0.0), moved)


def rate_column(steps: Sequence[Step], start: Column | None = None) -> Column:
    """The rate of a document after all steps, one after the other."""
    start = F.lit(1.0) if start is None else start
    if len(steps) <= 2:
        for step in steps:
            start = step.column(start)
        return start
    told = F.array(*(F.struct(*(F.lit(float(x)).alias(n) for n, x in zip("abcklxyz", (*s.h, s.keep, s.lift, *s.at), strict=True))) for s in steps))
    g, w, t = (F.col(p) for p in _PS)

    def one(r: Column, s: Column) -> Column:
        lift = F.when((g == s["x"]) & (w == s["y"]) & (t == s["z"]), s["l"]).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0.0), s["k"] * r - (g * s["a"] + w * s["b"] + t * s["c"]) + lift)

    return F.aggregate(told, start, one)


@dataclass
class Fit:
    """The steps, tokens wanted and tokens reached per domain, f with a lower bound of its minimum, and the number of rounds."""

    steps: list[Step]
    wanted: list[float]
    reached: list[float]
    off: float
    bound: float
    rounds: int


def _least_squares(columns: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Nonnegative least squares over a handful of columns, by active sets."""
    x, free = np.zeros(columns.shape[1]), np.zeros(columns.shape[1], bool)
    for _ in range(20 * len(x)):
        slope = columns.T @ (wanted - columns @ x)
        slope[free] = -np.inf
        if free.all() or slope.max() <= 1e-12 * np.linalg.norm(columns) * np.linalg.norm(wanted):
            break
        free[np.argmax(slope)] = True
        while True:
            best = np.zeros(len(x))
            best[free] = np.linalg.lstsq(columns[:, free], wanted, rcond=None)[0]
            out = free & (best <= 0)
            if not out.any():
                break
            x = x + (x[out] / np.maximum(x[out] - best[out], 1e-300)).min() * (best - x)
            free &= x > 1e-15
        x = best
    return x


def fit_rates(rows: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None) -> Fit:
    """Fit the rates of ``rows``, which hold tokens and posteriors.

    ``budget`` is the number of tokens wanted in all; by default as many as there are.
    """
    kinds = rows.groupBy(*_PS).agg(F.sum(TOKENS).cast("double").alias(TOKENS)).filter(F.col(TOKENS) > 0)
    table = stored(kinds.withColumn(RATE, F.lit(1.0)), "mix-posteriors")
    domains = range(len(DOMAINS))
    pairs = [(j, k) for j in domains for k in domains if j <= k]
    # whole millionths of tokens, so that sums do not depend on the order of the rows
    whole = lambda x: F.sum(F.round(x * F.col(TOKENS) * 1_000_000).cast("decimal(38,0)"))

    def told(row, name: str) -> np.ndarray:
        return np.array([float(row[f"{name}{j}"] or 0) / 1e6 for j in domains])

    held = told(table.agg(*(whole(F.col(p)).alias(f"t{j}") for j, p in enumerate(_PS))).first(), "t")
    there = held > 0
    share = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    wanted = share * (held.sum() if budget is None else budget)
    scale = np.where(there, 1.0 / np.maximum(held, 1e-12), 0.0)
    off = lambda t: float(((t - wanted) ** 2 * scale).sum())

    steps: list[Step] = []
    reached, written, done, bound = held, 0, 0, 0.0
    steepest: dict[tuple, np.ndarray] = {}
    while there.any() and np.abs((reached - wanted) * scale).max() > TOLERANCE:
        if len(steps) - written >= WRITTEN_EVERY:
            table = stored(table.withColumn(RATE, rate_column(steps[written:], F.col(RATE))), "mix-posteriors")
            written = len(steps)
        now = table.withColumn(RATE, rate_column(steps[written:], F.col(RATE)))
        gap = np.where(there, reached - wanted, 0.0)
        g = 2 * gap * scale
        slope = sum((F.col(p) * F.lit(float(x)) for p, x in zip(_PS, g, strict=True)), F.lit(0.0))
        free = F.when((F.col(RATE) > 0) | (slope < 0), 1.0).otherwise(0.0)
        moments = [whole(free * F.col(_PS[j]) * F.col(_PS[k])).alias(f"m{j}_{k}") for j, k in pairs]
        row = now.agg(*moments, F.min(F.struct(slope.alias("slope"), *_PS, TOKENS)).alias("least")).first()
        least = row["least"]
        # duality: g lifted until no slope is negative bounds the minimum from below (posteriors sum to 1)
        lifted = np.where(there, g - min(least["slope"], 0.0), 0.0)
        bound = max(bound, float(-(lifted**2 * held / 4).sum() - (lifted * wanted).sum()))
        if off(reached) - bound <= GAP * off(reached):
            break
        second = np.zeros((len(DOMAINS), len(DOMAINS)))
        for j, k in pairs:
            second[j, k] = second[k, j] = float(row[f"m{j}_{k}"] or 0) / 1e6
        scaled = np.linalg.lstsq(second + 1e-12 * np.diag(held + 1e-9), gap, rcond=None)[0]
        moves = [[Step(tuple(float(x) for x in scaled * size))] for size in SCALED_STEPS]
        moves += [[Step(tuple(float(x) for x in gap * scale * size))] for size in PLAIN_STEPS]
        steepest[tuple(least[p] for p in _PS)] = np.array([least[p] for p in _PS]) * least[TOKENS]
        steepest = dict(list(steepest.items())[-STEEPEST:])
        if bound > 0 or done >= SLOW:  # out of reach, or all but: plain steps would crawl
            weight = np.sqrt(scale)
            found = _least_squares(np.stack([reached, *steepest.values()], axis=1) * weight[:, None], wanted * weight)
            moves.append([Step(keep=float(found[0])), *(Step(lift=float(x), at=at) for at, x in zip(steepest, found[1:], strict=True) if x > 0)])
        rates = [rate_column(move, F.col(RATE)) for move in moves]
        row = now.agg(*(whole(rate * F.col(p)).alias(f"r{i}_{j}") for i, rate in enumerate(rates) for j, p in enumerate(_PS))).first()
        ends = [told(row, f"r{i}_") for i in range(len(moves))]
        best = min(range(len(moves)), key=lambda i: off(ends[i]))
        done += 1
        if off(ends[best]) >= off(reached) * (1 - 1e-12):
            break
        steps += moves[best]
        reached = ends[best]
    return Fit(steps, wanted.tolist(), reached.tolist(), off(reached), bound, done)


def chance_of(id_col: str, text: str = "text") -> Column:
    """A draw between 0 and 1; different texts draw apart even if they share an id or have none."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text)]
    return F.pmod(F.xxhash64(*own, F.lit("copies")), F.lit(1_000_000)) / 1e6


def whole_copies(rate: Column, chance: Column) -> Column:
    """Whole copies whose expected number is the rate."""
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def copies_of(rate: Column, id_col: str, text: str = "text") -> Column:
    return whole_copies(rate, chance_of(id_col, text))


def rated(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    targets: Mapping[str, float] = TARGETS,
    budget: float | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with tokens, posteriors (``__mix_p_*``), rate (``__mix_rate``) and draw (``__mix_chance``).

    Written once, so that texts are gone through once for the fit and for the result.
    """
    model = fit_classifier(docs, labels, id_col, text)
    rows = model.posteriors(model.features(docs, text)).withColumn(CHANCE, chance_of(id_col, text))
    rows = stored(rows if keep_text else rows.drop(text), "mix-rows")
    return rows.withColumn(RATE, rate_column(fit_rates(rows, targets, budget).steps))


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", targets: Mapping[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """Every document as often as its copies say, with the columns of ``docs``."""
    rows = rated(docs, labels, id_col, text, targets, budget)
    times = F.array_repeat(F.lit(0), whole_copies(F.col(RATE), F.col(CHANCE)))
    return rows.withColumn("__mix_copy", F.explode(times)).select(*docs.columns)


def mixing_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, the posteriors, the rate and the copies of every document."""
    rows = rated(docs.select("doc_id", "text"), labels, keep_text=False)
    named = [F.col(p).alias(p.removeprefix("__mix_")) for p in _PS]
    copies = whole_copies(F.col(RATE), F.col(CHANCE)).alias("copies")
    return rows.select("doc_id", F.col(TOKENS).alias("n_tokens"), *named, F.round(RATE, 6).alias("rate"), copies)
