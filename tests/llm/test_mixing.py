from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing


def brute_rates(tokens, p, wanted, rounds=200_000):
    """Plain projected gradient, one step at a time."""
    held = (tokens[:, None] * p).sum(axis=0)
    r = np.ones(len(tokens))
    for _ in range(rounds):
        gap = ((r * tokens)[:, None] * p).sum(axis=0) - wanted
        if np.abs(gap / held).max() < 1e-9:
            break
        r = np.maximum(0.0, r - p @ (gap / held))
    return r


def table(spark, tokens, p):
    return spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p, strict=True)], ", ".join([f"{mixing.TOKENS} long", *(f"{c} double" for c in mixing._PS)]))


def test_rates_reach_the_targets_with_clipping(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.dirichlet([0.4, 0.3, 0.2], size=400), 6)
    tokens = rng.integers(1, 500, size=400)
    rows = table(spark, tokens, p)
    targets = {"good": 0.90, "low": 0.08, "toxic": 0.02}
    fit = mixing.fit_rates(rows, targets)
    assert np.allclose(fit.reached, fit.wanted, rtol=1e-4)
    rates = np.array([r[0] for r in rows.select(mixing.rate_column(fit.steps)).collect()])
    assert (rates >= 0).all() and (rates == 0).any()
    mass = ((rates * tokens)[:, None] * p).sum(axis=0)
    assert np.allclose(mass, np.array([0.90, 0.08, 0.02]) * mass.sum(), rtol=1e-3)
    slow = brute_rates(tokens, p, np.array(fit.wanted))
    assert np.allclose(((slow * tokens)[:, None] * p).sum(axis=0), fit.wanted, rtol=1e-4)


def test_budget_and_unreachable_targets(spark):
    p = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
    fit = mixing.fit_rates(table(spark, [100, 300], p), {"good": 0.5, "low": 0.4, "toxic": 0.1}, budget=1000)
    assert np.allclose(fit.reached[:2], [500, 400], rtol=1e-5) and fit.reached[2] == 0  # no toxic tokens to be had
    same = np.array([[0.5, 0.5, 0.0]] * 3)
    fit = mixing.fit_rates(table(spark, [10, 20, 30], same), {"good": 0.9, "low": 0.1, "toxic": 0.0})
    assert np.allclose(fit.reached, [30, 30, 0], rtol=1e-4)  # the nearest point of the only ray there is
    assert fit.off == pytest.approx(2 * 24**2 / 30, rel=1e-4)
    none = mixing.fit_rates(table(spark, [10, 20], same[:2]), budget=0)
    assert np.allclose(none.reached, 0, atol=1e-4)


def least(tokens, p, wanted):
    """The minimum of the objective, by trying every face of the cone of documents (three documents at most)."""
    held = (tokens[:, None] * p).sum(axis=0)
    scale = np.where(held > 0, 1 / np.maximum(held, 1e-12), 0)
    columns, goal = (tokens[:, None] * p * np.sqrt(scale)).T, wanted * np.sqrt(scale)
    best = (goal**2).sum()
    for size in (1, 2, 3):
        sets = np.array(list(combinations(range(len(tokens)), size)))
        a = columns.T[sets].transpose(0, 2, 1)
        x = (np.linalg.pinv(a) @ goal[:, None])[:, :, 0]
        ok = (x >= -1e-9).all(axis=1)
        best = min(best, (((a @ x[:, :, None])[:, :, 0] - goal)[ok] ** 2).sum(axis=1).min(initial=best))
    return best


@pytest.mark.parametrize(
    "seed, many, spread, targets",
    [
        (1, 60, [3, 2, 1], (0.98, 0.01, 0.01)),
        (2, 60, [3, 2, 1], (0.2, 0.1, 0.7)),
        (3, 80, [1, 1, 1], (0.98, 0.01, 0.01)),
        (4, 50, [9, 6, 3], (0.05, 0.9, 0.05)),
        (5, 40, [0.4, 0.3, 0.2], (0.92, 0.07, 0.01)),
        (6, 30, [20, 1, 1], (0.0, 0.5, 0.5)),
    ],
)
def test_unreachable_targets_are_met_as_nearly_as_possible(spark, seed, many, spread, targets):
    rng = np.random.default_rng(seed)
    p, tokens = np.round(rng.dirichlet(spread, size=many), 6), rng.integers(1, 500, many).astype(float)
    rows = table(spark, tokens, p)
    fit = mixing.fit_rates(rows, dict(zip(mixing.DOMAINS, targets, strict=True)))
    minimum = least(tokens, p, np.array(fit.wanted))
    assert minimum * (1 - 1e-9) - 1e-6 <= fit.off <= minimum * (1 + 1e-4) + 1e-5 * tokens.sum()
    rates = np.array([r[0] for r in rows.select(mixing.rate_column(fit.steps)).collect()])
    assert (rates >= 0).all() and np.allclose(((rates * tokens)[:, None] * p).sum(axis=0), fit.reached, rtol=1e-5, atol=1e-3)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mixing_table(docs, labels)
    assert rows.count() == docs.count()
    text = rows.join(docs, "doc_id").select("n_tokens", "text").collect()
    assert all(r.n_tokens == len([w for w in __import__("re").split(r"[\x09-\x0d ]+", r.text) if w]) for r in text)
    named = rows.join(labels, "doc_id").withColumn("domain", mixing.domain_of(F.col("quality"), F.col("toxic")))
    means = {r["domain"]: r for r in named.groupBy("domain").agg(*(F.avg(f"p_{d}").alias(d) for d in mixing.DOMAINS), F.avg("rate").alias("rate")).collect()}
    for d in mixing.DOMAINS:
        assert means[d][d] == max(means[d][x] for x in mixing.DOMAINS)
    assert means["toxic"]["rate"] < 0.6 < 0.9 < means["good"]["rate"]
    total = rows.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS)).first()
    share = np.array([total[d] for d in mixing.DOMAINS]) / sum(total)
    assert np.allclose(share, [mixing.TARGETS[d] for d in mixing.DOMAINS], rtol=1e-3)
    copies = rows.agg(F.sum("copies"), F.sum("rate"), F.min(F.col("copies") - F.floor("rate")), F.max(F.col("copies") - F.ceil("rate"))).first()
    assert abs(copies[0] - copies[1]) < 0.05 * copies[1] and copies[2] >= 0 and copies[3] <= 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, None, 0), (None, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    for marked in (labels, labels.limit(0)):
        mixed = mixing.mix(odd_docs, marked, budget=1e6)
        assert mixed.columns == odd_docs.columns and mixed.count() >= 0
        assert mixing.mixing_table(odd_docs, marked).count() == odd_docs.count()
    assert mixing.mix(odd_docs.limit(0), labels).count() == 0
    rows = mixing.rated(odd_docs, labels)
    times = rows.select("doc_id", mixing.copies_of(F.col(mixing.RATE), "doc_id").alias("c")).filter("doc_id = 5").collect()
    assert len(times) == 2 and times[0].c == times[1].c


def test_texts_of_one_id_draw_apart(spark):
    rows = spark.createDataFrame([(i, f"text {k}", 0.5) for i in (None, 4) for k in range(400)], "doc_id long, text string, rate double")
    found = rows.withColumn("c", mixing.copies_of(F.col("rate"), "doc_id")).groupBy("doc_id").agg(F.sum("c").alias("c")).collect()
    assert len(found) == 2 and all(140 < r.c < 260 for r in found)
