"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from fixed patterns with checks (``base_spans``). The field looks for what the patterns miss, such as
written-out addresses and numbers with other separators. It reads the surroundings of digits, at-signs and written-out
"at" and "dot", and written-out addresses in full; candidate segments there are scored as wholes (digit groups, checksum, separators, brackets, neighbours, cue
words), and dynamic programming over segments (numbers of at most ``MAX_TOKENS`` tokens) picks boundaries and types together, with a
weight for each pair of neighbouring types. Base spans stay; a segment that touches one is no candidate. A segment is added
if it beats leaving its tokens out by ``MARGIN`` (log odds).

Training maximises the conditional likelihood on two bounded sets. The first are ``EXAMPLES`` texts made by rule: variants that
the patterns miss, after cue words or alone, and things that look like them but are no personal data, prose around host names
included. The second are at most ``TRAINING_WINDOWS`` surroundings of at most ``LONGEST_WINDOW`` characters, from about
``SAMPLE_DOCS`` documents chosen by a hash of their id. Base spans are true there; what the patterns leave out is not taken for
false: a candidate that may well be personal data (``_uncertain``) is left out of the training window, neither right nor wrong.

Offsets are code points, end exclusive. Rules: null text counts as empty; rows are treated one by one, so repeated rows,
ties and null ids need no rule; extra columns are not read. Work is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import byte_view, pieces, text_column

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 3000
TRAINING_WINDOWS = 2000
EXAMPLES = 2400
MAX_TOKENS = 26
AROUND = 40
LONGEST_WINDOW = 400
MARGIN = 2.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    found, floor = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            floor = m.end()
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, m.start(), m.end()))
    return found


# --- candidate segments ------------------------------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]+|[\[({] ?at ?[\])}]| dot ", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
_AT = r"(?: ?@ ?| ?[\[({] ?at ?[\])}] ?| at )"
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )"
_WRITTEN = re.compile(
    rf"[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.IGNORECASE
)
#: What follows the local part of an address; every match of ``_WRITTEN`` has one of these in it.
_AFTER_LOCAL = re.compile(rf"{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.IGNORECASE)
_AT_MARK = re.compile(r"@| ?[\[({] ?at ?[\])}]| at(?= )", re.IGNORECASE)
_DOT_WORD = re.compile(r" dot |[\[({] ?dot ?[\])}]", re.IGNORECASE)
_LONGEST_LOCAL = 64
#: Words that announce a kind, the more usual top-level domains, and words that stand before "at" in prose.
_CUES = {
    "mail": 0, "email": 0, "contact": 0, "write": 0, "ip": 1, "address": 1, "server": 1, "host": 1, "card": 2, "visa": 2,
    "mastercard": 2, "account": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3, "dial": 3, "ring": 3, "telephone": 3,
}
_TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app de uk fr es it nl eu ch at us ca au jp cn in br ru example".split())
_BEFORE_AT = frozenset(
    "us me him her them you it page pages site look looked looking met meet arrive arrived arrives stay stayed live lives work works "
    "worked is was are were be been here there available visit found hosted located stop stopped start started online store docs".split()
)
_CUE_REACH = 3
_SEPARATORS = frozenset(" -./()_")


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of whatever may be a written-out address: both parts in full, as long as the pattern allows."""
    for m in _AT_MARK.finditer(text):
        at = m.start() - 1 if m[0] == "@" and text[m.start() - 1 : m.start()] == " " else m.start()
        tail = _AFTER_LOCAL.match(text, at)
        if tail is None:
            continue
        start = at
        while start > max(0, at - _LONGEST_LOCAL) and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, tail.end()


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers and over written-out addresses, joined where they meet."""
    near = [(max(0, m.start() - AROUND), min(m.end() + AROUND, len(text))) for m in _TRIGGER.finditer(text)]
    start = end = None
    for a, b in sorted([*near, *_addresses(text)]):
        if end is not None and a <= end:
            end = max(end, b)
            continue
        if end is not None:
            yield start, end
        start, end = a, b
    if end is not None:
        yield start, end


@dataclass
class Segment:
    """Tokens [first, last) as one entity of a kind, with the features of the whole span."""

    first: int
    last: int
    kind: int
    features: list[str] = field(default_factory=list)
    score: float = 0.0


def _side(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else "mark"


def _features(kind: int, span: str, left: str, right: str) -> list[str]:
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    between = "".join(sorted({c for c in span if not c.isalnum()}))
    told = ["bias", f"left={_side(left[-1:])}", f"right={_side(right[:1])}", f"marks={between[:6]}"]
    cue = next((_CUES[w] for w in re.findall(r"[a-z]+", left.lower())[: -_CUE_REACH - 1 : -1] if w in _CUES), None)
    cue = "own" if cue == kind else "other" if cue is not None else "none"
    told.append(f"cue={cue}")
    if kind == 0:
        tail = re.split(r"\W+", span.strip())[-1]
        at = "sign" if "@" in span else "word" if " at " in span.lower() else "bracket"
        dot = "word" if _DOT_WORD.search(span) else "sign"
        local = re.split(r"[ @\[({]", span, maxsplit=1)[0].lower()
        told += [f"at={at}", f"tail={min(len(tail), 5)}", f"alpha={tail.isalpha()}", f"top={tail.lower() in _TOP_DOMAINS}"]
        told += [f"spaces={min(span.count(' '), 5)}", f"dot={dot}", f"shape={at}/{dot}", f"told={at}/{dot}/{tail.lower() in _TOP_DOMAINS}/{local in _BEFORE_AT}"]
    else:
        form = re.sub(r"[0-9]+", "#", span)
        told += [f"digits={len(digits)}", f"groups={'-'.join(str(len(g)) for g in groups[:6])}", f"plus={span[0] == '+'}", f"zeros={digits[:2] == '00'}"]
        told += [f"round={span.count('(') == span.count(')')}", f"open={span[0] == '('}", f"form={cue}/{form}", f"sizes={form}/{len(digits)}"]
        if kind == 1:
            told += [f"small={all(map(_small, groups))}", f"dots={span.count('.')}"]
        if kind == 2:
            told.append(f"luhn={luhn(digits)}")
            told.append(f"even={len({len(g) for g in groups[:-1]}) <= 1}")
    return [f"{kind}:{t}" for t in told]


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _touches(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    before = bisect_left(taken[0], b) - 1  # the last taken span that starts before the end
    return before >= 0 and taken[1][before] > a


def lattice(
    text: str, start: int, end: int, taken: tuple[list[int], list[int]] = ((), ()), model: SemiMarkov | None = None
) -> tuple[list[int], list[Segment]]:
    """Token borders of a window and its candidate segments, none of which touches a ``taken`` span.

    With ``model`` segments are scored at once; those that by themselves do not beat other text by the margin are left out.
    """
    borders = [start + m.start() for m in _TOKEN.finditer(text[start:end])] + [end]
    at = {b: i for i, b in enumerate(borders)}
    found: dict[tuple[int, int, int], Segment] = {}

    def add(kind: int, a: int, b: int) -> None:
        if a not in at or b not in at or (kind and at[b] - at[a] > MAX_TOKENS):  # addresses are bounded by their pattern
            return
        if _touches(taken, a, b):
            return
        told = _features(kind, text[a:b], text[max(0, a - 24) : a], text[b : b + 1])
        if model is None:
            found.setdefault((kind, a, b), Segment(at[a], at[b], kind, told))
        elif (score := sum(model.weights.get(f, 0.0) for f in told)) + model.moves[_OUT][kind] + model.moves[kind][_OUT] >= MARGIN:
            found.setdefault((kind, a, b), Segment(at[a], at[b], kind, score=score))

    for m in _WRITTEN.finditer(text, start, end):
        add(0, m.start(), m.end())
    for i in range(len(borders) - 1):
        first = text[borders[i]]
        if not (first in "0123456789" or (first in "+(" and i + 1 < len(borders) - 1 and text[borders[i + 1]] in "0123456789(")):
            continue
        digits = groups = gap = 0
        for j in range(i, min(i + MAX_TOKENS, len(borders) - 1)):
            token = text[borders[j] : borders[j + 1]]
            if token[0] in "0123456789":
                digits, groups, gap = digits + len(token), groups + 1, 0
                if digits > 19:
                    break
                if 13 <= digits:
                    add(2, borders[i], borders[j + 1])
                if 7 <= digits <= 15 and groups <= 6:
                    add(3, borders[i], borders[j + 1])
                if groups == 4 and digits <= 12 and first.isdigit():
                    add(1, borders[i], borders[j + 1])
            elif token in _SEPARATORS or (token == "+" and j == i):
                gap += 1
                if gap > 3:
                    break
            else:
                break
    return borders, sorted(found.values(), key=lambda s: (s.last, s.first, s.kind))


# --- the field -----------------------------------------------------------------------------------------------------------

_OUT = len(KINDS)
_LABELS = len(KINDS) + 1


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


class SemiMarkov:
    """Weights of whole-span features and of pairs of neighbouring types; tokens outside of entities, and pairs of them, score 0."""

    def __init__(self):
        self.weights: dict[str, float] = defaultdict(float)
        self.moves = [[0.0] * _LABELS for _ in range(_LABELS)]

    def _edges(self, n: int, segments: list[Segment]) -> list[list[tuple[int, int, float, Segment | None]]]:
        """For each end: (start, type, score, segment)."""
        ends: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            ends[i + 1].append((i, _OUT, 0.0, None))
        for s in segments:
            ends[s.last].append((s.first, s.kind, sum(self.weights.get(f, 0.0) for f in s.features), s))
        return ends

    def best(self, n: int, segments: list[Segment]) -> list[Segment]:
        """The segments of the best segmentation; ``segments`` are scored and beat leaving their tokens out by the margin."""
        if not segments:
            return []
        by_end: dict[int, list[int]] = defaultdict(list)
        for k, s in enumerate(segments):
            by_end[s.last].append(k)
        # one row of types per token border, in flat arrays: a window may be long
        score = array("d", [-math.inf]) * ((n + 1) * _LABELS)
        came = array("l", [-1]) * ((n + 1) * _LABELS)  # segment * types + type before
        score[_OUT] = 0.0

        def arrive(i: int, j: int, y: int, own: float, k: int) -> None:
            for before in range(_LABELS):
                s = score[i * _LABELS + before] + self.moves[before][y] + own
                if s > score[j * _LABELS + y]:
                    score[j * _LABELS + y], came[j * _LABELS + y] = s, k * _LABELS + before

        for j in range(1, n + 1):
            arrive(j - 1, j, _OUT, 0.0, len(segments))
            for k in by_end.get(j, ()):
                arrive(segments[k].first, j, segments[k].kind, segments[k].score, k)
        found, j, y = [], n, max(range(_LABELS), key=lambda t: score[n * _LABELS + t])
        while j > 0:
            k, y = divmod(came[j * _LABELS + y], _LABELS)
            if k < len(segments):
                found.append(segments[k])
                j = segments[k].first
            else:
                j -= 1
        return found[::-1]

    def gradient(self, n: int, segments: list[Segment], truth: set[tuple[int, int, int]]) -> tuple[dict[str, float], list[list[float]]]:
        """Observed minus expected counts of features and moves on one window."""
        ends = self._edges(n, segments)
        inside = [[-math.inf] * _LABELS for _ in range(n + 1)]
        inside[0][_OUT] = 0.0
        for j in range(1, n + 1):
            arrived: list[list[float]] = [[] for _ in range(_LABELS)]
            for i, y, own, _ in ends[j]:
                arrived[y].append(own + _log_sum([inside[i][b] + self.moves[b][y] for b in range(_LABELS)]))
            inside[j] = [_log_sum(a) if a else -math.inf for a in arrived]
        after = [[-math.inf] * _LABELS for _ in range(n + 1)]
        after[n] = [0.0] * _LABELS
        total = _log_sum(inside[n])
        features: dict[str, float] = defaultdict(float)
        moves = [[0.0] * _LABELS for _ in range(_LABELS)]
        for j in range(n, 0, -1):
            for i, y, own, segment in ends[j]:
                for b in range(_LABELS):
                    rest = self.moves[b][y] + own + after[j][y]
                    after[i][b] = _log_sum([after[i][b], rest])
                    p = math.exp(min(0.0, inside[i][b] + rest - total))
                    moves[b][y] -= p
                    if segment is not None:
                        for f in segment.features:
                            features[f] -= p
        place, before = 0, _OUT
        by_start = {s.first: s for s in segments if (s.kind, s.first, s.last) in truth}
        while place < n:
            s = by_start.get(place)
            y = _OUT if s is None else s.kind
            moves[before][y] += 1
            if s is not None:
                for f in s.features:
                    features[f] += 1
            place, before = (place + 1, y) if s is None else (s.last, y)
        return features, moves

    def train(self, windows: list[tuple[int, list[Segment], set]], rounds: int = 10, rate: float = 0.5, decay: float = 1e-4) -> SemiMarkov:
        """Adaptive gradient steps, one window at a time, in a fixed order."""
        seen: dict[str, float] = defaultdict(lambda: 1e-6)
        seen_moves = [[1e-6] * _LABELS for _ in range(_LABELS)]
        order = random.Random(7)
        for _ in range(rounds):
            order.shuffle(windows)
            for n, segments, truth in windows:
                features, moves = self.gradient(n, segments, truth)
                for f, g in features.items():
                    g -= decay * self.weights[f]
                    seen[f] += g * g
                    self.weights[f] += rate * g / math.sqrt(seen[f])
                for b in range(_LABELS):
                    for y in range(_LABELS):
                        if b == y == _OUT:  # the level all else is measured from, whatever the number of tokens
                            continue
                        g = moves[b][y] - decay * self.moves[b][y]
                        seen_moves[b][y] += g * g
                        self.moves[b][y] += rate * g / math.sqrt(seen_moves[b][y])
        self.weights = dict(self.weights)
        return self


def _uncertain(segment: Segment) -> bool:
    """May a candidate be personal data, though no pattern matches it?"""
    has = {f.partition(":")[2] for f in segment.features}
    kind = segment.kind
    return kind == 0 or "cue=own" in has or (kind == 1 and "small=True" in has) or (kind == 2 and "luhn=True" in has) or (
        kind == 3 and bool(has & {"plus=True", "zeros=True", "open=True"})
    )


def _window(text: str, start: int, end: int, truth: list[tuple[int, int, int]], partial: bool = False) -> tuple[int, list[Segment], set] | None:
    """A training window; true spans must be candidates, others that touch them are wrong.

    With ``partial`` the truth may lack spans: uncertain candidates away from true spans are left out.
    """
    borders, segments = lattice(text, start, end)
    if partial:
        told = _merged([(a, b) for _, a, b in truth])
        segments = [s for s in segments if _touches(told, borders[s.first], borders[s.last]) or not _uncertain(s)]
    at = {b: i for i, b in enumerate(borders)}
    known = {(s.kind, s.first, s.last) for s in segments}
    true, upto = set(), 0
    for kind, a, b in sorted(truth, key=lambda x: (x[1], -x[2])):
        key = (kind, at.get(a), at.get(b))
        if key in known and key[1] >= upto:
            true.add(key)
            upto = key[2]
    return (len(borders) - 1, segments, true) if segments else None


def examples(n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts made by rule with one number or address each: (text, true spans)."""
    r = random.Random(11)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))

    def card() -> str:
        body = number(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def fours(x: str, mark: str) -> str:
        return mark.join(x[i : i + 4] for i in range(0, 16, 4))

    def host() -> str:
        return r.choice(["", "www.", "docs.", f"{word()}."]) + word()

    def top() -> str:
        return r.choice(["com", "org", "net", "edu", "de", "io", "example"])

    def address() -> str:
        at, dot = r.choice(
            [("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("@", " dot "), ("(at)", "."), (" [at] ", "."), (" at ", " (dot) ")]
        )
        return f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{r.choice(['', word() + dot])}{word()}{dot}{top()}"

    def told_phone() -> str:
        """Shapes that are numbers of any sort unless a cue word says otherwise."""
        a, b, c = number(3), number(3), number(4)
        mark = r.choice(["-", " ", ".", "/"])
        return r.choice([f"{a}{mark}{b}{mark}{c}", f"0{a}{mark}{number(7)}", f"{a}{b}{c}", f"0{number(2)}{mark}{number(3)}{mark}{number(4)}", f"0{number(4)}{mark}{number(6)}"])

    def plain_phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"001 {a} {b} {c}", f"001-{a}-{b}-{c}", f"+{number(2)} {a} {b}{c}", f"+1 {a}/{b}-{c}", f"({a}) {b} {c}", f"(0{number(2)}) {number(7)}"])

    def no_card() -> str:
        bad = number(15)
        bad += next(x for x in "0123456789" if not luhn(bad + x))
        return r.choice([fours(bad, r.choice([" ", "-", ""])), bad[:14], bad + number(4)])

    def prose() -> str:
        before = r.choice([word(), r.choice(sorted(_BEFORE_AT))])
        known = r.choice(sorted(_BEFORE_AT))
        return r.choice(
            [
                f"{before} at {host()}.{top()}", f"{before} at {word()}.{word().title()}", f"{known} at {host()} dot {top()}",
                f"{before} at {word()} dot {r.choice(['one', 'two', 'three', 'four', 'five', word() + 'ing'])}",
                f"{before} at {word()} {number(2)}.", f"{before} @ {number(3)} {word()}", f"{word()} dot {word()} {number(4)}",
                f"{before} at {word()}. {word()} {number(1)}",
            ]
        )

    def digits() -> str:
        return r.choice(
            [
                number(40), f"{number(6)}.{number(2)}", f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}:{number(2)}",
                f"{number(2)}.{number(2)}.20{number(2)}", f"{number(1)}.{number(1)}.{number(1)}", f"{number(3)} {number(4)} {number(2)}",
                f"9{number(2)}.{number(3)}.{number(3)}.{number(3)}", f"{number(9)}", f"{number(5)}-{number(4)}", f"({number(4)}) {number(4)}-{number(4)}",
            ]
        )

    def cue(*kinds: int) -> str:
        """A cue word of one of the kinds, and at most two words between it and what it announces."""
        words = r.choice([c for c, k in _CUES.items() if k in kinds])
        return r.choice([words, words.title()]) + r.choice(["", "", " " + r.choice(["me", "us", "is", "at", "on", "to", "number"]), f" {word()} {r.choice(['at', 'on', 'is'])}"])

    ip = lambda: r.choice([".", " . ", "."]).join(str(r.randint(0, 255)) for _ in range(4))
    made = [
        (0, address, "any"), (1, ip, "any"), (2, lambda: fours(card(), r.choice([" ", "-", ".", "/", ""])), "any"), (3, plain_phone, "any"),
        (3, told_phone, "own"), (3, told_phone, "own"), (None, told_phone, "not"), (None, told_phone, "not"), (None, no_card, "any"), (None, digits, "none"),
        (None, digits, "none"), (None, prose, "none"), (None, prose, "none"), (None, lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), "none"),
    ]

    found = []
    for i in range(n):
        kind, make, led = made[i % len(made)]
        span = make()
        lead = " ".join(word() for _ in range(r.randint(1, 4)))
        own = KINDS.index("phone") if kind is None else kind
        if led == "own" or (led == "any" and r.random() < 0.4):
            lead += " " + (cue(own) if make is not no_card else cue(2))
        elif led == "not" and r.random() < 0.3:
            lead += " " + cue(*(k for k in range(len(KINDS)) if k != own))
        lead += r.choice([" ", " ", ": ", "\n"] if led == "own" else [" ", ". ", ": ", " | ", "\n"])
        text = lead + span + r.choice([" ", ", ", " | ", "\n", ". "]) + word()
        found.append((text, [] if kind is None else [(kind, len(lead), len(lead) + len(span))]))
    return found


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> SemiMarkov:
    """Train on windows of a bounded sample of ``docs`` and on examples made by rule."""
    rows = docs.count()
    share = 1_000_000 if rows <= sample_docs else int(1_000_000 * sample_docs / rows)
    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    picked = picked.filter((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share) & F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [x[a:b] for x in text_column(batch, "text").to_pylist() for a, b in windows(x) if b - a <= LONGEST_WINDOW]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["near"])

    near = picked.select("text").mapInArrow(cut, "near string").distinct().orderBy(F.xxhash64("near"), "near")
    near = [r["near"] for r in near.limit(TRAINING_WINDOWS).collect()]
    made = [_window(t, 0, len(t), base_spans(t), partial=True) for t in near] + [_window(t, 0, len(t), s) for t, s in examples(EXAMPLES)]
    return SemiMarkov().train([w for w in made if w])


def added_spans(model: SemiMarkov, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field beside the base spans."""
    found = []
    taken = _merged([(s, e) for _, s, e in base])
    for start, end in windows(text):
        borders, segments = lattice(text, start, end, taken, model)
        if segments:
            found += [(s.kind, borders[s.first], borders[s.last]) for s in model.best(len(borders) - 1, segments)]
    return found


def told(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, by kind, then start."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_MAY_HOLD = np.zeros(256, bool)
_MAY_HOLD[[*range(0x30, 0x3A), 0x40]] = True
_WORDED = re.compile(rb"[\[({] ?at ?[\])}]| dot | at (?=[A-Za-z0-9-]{1,63}(?:\.| ?[\[({] ?dot))", re.IGNORECASE)


def _with_triggers(column: pa.Array) -> np.ndarray:
    """Rows that hold a digit, an at-sign or a written-out one."""
    data, offsets = byte_view(column)
    marks = np.flatnonzero(_MAY_HOLD[data])
    if len(data):
        marks = np.r_[marks, np.array([m.start() for m in _WORDED.finditer(data.tobytes())], np.int64)]
    return np.unique(np.searchsorted(offsets, marks, side="right") - 1)


def find(docs: DataFrame, model: SemiMarkov, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base and added spans of every row (arrays of kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            column = text_column(batch, "text")
            base: list[list] = [[] for _ in range(len(column))]
            added: list[list] = [[] for _ in range(len(column))]
            for row in _with_triggers(column).tolist():
                x = column[row].as_py()
                base[row] = base_spans(x)
                added[row] = added_spans(shared.value, x, base[row])
            out = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(r)] for r in side] for side in (base, added)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(span)) for c in out)], ["id", "base", "added"])

    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = "array<struct<kind:string,start:long,end:long>>"
    return plain.mapInArrow(run, f"id {id_type}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def _of_kind(spans: str | Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _listed(spans: Column) -> Column:
    """The spans as kind:start:end, by kind in the fixed order, then start."""
    of_kind = [_of_kind(spans, k) for k in KINDS]
    ordered = F.concat(*(F.sort_array(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))) for a in of_kind))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, counts of base spans per kind, the digest of the base spans, and all spans as text."""
    found = find(docs, fit(docs, id_col, text), id_col, text)
    counts = {f"n_{k}": F.size(_of_kind("base", k)).cast("long") for k in KINDS}
    digest = F.sha2(_listed(F.col("base")), 256)
    return found.withColumns({**counts, "base_sha256": digest, "spans": _listed(F.concat("base", "added"))}).drop("base", "added")


def digest_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(told(spans).encode()).hexdigest()
