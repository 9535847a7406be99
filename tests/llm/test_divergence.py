import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tablewright.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(UP))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                found = found[:top] if part == "term" else found
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def told(docs, **more):
    return sorted(tuple(r) for r in divergence.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def rows_of(docs):
    return [(r.text, r.lang, r.source) for r in docs.collect()]


def test_documents_against_brute_force(documents):
    assert told(documents) == brute(rows_of(documents))
    assert told(documents.repartition(5), min_documents=2, top_terms=3) == brute(rows_of(documents), 2, 3)


def test_odd_rows(odd_docs):
    for least in (1, 2, 99):
        assert told(odd_docs, min_documents=least) == brute(rows_of(odd_docs), least)


def test_many_groups_and_blocks(spark, monkeypatch):
    """Several tiles and blocks, groups without terms, and a language without kept terms."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(75):
        for _ in range(3):
            size = 0 if g % 11 == 0 else int(rng.integers(1, 60))
            rows.append((" ".join(f"w{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26)}" for x in rng.zipf(1.4, size) % 600), "en", f"s{g:02d}é"))
    rows += [("ein wort", "de", "a"), ("zwei", "de", "b"), (None, "de", None), ("Seul ÉTÉ", "fr", "one")] + [("Same same", None, "x")] * 12
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 100)
    assert told(docs, min_documents=3) == brute(rows, 3)


def test_counts_sent_in_parts(spark, monkeypatch, documents):
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 10)
    found = divergence.term_counts(documents.unionAll(documents))
    counts, docs = Counter(), Counter()
    for text, lang, source in rows_of(documents) * 2:
        terms = TERM.findall((text or "").translate(UP))
        counts.update((lang or "", source or "", t) for t in terms)
        docs.update((lang or "", source or "", t) for t in set(terms))
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in found.collect() if r.term is not None}
    assert got == {k: (n, docs[k]) for k, n in counts.items()}


def test_words_across_slices(monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 7)
    text = "Abc dÉf, 12x  z中文q _a b " * 5
    assert [w.decode() for part in divergence.words(text.encode()) for w in part] == TERM.findall(text.translate(UP))


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9 * 10**17, 10**18, 12345), (0, 0, 1), (5, 9, 0)], "n long, total long, terms long")
    got = [r[0] for r in df.select(divergence.share(df.n, df.total, df.terms)).collect()]
    assert got == [1 + 10**9 * (9 * 10**17 + 2) // (10**18 + 2 * 12345), 1 + 10**9, None]


@pytest.mark.parametrize("rows, cols, filled, across", [(1, 1, 1, None), (7, 20, 0, None), (7, 20, 30, None), (32, 9, 60, None), (40, 50, 300, 32), (33, 700, 90, 32), (5, 8, 40, None)])
def test_joint_walk_gives_all_pairs(rows, cols, filled, across):
    rng = np.random.default_rng(rows * cols)
    cells = rng.choice(rows * cols, min(filled, rows * cols), replace=False)
    zero = rng.integers(1, 50, rows)
    matrix = np.repeat(zero[:, None], cols, axis=1)
    matrix[cells // cols, cells % cols] = rng.integers(50, 10**9, len(cells))
    bits = max(1, (max(rows, cols, 2) - 1).bit_length())
    tree = divergence.QuadTree(cells // cols, cells % cols, matrix[cells // cols, cells % cols], bits)
    found = divergence.pair_sums(tree, zero, cols, bits, across)
    for a, b in combinations(range(rows), 2):
        if across is None or a < across <= b:
            p, q = matrix[a], matrix[b]
            assert found[a, b] == ((p - q) ** 2 // (p + q)).sum()


def test_empty(documents):
    assert divergence.audit(documents.limit(0)).count() == 0
