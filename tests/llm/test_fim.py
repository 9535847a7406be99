import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import fim
from tablewright.llm.common import byte_view

WIDE = ["", "plain", "ß", "aß中\U0001f600b", "中" * 50, "x" * 300 + "é", "\U0001f600" * 7 + "end", "é" + "y" * 99]


def brute(doc_id, text, seed=1, plain=10, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def index_of(texts):
    return fim.ExceptionIndex(*byte_view(pa.array(texts, pa.large_string())))


def test_index_converts_every_position():
    index = index_of(WIDE)
    assert index.lengths().tolist() == [len(x) for x in WIDE]
    for row, text in enumerate(WIDE):
        chars = np.arange(len(text) + 1)
        rows = np.full(len(chars), row)
        at = index.to_bytes(rows, chars)
        assert at.tolist() == [len(text[:c].encode()) for c in chars]
        assert index.to_chars(rows, at).tolist() == chars.tolist()
        inside = np.arange(len(text.encode()) + 1)
        starts = at.tolist()
        want = [next(c for c, s in enumerate(starts) if s >= b) for b in inside]
        assert index.to_chars(np.full(len(inside), row), inside).tolist() == want


def test_index_holds_exceptions_only():
    assert len(index_of(["only ascii " * 100] * 9).at_byte) == 0
    assert index_of(WIDE).at_byte.shape[0] == sum(len(c.encode()) > 1 for t in WIDE for c in t)


def same(docs):
    want = sorted((repr((r.doc_id, *brute(r.doc_id, r.text))) for r in docs.collect()))
    told = fim.restore(fim.transform(docs))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in told.collect()) == want
    texts = sorted(repr((r.doc_id, r.text or "")) for r in docs.collect())
    assert sorted(repr((r.doc_id, r.restored)) for r in told.collect()) == texts
    assert told.filter("NOT restored_prefix <=> prefix_chars").count() == 0


def test_documents_against_brute_force(documents):
    same(documents)


def test_odd_rows(odd_docs):
    same(odd_docs)


def test_marks_and_near_marks(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["<", ">", "<P", "<S", "<M", "S>", "M>", "é", "a", "中"], k=rng.randint(1, 9))) for _ in range(1500)]
    same(spark.createDataFrame(list(enumerate([*texts, "a<P>b", "<M>"])), "doc_id long, text string"))


@pytest.mark.parametrize("plain, spm", [(0, 0), (0, 100), (100, 50)])
def test_shares(spark, plain, spm):
    docs = spark.createDataFrame([(i, f"text é {i}") for i in range(50)], "doc_id long, text string")
    found = {r.doc_id: tuple(r[1:]) for r in fim.transform(docs, seed=7, plain_percent=plain, spm_percent=spm).collect()}
    assert found == {i: brute(i, f"text é {i}", 7, plain, spm) for i in range(50)}


def test_empty_and_text_ids(spark, documents):
    assert fim.round_trip_digests(documents.limit(0)).count() == 0
    docs = spark.createDataFrame([("a", "one two"), (None, "three"), ("", "three")], "key string, body string")
    found = fim.transform(docs, "key", "body").collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(repr((k, *brute(k, t))) for k, t in (("a", "one two"), (None, "three"), ("", "three")))


def test_digests(documents):
    for r in fim.round_trip_digests(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        *head, output = brute(r.doc_id, r.text)
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == head
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
