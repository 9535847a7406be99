import hashlib
from collections import defaultdict

from tablewright.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text):
    return (text or "").translate(LOWER)


def test_groups(spark, odd_docs):
    found = exact_duplicates(odd_docs)
    assert "source" in found.columns and len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    groups = defaultdict(list)
    for r in odd_docs.select("doc_id", "text").collect():
        groups[plain(r.text)].append(r.doc_id)
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = groups[plain(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_drop(odd_docs):
    kept = drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len({plain(r.text) for r in rows}) == len({plain(r.text) for r in odd_docs.collect()})
    assert {r.doc_id for r in rows if r.text and plain(r.text).startswith("alpha")} == {2}
    assert drop_exact_duplicates(odd_docs.limit(0)).count() == 0


def test_same_length_and_prefix_but_other_end(spark):
    head = "x" * 2000
    df = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + "A")], "doc_id long, text string")
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(df).collect()}
    assert found == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_digest(spark, documents):
    from tablewright.llm.exact_dedup import full_hash

    for r in documents.select("text", full_hash("text").alias("h")).limit(20).collect():
        assert r.h == hashlib.sha256(plain(r.text).encode()).hexdigest()
