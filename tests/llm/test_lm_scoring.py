import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import lm_scoring as lm
from tablewright.llm.common import CLEANUP_CONF

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def base(rows, learned):
    counts = Counter()
    for r in learned:
        counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    unit = math.log10(n + 0.5 * (v + 1)) if learned else math.log10(0.5)
    for r in rows:
        own = tokens(r.text)
        yield r.doc_id, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10(counts[t] + 0.5) - unit for t in own)


@pytest.mark.parametrize("frequent", [50, 1 << 20])
def test_base_score_is_exact(spark, documents, frequent):
    rows = documents.collect()
    train = documents.filter(lm.doc_bucket("doc_id", 5) != 1)
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    found = {r.doc_id: r for r in lm.score(documents, lm.fit(train, parts=16), frequent=frequent).collect()}
    for i, n, known, total, score in base(rows, learned):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - score) < 1e-6


def test_filter_keeps_every_level():
    keys = lm.mix(np.arange(1, 5000, dtype=np.uint64))
    counts = np.arange(1, 5000) % 700 + 1
    level = lm.levels(counts)
    assert level[0] == 2 and lm.levels(np.array([1, 2, 3, 4, 1023, 1024])).tolist() == [1, 2, 2, 3, 10, 11]
    bloom = lm.LogFrequencyFilter(lm.fill_block(keys, level).reshape(1, -1))
    assert (bloom.counts(keys) >= lm.LEVEL_COUNT[level]).all()
    assert (bloom.counts(keys) == lm.LEVEL_COUNT[level]).mean() > 0.9
    assert (bloom.counts(lm.mix(np.arange(10_000, 20_000, dtype=np.uint64))) == 0).mean() > 0.9


def test_scores_against_exact_counts(spark, documents):
    """With a roomy filter the score is that of the quantised exact counts, but for rare false probes."""
    train = documents.filter(lm.doc_bucket("doc_id", 5) != 1)
    model = lm.fit(train, parts=16)
    words, pairs = Counter(), Counter()
    learned = [r.text for r in train.collect()]
    for t in learned:
        own = tokens(t)
        words.update(own)
        pairs.update(zip(["<s>", *own[:-1]], own, strict=True))
    n, v = sum(words.values()), len(words)
    stands = lambda c: lm.LEVEL_COUNT[c.bit_length()]
    assert model.least_pair >= 2
    near = 0
    found = {r.doc_id: r.score for r in lm.score(documents, model).collect()}
    for r in documents.collect():
        own, total = tokens(r.text), 0.0
        for before, t in zip(["<s>", *own[:-1]], own, strict=True):
            p = (stands(words[t]) + 0.5) / (n + 0.5 * (v + 1))
            context = len(learned) if before == "<s>" else stands(words[before])
            c = pairs[(before, t)]
            pair = stands(c) if c >= model.least_pair else 0
            total += math.log10(lm.PAIR_WEIGHT * min(pair / context, 1) + (1 - lm.PAIR_WEIGHT) * p if context else p)
        near += abs(found[r.doc_id] - total) < 0.02 * abs(total) + 0.5
    assert near > 0.95 * len(found)


def test_pairs_that_do_not_fit_back_off(spark, documents):
    level = lm.F.floor(lm.F.log2("n")) + 1
    words = lm.count_ngrams(documents, "text", False, 1, 16)
    room = (words.agg(lm.F.sum(level)).first()[0] + 50) * lm.BITS_PER_ENTRY  # for 50 levels of pairs
    pairs = lm.count_ngrams(documents, "text", True, lm.MIN_PAIR_COUNT, 16)
    bloom, least = lm.build_filter(words, pairs, room)
    assert least > 2 and bloom.blocks == 1
    assert pairs.filter(lm.F.col("n") >= least).agg(lm.F.sum(level)).first()[0] <= 50
    small = lm.fit(documents, max_bits=lm.BLOCK_BITS, parts=16)
    assert small.filter.blocks == 1
    assert all(r.score < 0 for r in lm.score(documents, small).collect())


def test_odd_rows(odd_docs):
    rows = odd_docs.collect()
    learned = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    found = lm.score_documents(odd_docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found.collect())
    assert got == sorted((str(i), n, k, t, round(s, 5)) for i, n, k, t, s in base(rows, learned))
    nothing = lm.score(odd_docs, lm.fit(odd_docs.limit(0))).collect()
    assert len(nothing) == len(rows) and {r.score for r in nothing} == {None} and {r.train_tokens for r in nothing} == {0}
    assert lm.score_documents(odd_docs.limit(0)).count() == 0


def test_whole_filter_holds_pairs_seen_once(spark, documents, monkeypatch):
    """All pairs count at any size: the filter grows with its entries, over several slices, and is asked slice by slice."""
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 400)  # so that a small table needs many blocks
    monkeypatch.setattr(lm, "MAX_BITS", lm.BLOCK_BITS)
    train = documents.filter(lm.doc_bucket("doc_id", 5) != 1)
    model = lm.fit_whole(train, parts=16)
    level = lm.F.floor(lm.F.log2("n")) + 1
    entries = sum(lm.count_ngrams(train, "text", p, 1, 16).agg(lm.F.sum(level)).first()[0] for p in (False, True))
    assert model.least_pair == 1 and model.filter.slices == 16 and model.filter.blocks * lm.BLOCK_BITS >= lm.BITS_PER_ENTRY * entries > lm.MAX_BITS
    words, pairs = Counter(), Counter()
    learned = [r.text for r in train.collect()]
    for t in learned:
        own = tokens(t)
        words.update(own)
        pairs.update(zip(["<s>", *own[:-1]], own, strict=True))
    n, v = sum(words.values()), len(words)
    stands = lambda c: lm.LEVEL_COUNT[c.bit_length()]
    near = 0
    found = {r.doc_id: r.score for r in lm.score(documents, model).collect()}
    for r in documents.collect():
        own, total = tokens(r.text), 0.0
        for before, t in zip(["<s>", *own[:-1]], own, strict=True):
            p = (stands(words[t]) + 0.5) / (n + 0.5 * (v + 1))
            context = len(learned) if before == "<s>" else stands(words[before])
            share = min(stands(pairs[(before, t)]) / context, 1) if context else 0
            total += math.log10(lm.PAIR_WEIGHT * share + (1 - lm.PAIR_WEIGHT) * p if context else p)
        near += abs(found[r.doc_id] - total) < 0.02 * abs(total) + 0.5
    assert near > 0.95 * len(found)


def test_query_learns_from_pairs_seen_once(spark):
    """A pair seen once in training makes a text more likely than one of the same words in an order not seen."""
    once = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:3]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(once[0], "red fox runs"), (once[1], "blue whale sings"), (once[2], "old owl sleeps"), (held[0], "red fox"), (held[1], "red whale")]
    found = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[held[0]] > found[held[1]] + 0.3


SORTED_KEYS = [[], [0], [2**64 - 1], [5] * 9, [0, 2**64 - 1], [0] * 50 + [2**64 - 1], [0, 0, 7, 2**63, 2**63, 2**64 - 1]]


@pytest.mark.parametrize("keys", SORTED_KEYS + [sorted(int(k) for k in np.random.default_rng(bits).integers(0, 2**bits, 999)) for bits in (1, 8, 13, 44, 63)])
def test_close_blocks_lose_nothing(keys):
    keys = np.array(keys, np.uint64)
    counts = np.array([1, 1, 2, 255, 256, 1, 2**32 - 1], np.uint32)[np.arange(len(keys)) % 7]
    body = pa.py_buffer(lm.packed.pack_close([keys, counts]))
    found = lm.packed.unpack_close([len(keys)], [body], lm.KINDS)
    assert [x.dtype for x in found] == lm.KINDS
    assert np.array_equal(found[0], keys) and np.array_equal(found[1], counts)


@pytest.mark.parametrize("kinds", [1, 3, 255, 256, 70_000])
def test_packed_texts_lose_nothing(kinds):
    tokens = lm.mix(np.r_[np.arange(kinds), np.arange(kinds // 2), [7, 7], kinds + np.arange(5)].astype(np.uint64))
    offsets = np.array([0, 1, 3, len(tokens)])
    found = lm._unpack_texts(pa.py_buffer(lm._pack_texts(tokens, offsets)))
    assert np.array_equal(found[0], tokens) and np.array_equal(found[1], offsets)


def test_shuffled_counts_and_texts_are_small():
    """Pairs, nearly all seen once, take half of 12 bytes each; tokens of the usual spread of words a byte and a half, beside 8 for each word."""
    rng = np.random.default_rng(3)
    words = np.char.mod("%d", rng.integers(0, 30_000, 300_000))
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(words)], pa.large_string())], ["text"])
    sent = list(lm._count_pieces(1024, True)(iter([texts])))
    assert sum(x.column(2).nbytes for x in sent) < 6.7 * sum(x.column(1).to_numpy().sum() for x in sent)
    tokens = lm.mix(np.minimum(rng.zipf(1.2, 300_000), 1 << 20).astype(np.uint64))
    kinds = len(np.unique(tokens))
    assert len(lm._pack_texts(tokens, np.array([0, len(tokens)]))) < 1.5 * len(tokens) + 8 * kinds


def test_training_leaves_no_shuffle_files(spark, documents, monkeypatch):
    """Each table that training writes is written with Spark's clean-up on; the session's settings are as before afterwards."""
    seen, written = [], lm.stored

    def noted(df, label):
        seen.append((label, spark.conf.get(CLEANUP_CONF)))
        return written(df, label)

    before = spark.conf.getAll
    monkeypatch.setattr(lm, "stored", noted)
    lm.fit_whole(documents, parts=16)
    assert seen == [("lm-counts", "true"), ("lm-filter", "true")] and spark.conf.getAll == before
    spark.conf.set(CLEANUP_CONF, "false")
    try:
        lm.fit_whole(documents.limit(5), parts=4)
        assert seen[2:] == [("lm-counts", "false"), ("lm-filter", "false")] and spark.conf.get(CLEANUP_CONF) == "false"
    finally:
        spark.conf.unset(CLEANUP_CONF)
