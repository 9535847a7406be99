import itertools
import random
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from tablewright.llm import packing
from tablewright.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.DEFAULT_FILE)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def unpacked(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_words_as_the_library_cuts_them(library):
    words = packing.words_of(packing.DEFAULT_FILE)
    rng = random.Random(5)
    letters = "abcdefgzABZ0189'.,-!<|>_éüßñÄÿ×÷µ" + "́ÅΣςİ中\U0001f600\x85\xa0 \r\x1c"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(6000)]
    texts += ["it's we'LL 'S I'd", "<|endoftext|>", "a<|startoftext|>b", "x" * 5000, " ́x", "a \n\t b", "12 345 é1", "ΑΣ Σ"]
    texts += [" ".join(rng.sample(texts, 8)) for _ in range(300)]
    for text in texts:
        assert unpacked(words.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_text_in_slices(library):
    text = "many words, and more " * 110_000
    assert unpacked(packing.words_of(packing.DEFAULT_FILE).encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    words = packing.WordIds(packing.DEFAULT_FILE)
    text = " ".join(f"word{i % 13}" for i in range(100))
    assert unpacked(words.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert len(words) <= 5


def test_closest_fill_is_closest():
    rng = random.Random(2)
    for _ in range(400):
        items = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 120)
        counts = {n: items.count(n) for n in items}
        best, taken = packing.closest_fill(sorted(counts), counts, room)
        sums = {sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
        assert best == max(s for s in sums if s <= room) == sum(n * k for n, k in taken.items())
        assert all(0 < k <= counts[n] for n, k in taken.items())


def check_windows(lengths, capacity, pool_tokens):
    docs = [(i, struct.pack(f"<{n}I", *range(n))) for i, n in enumerate(lengths)]
    found = list(packing.windows(iter(docs), capacity, pool_tokens))
    sizes = [sum(p.tokens for p in w) for w in found]
    short = [s for s in sizes if s != capacity]
    assert all(s & (s - 1) == 0 for s in short) and short == sorted(set(short), reverse=True)
    parts = sorted((p.key, p.start, unpacked(p.ids)) for w in found for p in w)
    for key, group in itertools.groupby(parts, key=lambda p: p[0]):
        ids = [x for _, start, piece in group for x in (piece if piece[0] == start else [-1])]
        assert ids == list(range(lengths[key]))
    assert {p[0] for p in parts} == set(range(len(lengths)))
    return found


@pytest.mark.parametrize(
    "lengths",
    [[1], [64], [63], [200] * 3, [48] * 500, [1] * 1000, [64 * 5 + 1] * 40, list(range(1, 200)), [33] * 99 + [31] * 7],
    ids=["one", "full", "below", "long", "alike", "tiny", "just_over", "mixed", "two"],
)
def test_windows_are_full_and_whole(lengths):
    for pool in (1, 300, 1 << 20):
        check_windows(lengths, 64, pool)


def test_fits_are_found_without_cutting():
    found = check_windows([40, 24] * 50 + [10, 54], 64, 1 << 20)
    assert all(p.start == 0 and p.tokens in (40, 24, 10, 54) for w in found for p in w)


def test_random_lengths():
    rng = random.Random(9)
    for _ in range(20):
        check_windows([rng.choice([rng.randint(1, 20), rng.randint(1, 400)]) for _ in range(rng.randint(1, 400))], 128, rng.choice([200, 5000]))


def check_packed(rows, docs, library):
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.length > 0
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for group in by_sequence.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [0, *itertools.accumulate(r.length for r in group)][:-1]
        size = sum(r.length for r in group)
        assert size == 4096 or (size < 4096 and size & (size - 1) == 0)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert set(texts) == set(by_doc)
    for doc_id, bodies in texts.items():
        want = sorted(i for t in bodies for i in enumerate(ids_of(library, t)))
        got = sorted((r.start + k, i) for r in by_doc[doc_id] for k, i in enumerate(unpacked(r.ids)))
        assert got == want
        assert {r.doc_tokens for r in by_doc[doc_id]} == {len(ids_of(library, t)) for t in bodies}


def test_documents(documents, library):
    check_packed(packing.pack(documents.repartition(3)).collect(), documents, library)


def test_odd_rows(odd_docs, library):
    check_packed(packing.pack(odd_docs).collect(), odd_docs, library)


def test_empty(documents):
    packed = packing.pack(documents.limit(0))
    assert packed.count() == 0 and packing.sequences(packed).count() == 0


def test_sequences_are_padded_to_capacity(documents):
    packed = packing.pack(documents)
    found = {r.sequence_id: r for r in packing.sequences(packed, pad_id=7).collect()}
    rows = sorted(packed.collect(), key=lambda r: (r.sequence_id, r.offset))
    for sequence, group in itertools.groupby(rows, key=lambda r: r.sequence_id):
        assert bytes(found[sequence].ids) == b"".join(bytes(r.ids) for r in group)
    three = packed.sparkSession.createDataFrame([(1, 2, struct.pack("<I", 9), 1), (1, 0, struct.pack("<2I", 4, 5), 2)], "sequence_id long, offset long, ids binary, length long")
    (r,) = packing.sequences(three, 8, 7).collect()
    assert unpacked(r.ids) == [4, 5, 9, 7, 7, 7, 7, 7] and r.n_tokens == 3


def test_query_digests(spark, documents, library):
    ids = {r.doc_id: ids_of(library, r.text) for r in documents.collect()}
    for r in LLM_QUERIES["op13_slack_packing"].run(spark, SF).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r.doc_tokens == len(ids[r.doc_id])
