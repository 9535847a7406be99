"""Language-model scores from a log-frequency Bloom filter.

Training counts every word and every word pair of the training documents exactly. Counts are quantised on a logarithmic
scale: an n-gram with count c has level 1 + floor(log2 c), and is put into a Bloom filter once for each level up to its own.
A count is read back by probing level 1, 2, ... until a probe fails. The filter is built in blocks of 64 KB, each by the
task that holds the n-grams of its hash range. Probabilities interpolate the pair's relative frequency with the smoothed
word frequency, both from probes alone.

The query fits with ``fit_whole``: every word and every pair is entered, pairs seen once included, and the filter has at least
``BITS_PER_ENTRY`` bits per entry at any size. It is cut into at most ``packed.PARTS`` slices of the hash range and stays
distributed: texts ask each slice for their distinct n-grams, the levels found go back to the texts. Only what a task holds is
bounded (one slice, or one piece of text), and all shuffled data grows in line with the texts. Keys travel as gaps, levels and
places of tokens compressed, and shuffle files of the training go when the filter is written.

``fit`` makes one filter of at most ``max_bits`` bits that is broadcast, for callers who want that bound: words are all entered,
pairs from ``MIN_PAIR_COUNT`` on; if they do not fit, the smallest larger count that fits is taken, from the exact histogram of
counts, and rarer pairs back off to words.

The base score is exact: the counts of the ``FREQUENT`` most frequent words are broadcast (16 MB at most), those of all
others are joined by shuffle.

Tokens: words ``[^ \\t-\\r]+`` with A-Z lower-cased, then one end token. Rules: null text counts as empty and has only the end
token. Rows with a null id are scored but neither learned from nor held out. Repeated rows count and are scored each. With
no training rows N and V are 0 and scores follow from the formula as far as it is defined (null otherwise).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.keep import stored_while
from tablewright.llm import packed
from tablewright.llm.common import doc_bucket, pieces, release, shuffles_removed, stored, text_column
from tablewright.llm.textops import mix, word_hashes

BLOCK_BITS = 1 << 19
BITS_PER_ENTRY = 10
MAX_BITS = 1 << 29
PROBES = 4
MIN_PAIR_COUNT = 2
#: Blocks of a slice, while there are fewer slices than ``packed.PARTS``.
SLICE_BLOCKS = 2
#: Keys probed at once.
PROBED_KEYS = 1 << 19
#: Bytes of text that ask the slices together.
ASKING_TEXT = 8 << 20
#: Low bits of a key that a sliced filter does not use: 44 bits tell n-grams apart far better than the probes do.
SHORT = np.uint64(20)
FREQUENT = 1 << 20
PAIR_WEIGHT = 0.6
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0xD1342543DE82EF95)
_LEVEL = 0x9E3779B97F4A7C15
KINDS = [np.dtype(np.uint64), np.dtype(np.uint32)]
LEVEL_KINDS = [np.dtype(np.uint64), np.dtype(np.uint8)]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts with an end token after each, and the offsets of each text's tokens."""
    words, offsets = word_hashes(texts)
    stops = offsets[1:] + np.arange(len(offsets) - 1)
    tokens = np.empty(len(words) + len(stops), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[stops] = True
    tokens[~is_end] = words
    tokens[is_end] = END
    return tokens, offsets + np.arange(len(offsets))


def histories(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each token; a begin mark before the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = BEGIN
    return before


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + tokens)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


#: What a level stands for: the middle of its range of counts.
LEVEL_COUNT = np.array([0.0] + [(2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, 64)])


class LogFrequencyFilter:
    """Blocks of bits; all probes of one entry fall into the block of its n-gram.

    A slice of a larger filter holds its blocks from ``first`` on, out of ``blocks`` in all.
    """

    def __init__(self, bits: np.ndarray, blocks: int | None = None, first: int = 0):
        self.bits = bits  # blocks x bytes
        self.blocks = blocks or len(bits)
        self.first = first

    def probe(self, keys: np.ndarray, level: int) -> np.ndarray:
        block = packed.part_of(keys, self.blocks).astype(np.int64) - self.first
        hit = np.ones(len(keys), bool)
        flat = self.bits.reshape(-1)
        for at in bit_positions(keys, level):
            hit &= (flat[block * (BLOCK_BITS // 8) + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
        return hit

    def held(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it is not held."""
        found = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level in range(1, len(LEVEL_COUNT)):
            left = left[self.probe(keys[left], level)]
            if len(left) == 0:
                break
            found[left] = level
        return found

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each n-gram, 0 if it is not held."""
        return LEVEL_COUNT[self.held(keys)]


def bit_positions(keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Places of an entry (n-gram, level) within its block."""
    seed = mix(keys ^ np.uint64(level * _LEVEL % (1 << 64)))
    step = (seed >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield (seed & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
        seed = seed + step


def fill_block(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The bits of one block as bytes."""
    flags = np.zeros(BLOCK_BITS, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in bit_positions(keys[level >= q], q):
            flags[at] = True
    return np.packbits(flags, bitorder="little")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if len(keys) == 0:
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _split_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts that fit 32 bits."""
    return keys, np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)


def _count_pieces(parts: int, pairs: bool):
    """Packed counts of the words, or of the word pairs, of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in pieces(batches, "text", 2 << 20):
            tokens, offsets = tokens_of(text_column(batch, "text"))
            keys = pair_keys(histories(tokens, offsets), tokens) if pairs else tokens
            held.append(np.unique(keys, return_counts=True))
            size += len(held[-1][0])
            if size > packed.HELD_KEYS:
                keys, counts = _summed(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [(keys, counts)], len(keys)
                if size > packed.HELD_KEYS // 2:
                    yield packed.blocks([*_split_counts(keys, counts)], parts, packed.pack_close)
                    held, size = [], 0
        if held:
            found = packed.blocks([*_split_counts(*_summed(*map(np.concatenate, zip(*held, strict=True))))], parts, packed.pack_close)
            if found is not None:
                yield found

    return run


def _table(least: int):
    """Rows of summed counts of a part, without keys rarer than ``least``; key null: the histogram over the exact counts."""

    def work(part: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(*columns)
        kept = counts >= least
        yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(counts[kept])], ["key", "n"])

    return work


def count_ngrams(train: DataFrame, text: str, pairs: bool, least: int, parts: int) -> DataFrame:
    """key and count of every word, or of every word pair with a count of at least ``least``; written to the shared folder."""
    plain = train.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = plain.mapInArrow(_count_pieces(parts, pairs), packed.SCHEMA)
    return stored(packed.by_part(found, _table(least), KINDS, "key long, n long", packed.unpack_close), "lm-counts")


def build_filter(words: DataFrame, pairs: DataFrame, max_bits: int = MAX_BITS) -> tuple[LogFrequencyFilter, int]:
    """The filter of all words and of the pairs that fit, and the least count of a pair in it."""
    level = (F.floor(F.log2(F.col("n"))) + 1).cast("long")
    needed = words.agg(F.sum(level)).first()[0] or 0
    room = max_bits // BITS_PER_ENTRY - needed
    # one row per level: pairs are cut between powers of two, so that the histogram is small at any size
    by_level = {r["q"]: r["entries"] for r in pairs.groupBy(level.alias("q")).agg(F.sum(level).alias("entries")).collect()}
    cutoff, entries = 1 << 62, 0
    for q in sorted(by_level, reverse=True):
        if entries + by_level[q] > room:
            break
        entries += by_level[q]
        cutoff = 1 << (q - 1)
    blocks = max(1, min(max_bits // BLOCK_BITS, -(-BITS_PER_ENTRY * (needed + entries) // BLOCK_BITS)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # entries of a partition may belong to several blocks: bits are set block by block
        keys, counts = [], []
        for batch in batches:
            keys.append(np.asarray(batch.column(0)).view(np.uint64))
            counts.append(np.asarray(batch.column(1)))
        if not keys:
            return
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        block = packed.part_of(keys, blocks)
        order = np.argsort(block, kind="stable")
        keys, level, block = keys[order], levels(counts[order]), block[order]
        for b in np.unique(block).tolist():
            a, z = np.searchsorted(block, [b, b + 1])
            body = fill_block(keys[a:z], level[a:z]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([body], pa.binary())], ["block", "bits"])

    both = words.unionByName(pairs.filter(F.col("n") >= cutoff))
    # unsigned 32 high bits, as in packed.part_of: keys of one block meet in one task
    high = F.shiftrightunsigned("key", 32)
    dealt = both.repartition(F.shiftright(high * F.lit(blocks), 32).alias("block"))
    bits = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for row in dealt.mapInArrow(build, "block int, bits binary").toArrow().to_batches():
        for block, body in zip(row.column(0).to_pylist(), row.column(1), strict=True):
            bits[block] |= np.frombuffer(body.as_buffer(), np.uint8)
    return LogFrequencyFilter(bits), cutoff


@dataclass
class SlicedFilter:
    """A filter of any size, as rows of a slice of the hash range and the bits of its blocks; slices without entries have no row."""

    rows: DataFrame
    slices: int
    blocks: int


def _pack_short(columns: list[np.ndarray]) -> bytes:
    """Sorted keys, without the bits a sliced filter does not use, and their levels."""
    return packed.pack_close([columns[0] >> SHORT, columns[1]])


def _unpack_short(sizes: list[int], bodies: list[pa.Buffer], kinds: list[np.dtype]) -> list[np.ndarray]:
    keys, level = packed.unpack_close(sizes, bodies, kinds)
    return [keys << SHORT, level]


def _level_table(part: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """All keys of a part, shortened, and their levels, packed in one row, with the number of filter entries they make."""
    keys, counts = _summed(*columns)
    level = levels(counts).astype(np.uint8)
    body = _pack_short([keys, level])
    yield pa.RecordBatch.from_arrays(
        [pa.array([len(keys)], pa.int64()), pa.array([int(level.sum())], pa.int64()), pa.array([body], pa.binary())], ["size", "entries", "block"]
    )


def pair_levels(train: DataFrame, text: str, parts: int) -> DataFrame:
    """Every word pair and its level, packed."""
    plain = train.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = plain.mapInArrow(_count_pieces(parts, True), packed.SCHEMA)
    return packed.by_part(found, _level_table, KINDS, "size long, entries long, block binary", packed.unpack_close)


def build_slices(words: DataFrame, pairs: DataFrame, parts: int = packed.PARTS) -> SlicedFilter:
    """The filter of all words and of all pairs (of ``pair_levels``), sized by their entries."""
    level = (F.floor(F.log2(F.col("n"))) + 1).cast("long")
    entries = (words.agg(F.sum(level)).first()[0] or 0) + (pairs.agg(F.sum("entries")).first()[0] or 0)
    blocks = max(1, -(-BITS_PER_ENTRY * entries // BLOCK_BITS))
    slices = min(parts, -(-blocks // SLICE_BLOCKS))
    each = -(-blocks // slices)

    def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
            order = np.argsort(keys)
            found = packed.blocks([keys[order], levels(counts[order]).astype(np.uint8)], slices, _pack_short)
            if found is not None:
                yield found

    def pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = packed.blocks(_unpack_short([size], [body.as_buffer()], LEVEL_KINDS), slices, _pack_short)
                if found is not None:
                    yield found

    def fill(part: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, level = columns
        block = packed.part_of(keys, slices * each) - part * each
        order = np.argsort(block, kind="stable")
        keys, level, block = keys[order], level[order], block[order]
        bits = np.zeros((each, BLOCK_BITS // 8), np.uint8)
        for b in np.unique(block).tolist():
            a, z = np.searchsorted(block, [b, b + 1])
            bits[b] = fill_block(keys[a:z], level[a:z])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["slice", "bits"])

    both = words.select("key", "n").mapInArrow(pack_words, packed.SCHEMA).unionByName(pairs.select("size", "block").mapInArrow(pack_pairs, packed.SCHEMA))
    return SlicedFilter(stored(packed.by_part(both, fill, LEVEL_KINDS, "slice int, bits binary", _unpack_short), "lm-filter"), slices, slices * each)


@dataclass
class Model:
    words: DataFrame
    filter: LogFrequencyFilter | SlicedFilter
    tokens: int
    kinds: int
    texts: int
    least_pair: int


def fit(train: DataFrame, text: str = "text", max_bits: int = MAX_BITS, parts: int = packed.PARTS) -> Model:
    """Count the training texts and build a filter of at most ``max_bits``."""
    words = count_ngrams(train, text, False, 1, parts)
    pairs = count_ngrams(train, text, True, MIN_PAIR_COUNT, parts)
    bloom, least = build_filter(words, pairs, max_bits)
    return Model(words, bloom, *_totals(words), least)


def fit_whole(train: DataFrame, text: str = "text", parts: int = packed.PARTS) -> Model:
    """Count the training texts and build a filter of all words and pairs, as large as they need."""
    with shuffles_removed(train.sparkSession):
        words = count_ngrams(train, text, False, 1, parts)
        with stored_while(pair_levels(train, text, parts), "lm-levels") as pairs:  # needed only until the filter is written
            filled = build_slices(words, pairs, parts)
    return Model(words, filled, *_totals(words), 1)


def _totals(words: DataFrame) -> tuple[int, int, int]:
    """Tokens, kinds of tokens, and texts."""
    told = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = words.filter(F.col("key") == int(END.view(np.int64))).agg(F.sum("n")).first()[0] or 0
    return told["n"] or 0, told["v"], ends


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, -1 where there is none."""
    if len(keys) == 0:
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


def _least_step(kinds: dict[int, int], frequent: int) -> int:
    """The lowest step of the logarithmic count scale from which on there are at most ``frequent`` words."""
    held, least = 0, 1 << 20
    for step in sorted(kinds, reverse=True):
        held += kinds[step]
        if held > frequent:
            break
        least = step
    return least


def log_probabilities(bloom: LogFrequencyFilter, tokens: np.ndarray, offsets: np.ndarray, n_tokens: int, kinds: int, texts: int) -> np.ndarray:
    """log10 of the interpolated probability of each token."""
    distinct, inverse = np.unique(tokens, return_inverse=True)
    pair = bloom.counts(pair_keys(histories(tokens, offsets), tokens))
    return _interpolated(bloom.counts(distinct)[inverse], pair, offsets, n_tokens, kinds, texts)


def _interpolated(held: np.ndarray, pair: np.ndarray, offsets: np.ndarray, n_tokens: int, kinds: int, texts: int) -> np.ndarray:
    """The same from the counts of each token and of the pair it ends."""
    word = (held + 0.5) / (n_tokens + 0.5 * (kinds + 1))
    context = np.empty(len(held))
    context[1:] = held[:-1]
    context[offsets[:-1]] = texts
    known = context > 0
    share = np.where(known, np.minimum(pair / np.maximum(context, 1), 1.0), 0.0)
    return np.log10(np.where(known, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * word, word))


def _pack_texts(tokens: np.ndarray, offsets: np.ndarray) -> bytes:
    """The tokens of a piece of text: sizes, distinct tokens from the most frequent on, offsets, and the place of each token among these.

    Tokens that occur once come last, in the order of the text, and their place is 0. Places are kept byte by byte, lowest first.
    """
    distinct, first, places, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((first, -times))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    again = int((times > 1).sum())
    place = np.where(rank < again, rank + 1, 0).astype(np.uint32)[places]
    width = (again.bit_length() + 7) // 8
    planes = np.ascontiguousarray(place.view(np.uint8).reshape(-1, 4).T[:width])
    sizes = np.array([len(offsets), len(distinct), len(tokens), again], np.int64)
    return sizes.tobytes() + distinct[order].tobytes() + zlib.compress(offsets.astype(np.int64).tobytes() + planes.tobytes(), 1)


def _unpack_texts(body: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and offsets."""
    rows, kinds, size, again = np.frombuffer(body, np.int64, 4).tolist()
    distinct = np.frombuffer(body, np.uint64, kinds, 32)
    rest = zlib.decompress(memoryview(body)[32 + 8 * kinds :])
    offsets = np.frombuffer(rest, np.int64, rows)
    width = (again.bit_length() + 7) // 8
    place = np.zeros((size, 4), np.uint8)
    place[:, :width] = np.frombuffer(rest, np.uint8, width * size, 8 * rows).reshape(width, size).T
    place = place.view(np.uint32).reshape(-1).astype(np.int64) - 1
    once = place < 0
    place[once] = np.arange(again, kinds)
    return distinct[place], offsets


def _asked(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all tokens and of the pairs they end, and the place of each token's, then of each pair's, among them."""
    keys = np.concatenate([tokens, pair_keys(histories(tokens, offsets), tokens)]) >> SHORT << SHORT
    return np.unique(keys, return_inverse=True)


def _probe_slices(texts: DataFrame, bloom: SlicedFilter, n_tokens: int, kinds: int, ends: int) -> DataFrame:
    """row and score of all rows of ``texts`` (first row, packed tokens of a piece), by asking each slice once per piece."""
    slices, blocks = bloom.slices, bloom.blocks
    each = blocks // slices

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens, offsets = _unpack_texts(body.as_buffer())
                keys, _ = _asked(tokens, offsets)
                part = packed.part_of(keys, slices)
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                bodies = pa.array([packed.pack_keys(x >> SHORT) for x in np.split(keys, first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(np.full(len(first), chunk)), bodies], ["slice", "chunk", "body"])
        release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part_filter = None, None
        chunks: list[int] = []
        asked: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            keys = np.concatenate(asked)
            level = part_filter.held(keys) if part_filter is not None else np.zeros(len(keys), np.int64)
            bodies = np.split(level.astype(np.uint8), np.cumsum([len(x) for x in asked])[:-1])
            out = [pa.array(chunks, pa.int64()), pa.array([now] * len(chunks), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in bodies], pa.binary())]
            chunks.clear()
            asked.clear()
            return pa.RecordBatch.from_arrays(out, ["chunk", "slice", "body"])

        size = 0
        for batch in batches:
            for part, chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if chunks and (part != now or size > PROBED_KEYS):
                    yield told()
                    size = 0
                if part != now:
                    now, part_filter = part, None
                if chunk < 0:  # the slice itself comes first
                    bits = np.frombuffer(body.as_buffer(), np.uint8).reshape(each, BLOCK_BITS // 8)
                    part_filter = LogFrequencyFilter(bits, blocks, part * each)
                else:
                    chunks.append(chunk)
                    asked.append(packed.unpack_keys(body.as_buffer())[0] << SHORT)
                    size += len(asked[-1])
        if chunks:
            yield told()
        release()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, got = None, None, []

        def summed() -> pa.RecordBatch:
            tokens, offsets = _unpack_texts(texts)
            keys, places = _asked(tokens, offsets)
            level = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in got])
            if len(level) != len(keys):
                raise ValueError(f"{len(level)} levels for {len(keys)} n-grams")
            count = LEVEL_COUNT[level][places]
            logs = _interpolated(count[: len(tokens)], count[len(tokens) :], offsets, n_tokens, kinds, ends)
            rows = np.arange(now, now + len(offsets) - 1)
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.add.reduceat(logs, offsets[:-1]))], ["row", "score"])

        for batch in batches:
            for chunk, part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part < 0:  # the texts come before their levels
                    if got:
                        yield summed()
                    now, texts, got = chunk, body.as_buffer(), []
                else:
                    got.append(body.as_buffer())
        if got:
            yield summed()
        release()

    asked = texts.mapInArrow(ask, "slice int, chunk long, body binary")
    held = bloom.rows.select("slice", F.lit(-1).cast("long").alias("chunk"), F.col("bits").alias("body"))
    told = held.unionByName(asked).repartition("slice").sortWithinPartitions("slice", "chunk").mapInArrow(answer, "chunk long, slice int, body binary")
    own = texts.select(F.col("row").alias("chunk"), F.lit(-1).alias("slice"), F.col("texts").alias("body"))
    return own.unionByName(told).repartition("chunk").sortWithinPartitions("chunk", "slice").mapInArrow(combine, "row long, score double")


_SCORED = pa.schema([(n, t) for n, t in (("row", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("sum", pa.float64()), ("score", pa.float64()), ("texts", pa.binary()))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    step = F.floor(F.log2("n") * 16)
    least = _least_step({r["step"]: r["kinds"] for r in model.words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("kinds")).collect()}, frequent)
    top = model.words.filter(step >= least).toArrow()
    keys, values = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    sliced = isinstance(model.filter, SlicedFilter)
    shared = spark.sparkContext.broadcast((None if sliced else model.filter.bits, keys[order], values[order]))
    n_tokens, kinds, texts = model.tokens, model.kinds, model.texts
    defined = n_tokens > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, keys, values = shared.value
        bloom = None if sliced else LogFrequencyFilter(bits)
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text", ASKING_TEXT if sliced else 1 << 20):
            tokens, offsets = tokens_of(text_column(batch, "text"))
            n = np.diff(offsets)
            count = _look_up(keys, values, tokens)
            sure = count > 0
            logs = np.where(sure, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            begins = offsets[:-1]
            if defined and not sliced:
                likely = np.add.reduceat(log_probabilities(bloom, tokens, offsets, n_tokens, kinds, texts), begins)
            else:
                likely = np.full(len(n), np.nan)
            rows = np.arange(row, row + len(n))
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("id"), pa.nulls(len(n), pa.int64()), pa.array(n), pa.array(np.add.reduceat(sure.astype(np.int64), begins)), pa.array(np.add.reduceat(logs, begins)), pa.array(likely), pa.nulls(len(n), pa.binary())],
                schema=_SCORED,
            )
            if defined and sliced:
                whole = pa.array([_pack_texts(tokens, offsets)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rows[:1]), *(pa.nulls(1, t) for t in _SCORED.types[1:-1]), whole], schema=_SCORED)
            rare = np.flatnonzero(~sure)
            if len(rare):
                owner = np.repeat(np.arange(len(n)), n)[rare]
                order = np.lexsort((tokens[rare], owner))
                owner, key = owner[order], tokens[rare][order]
                first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])
                times = np.diff(np.r_[first, len(key)])
                none = pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[owner[first]]), none, pa.array(key[first].view(np.int64)), pa.array(times), none, none.cast(pa.float64()), none.cast(pa.float64()), pa.nulls(len(first), pa.binary())],
                    schema=_SCORED,
                )

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # written once: all kinds of rows come from the same run of each task
    told = "row long, id long, key long, n_tokens long, n_known long, sum double, score double, texts binary"
    found = stored(plain.mapInArrow(run, told), "lm-scored")
    rare_words = model.words.filter(step < least).withColumnRenamed("n", "c")
    rare = found.filter("key IS NOT NULL").select("row", "key", F.col("n_tokens").alias("times"))
    rare = rare.join(rare_words, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more"),
    )
    whole = found.filter("key IS NULL AND n_tokens IS NOT NULL").drop("texts").join(rare, "row", "left")
    if defined and sliced:
        texts = found.filter("key IS NULL AND n_tokens IS NULL").select("row", "texts")
        whole = whole.drop("score").join(_probe_slices(texts, model.filter, n_tokens, kinds, model.texts), "row", "left")
    unit = math.log10(n_tokens + 0.5 * (kinds + 1))
    base = F.col("sum") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)
    return whole.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        F.when(F.isnan("score"), F.lit(None)).otherwise(F.col("score")).alias("score"),
    )


def held_out(id_col: str = "doc_id"):
    """True for the fifth of documents that training leaves out."""
    return F.coalesce(doc_bucket(id_col, 5) == 1, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Every document scored by what the documents that are not held out say."""
    model = fit_whole(docs.filter(doc_bucket("doc_id", 5) != 1))
    found = score(docs, model)
    return found.withColumn("held_out", held_out())
