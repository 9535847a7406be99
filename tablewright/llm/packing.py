"""Packing of documents into sequences by minimum bin slack.

Each task packs its own documents in one pass and without a shuffle. Full windows are cut from the front of long documents;
what remains of each document joins a pool, kept as a multiset of lengths. A window takes the longest piece, then a subset-sum
program over the other lengths finds the fill that comes closest to capacity: the reachable sums are the bits of one whole
number, each length is added by shifts (1, 2, 4, ... of its copies at a time), and the search ends as soon as the capacity
itself is reachable. Walking back over the shifts gives how many pieces of each length to take. If no multiset fills the
window, one more piece is cut to size and its rest returns to the pool.

The pool is worked off from ``POOL_TOKENS`` down to half of it whenever it is full, so a task's memory does not depend on the
number of its documents, and wholly at the end. The last, fewer than ``capacity``, tokens of a task go to sequences of
descending powers of two, which need no padding. So no sequence is padded, whatever the lengths are.

Encoding. Texts are cut at blanks, tabs and line ends, which end a word for this kind of tokenizer; the ids of a word are kept
in a bounded cache. Words of printable ASCII and Latin-1 letters are cut by the file's own pattern, and their merges done by
``tiktoken``: the end-of-word mark becomes byte 0xFF, which no UTF-8 text holds, and its merges with single bytes come before
all others, as they must. All other words go to the ``tokenizers`` library itself.

Rules: null text counts as empty: its only id is the end id. Rows with equal ids are packed each for itself. A null id stays
null. Extra columns are not returned. An empty table gives an empty table. ``sequence_id`` is unique, not dense; a task that is
run again on the same rows gives the same pieces.
"""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import pieces, text_column

DEFAULT_FILE = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
#: The id after the last token of a document.
END_ID = 2
#: Tokens a task holds before it packs, 4 bytes each.
POOL_TOKENS = 1 << 21
#: Words whose ids a worker keeps.
CACHED_WORDS = 400_000
_ID_BYTES = 4
_SLICE = 1 << 20


class WordIds(dict):
    """Ids (little-endian, 4 bytes each) of the text between two blanks, by a word-level BPE file with end-of-word marks."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        suffix = told["model"].get("end_of_word_suffix")
        if told["model"]["type"] != "BPE" or not suffix:
            raise ValueError(f"{path} is not a BPE tokenizer with end-of-word marks")
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        special = {t["content"] for t in told["added_tokens"]}
        self._foreign = re.compile(r"[^!-~À-ÖØ-öø-ÿ]|" + "|".join(map(re.escape, special)) if special else r"[^!-~À-ÖØ-öø-ÿ]")
        self._split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
        letters = _byte_letters()
        ranks = {}
        for token, i in told["model"]["vocab"].items():
            if token not in special:
                ended = token.endswith(suffix)
                ranks[bytes(letters[c] for c in token.removesuffix(suffix)) + (b"\xff" if ended else b"")] = i
        if b"\xff" in ranks:  # the byte itself, which never occurs, gives its place to the mark
            del ranks[b"\xff"]
        ranks[b"\xff"] = max(ranks.values()) + 1
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self._merge = core._encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if self._foreign.search(word):
            ids = self.exact.encode(word, add_special_tokens=False).ids
        else:
            ids = [i for part in self._split.findall(word.lower()) for i in self._merge(part.encode() + b"\xff")]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; long texts are cut at blanks first, to hold few words at a time."""
        parts, start = [], 0
        while start < len(text):
            end = len(text) if len(text) - start <= _SLICE else text.find(" ", start + _SLICE)
            end = len(text) if end < 0 else end
            words = text[start:end].replace("\n", " ").replace("\t", " ").split(" ")
            parts.append(b"".join(map(self.__getitem__, words)))
            start = end
        return b"".join(parts)


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte (fixed by that format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def words_of(path: str) -> WordIds:
    """One tokenizer and cache per file and worker process."""
    return WordIds(path)


class Piece(NamedTuple):
    """Part of a document: its key, ids before it, its own ids, and the number of all of the document's."""

    key: object
    start: int
    ids: memoryview | bytes
    doc_tokens: int

    @property
    def tokens(self) -> int:
        return len(self.ids) // _ID_BYTES

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        head, rest = self.ids[: tokens * _ID_BYTES], self.ids[tokens * _ID_BYTES :]
        return self._replace(ids=head), self._replace(start=self.start + tokens, ids=rest)


def closest_fill(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` of a multiset of the given lengths (ascending, with counts), and how many of each it takes."""
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        if sums >> room & 1:
            break
        length = lengths[at]
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            more = (sums | sums << length * copies) & mask
            if more != sums:
                steps.append((length, copies, sums))
                sums = more
            left -= copies
            copies *= 2
    best = at_sum = sums.bit_length() - 1
    taken: dict[int, int] = {}
    for length, copies, before in reversed(steps):
        if not before >> at_sum & 1:
            taken[length] = taken.get(length, 0) + copies
            at_sum -= length * copies
    return best, taken


class Pool:
    """Pieces by length."""

    def __init__(self) -> None:
        self.tokens = 0
        self.lengths: list[int] = []
        self.counts: dict[int, int] = {}
        self.pieces: dict[int, list[Piece]] = {}

    def put(self, piece: Piece) -> None:
        n = piece.tokens
        if n == 0:
            return
        self.tokens += n
        if n not in self.counts:
            insort(self.lengths, n)
            self.counts[n], self.pieces[n] = 0, []
        self.counts[n] += 1
        self.pieces[n].append(piece)

    def take(self, n: int) -> Piece:
        self.tokens -= n
        self.counts[n] -= 1
        piece = self.pieces[n].pop()
        if not self.counts[n]:
            del self.counts[n], self.pieces[n], self.lengths[bisect_left(self.lengths, n)]
        return piece

    def window(self, capacity: int) -> list[Piece]:
        """Pieces that fill ``capacity`` exactly, or all there are if they are fewer."""
        chosen, room = [], capacity
        at = bisect_right(self.lengths, capacity)
        if at:
            chosen.append(self.take(self.lengths[at - 1]))
            room -= chosen[0].tokens
            best, taken = closest_fill(self.lengths, self.counts, room)
            chosen += [self.take(n) for n, copies in taken.items() for _ in range(copies)]
            room -= best
        if room and self.lengths:  # every piece left is longer than the room left
            head, rest = self.take(self.lengths[-1]).cut(room)
            chosen.append(head)
            self.put(rest)
        return chosen


def windows(documents: Iterator[tuple[object, bytes]], capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS) -> Iterator[list[Piece]]:
    """The sequences of a stream of (key, ids) as lists of pieces; all are full but the last, which are powers of two."""
    pool = Pool()
    for key, ids in documents:
        rest = Piece(key, 0, memoryview(ids), len(ids) // _ID_BYTES)
        while rest.tokens >= capacity:
            head, rest = rest.cut(capacity)
            yield [head]
        pool.put(rest._replace(ids=bytes(rest.ids)))
        if pool.tokens >= pool_tokens:
            while pool.tokens > max(pool_tokens // 2, capacity):
                yield pool.window(capacity)
    while pool.tokens >= capacity:
        yield pool.window(capacity)
    while pool.tokens:
        yield pool.window(1 << (pool.tokens.bit_length() - 1))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    path: str = DEFAULT_FILE,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Per piece: ``id_col``, start, length, ids (little-endian, 4 bytes each), doc_tokens, sequence_id, offset."""
    end = struct.pack("<I", end_id)
    key_type = docs.schema[id_col].dataType.simpleString()
    told = f"id {key_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kind = words_of(path), pa.null()

        def documents() -> Iterator[tuple[object, bytes]]:
            nonlocal kind
            for batch in pieces(batches, "text"):
                kind = batch.schema.field(0).type
                for key, body in zip(batch.column(0).to_pylist(), text_column(batch, "text").to_pylist(), strict=True):
                    yield key, words.encode(body) + end

        def table(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        rows, held = [], 0
        sequence = TaskContext.get().partitionId() << 40
        for window in windows(documents(), capacity):
            offset = 0
            for piece in window:
                rows.append((piece.key, piece.start, piece.tokens, bytes(piece.ids), piece.doc_tokens, sequence, offset))
                offset += piece.tokens
            sequence, held = sequence + 1, held + offset
            if held >= 1 << 19:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInArrow(run, told).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, its ids in one value, n_tokens without padding; padded to ``capacity`` unless n_tokens is a power of two.

    A group holds at most ``capacity`` tokens.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    found = packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
    padding = F.lit(struct.pack("<I", pad_id))
    missing = F.when(F.expr("bit_count(n_tokens) = 1"), F.lit(0)).otherwise(F.lit(capacity) - F.col("n_tokens")).cast("int")
    fill = F.aggregate(F.array_repeat(padding, missing), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return found.withColumn("ids", F.concat("ids", fill))
