"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 characters cuts each text where the hash falls on a mark, so equal passages give equal chunks in any
document. Documents that begin alike are brought to the same task (Spark's rebalance splits groups that grow too large), and
each worker encodes a chunk once: later documents take its ids from a cache of bounded size.

Joins are repaired. A cut may fall inside a word, so the first and last ids of a chunk are not trusted: the stretch between
the last trusted position of the left chunk and the first trusted one of the right chunk is encoded again. A position is
trusted if a space follows a letter, digit or ASCII mark there (the pre-tokenizer always splits at such a place, and splits
what follows without looking back) and the chunk's ids end exactly there; if they do not, the search moves on to the next
such place, at worst over the whole chunk. The ids are therefore those of the whole text.

Ids agree with the ``tokenizers`` library on the given file, ``add_special_tokens=False``. Chunks whose characters all lie
below U+0250 are encoded by the faster ``tiktoken`` on the same vocabulary; others by ``tokenizers`` itself.

Rules: null text counts as empty and has no ids. Repeated rows are encoded like any other. Extra columns are not returned.
The tokenizer's file must be on every worker. ``CACHE_BYTES`` bounds the cache of a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import pieces, text_column

DEFAULT_FILE = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 16
#: One cut in 2**CUT_BITS characters on average.
CUT_BITS = 9
CACHE_BYTES = 64 << 20
_ENTRY_BYTES = 400

_TRUSTED = re.compile(r"[\w!-/:-@\[-`{-~] ")
_WIDE = re.compile("[ɐ-\U0010ffff]")


class ByteTokenizer:
    """A byte-level BPE tokenizer file: exact encoding of any text, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        if (told.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or told["model"]["type"] != "BPE":
            raise ValueError(f"{path} is not a byte-level BPE tokenizer")
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(max(ranks.values()), max(self.special.values(), default=0)))
        for token, i in chain(ranks.items(), ((t.encode(), i) for t, i in self.special.items())):
            self.bytes_of[i] = token
        self.sizes = [len(b) for b in self.bytes_of]
        self._fast = tiktoken.Encoding(
            "file",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={token: i for token, i in ranks.items() if i not in self.special.values()},
            special_tokens=self.special,
        )
        self._allowed = set(self.special)

    def encode(self, text: str) -> list[int]:
        if _WIDE.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode(text, allowed_special=self._allowed)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte (fixed by that format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_positions(texts: list[str], bits: int = CUT_BITS) -> list[list[int]]:
    """For each text the positions before which it is cut: where the hash of the 16 characters before falls on a mark."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    found: list[list[int]] = [[] for _ in texts]
    if len(codes) < WINDOW:
        return found
    rolled = (codes + np.uint32(1)) * np.uint32(0x9E3779B1)
    rolled ^= rolled >> np.uint32(15)
    factor, span = 0x01000193, 1
    while span < WINDOW:  # rolled[i] covers ``span`` characters from i on
        rolled = rolled[:-span] * np.uint32(factor) + rolled[span:]
        factor, span = factor * factor % (1 << 32), span * 2
    rolled *= np.uint32(0x85EBCA6B)
    cuts = np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + WINDOW
    rows = np.searchsorted(ends, cuts, side="left")
    begins = ends - sizes
    for row, at in zip(rows.tolist(), (cuts - begins[rows]).tolist(), strict=True):
        if WINDOW <= at < len(texts[row]):  # the window lies in this text, and something follows
            found[row].append(at)
    return found


@cache
def tokenizer_of(path: str) -> ByteTokenizer:
    """One tokenizer per file and worker process, whatever the number of its tasks."""
    return ByteTokenizer(path)


class ChunkEncoder:
    """Encodes texts chunk by chunk; equal chunks are encoded once while they stay in the cache."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.tokenizer = tokenizer_of(path)
        self.limit = cache_bytes // 2
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.joins: dict[str, array] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def _trust(self, chunk: str, ids: list[int]) -> tuple[str, array, str] | None:
        """Text before the first trusted position, the ids between, text after the last; None if there are no two."""
        sizes = self.tokenizer.sizes
        first, n_first, done = 0, 0, 0
        for place in _TRUSTED.finditer(chunk):
            done += len(chunk[first : place.end() - 1].encode())
            first = place.end() - 1
            while done > 0:
                done -= sizes[ids[n_first]]
                n_first += 1
            if done == 0:
                break
        else:
            return None
        last, n_last, done = len(chunk), len(ids), 0
        while True:
            at = chunk.rfind(" ", first + 1, last)
            while at > 0 and not _TRUSTED.match(chunk, at - 1):
                at = chunk.rfind(" ", first + 1, at)
            if at < 0:
                return None
            done += len(chunk[at:last].encode())
            last = at
            while done > 0:
                n_last -= 1
                done -= sizes[ids[n_last]]
            if done == 0:
                return chunk[:first], array("I", ids[n_first:n_last]), chunk[last:]

    def _chunk(self, chunk: str) -> tuple[str, array | None, str]:
        key = hashlib.blake2b(chunk.encode(), digest_size=16).digest()
        entry = self.young.get(key)
        if entry is None and (entry := self.old.get(key)) is None:
            self.encoded += 1
            entry = self._trust(chunk, self.tokenizer.encode(chunk)) or (chunk, None, "")
            self.young[key] = entry
            self.held += _ENTRY_BYTES + 4 * len(entry[1] or ()) + 2 * len(entry[0]) + 2 * len(entry[2])
            if self.held > self.limit:
                self.old, self.young, self.held = self.young, {}, 0
        else:
            self.reused += 1
        return entry

    def _join(self, text: str) -> array:
        ids = self.joins.get(text)
        if ids is None:
            ids = array("I", self.tokenizer.encode(text))
            if len(text) <= 64:
                if len(self.joins) > 50_000:
                    self.joins.clear()
                self.joins[text] = ids
        return ids

    def encode(self, text: str, cuts: list[int]) -> array:
        """The ids of the whole text."""
        if not cuts:
            return array("I", self.tokenizer.encode(text))
        ids, waiting = array("I"), []
        for start, end in zip([0, *cuts], [*cuts, len(text)], strict=True):
            head, middle, tail = self._chunk(text[start:end])
            waiting.append(head)
            if middle is not None:
                ids.extend(self._join("".join(waiting)))
                ids.extend(middle)
                waiting = [tail]
        ids.extend(self._join("".join(waiting)))
        return ids

    def encode_all(self, texts: list[str]) -> Iterator[array]:
        for text, cuts in zip(texts, cut_positions(texts), strict=True):
            yield self.encode(text, cuts)


@cache
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder, with its cache, per file and worker process."""
    return ChunkEncoder(path)


Row = Callable[[ByteTokenizer, array], dict]


def _encode_batches(path: str, row: Row, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in pieces(batches, "text", 1 << 20):
            rows = [row(encoder.tokenizer, ids) for ids in encoder.encode_all(text_column(batch, "text").to_pylist())]
            columns = [pa.array([r[name] for r in rows], schema.field(name).type) for name in schema.names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *schema.names])

    return run


def _near_each_other(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows whose texts begin alike in one partition, of a size that Spark keeps even."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = plain.withColumn("begin", F.xxhash64(F.substring("text", 1, 64)))
    return keyed.hint("rebalance", "begin").drop("begin")


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = DEFAULT_FILE) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row."""
    run = _encode_batches(path, lambda _, ids: {"ids": np.asarray(ids, np.int32)}, pa.schema([("ids", pa.list_(pa.int32()))]))
    found = _near_each_other(docs, id_col, text).mapInArrow(run, f"id {_id_type(docs, id_col)}, ids array<int>")
    return found.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str = DEFAULT_FILE) -> DataFrame:
    """``id_col`` and ``text`` of every row of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            texts = [None if x is None else tokenizer.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    plain = encoded.select(F.col(id_col).alias("id"), F.col(ids).alias("ids"))
    return plain.mapInArrow(run, f"id {_id_type(encoded, id_col)}, text string").withColumnRenamed("id", id_col)


def _digest(tokenizer: ByteTokenizer, ids: array) -> dict:
    decoded = tokenizer.decode(ids).encode("utf-8")
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(decoded).hexdigest(),
    }


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = DEFAULT_FILE) -> DataFrame:
    """Encode, then decode, within one task: n_tokens and the digests of the ids and of the decoded text."""
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    run = _encode_batches(path, _digest, schema)
    told = f"id {_id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _near_each_other(docs, id_col, text).mapInArrow(run, told).withColumnRenamed("id", id_col)
