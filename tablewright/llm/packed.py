"""Large sets of hashed keys moved through a shuffle as packed blocks instead of one row each.

A task collects keys with their values, and hands them on as one block per part (a range of the hash). Blocks of a part meet
in one task and are worked on part by part, so memory is bounded by the size of one part: choose ``parts`` to fit the data.

Blocks hold their columns one after the other, or, with ``pack_close`` and ``unpack_close``, a first column of sorted keys as its
gaps (Rice code) and a second one of counts or levels that are mostly 1; both ways nothing is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.common import release

#: Parts by default: about 40 MB each for 5 thousand million keys.
PARTS = 1024
#: Keys a task holds before it hands them on.
HELD_KEYS = 1 << 19
SCHEMA = "part int, size int, block binary"
#: Of packed keys: how many, bytes of marks, low bits, the first key.
_HEAD = struct.Struct("<IIBQ")
ARROW_SCHEMA = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("block", pa.binary())])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, rising with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their gaps: the low bits as they are, the rest as so many zeros and a one."""
    if len(keys) == 0:
        return _HEAD.pack(0, 0, 0, 0)
    gaps = np.diff(keys)
    mean = (int(keys[-1]) - int(keys[0])) // max(len(gaps), 1)
    low = max((mean * 7 // 10).bit_length() - 1, 0)
    whole, odd = divmod(low, 8)
    stops = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1)
    marks = np.zeros(stops[-1] if len(gaps) else 0, bool)
    marks[stops - 1] = True
    marked = np.packbits(marks)
    taken = gaps.view(np.uint8).reshape(-1, 8)  # lowest byte first
    cut = np.packbits(np.unpackbits(taken[:, whole : whole + 1], axis=1, count=odd, bitorder="little")) if odd else marked[:0]
    return b"".join([_HEAD.pack(len(keys), len(marked), low, int(keys[0])), taken[:, :whole].tobytes(), cut.tobytes(), marked.tobytes()])


def unpack_keys(body: bytes | pa.Buffer) -> tuple[np.ndarray, int]:
    """The keys, and the place behind them in the body."""
    count, marked, low, first = _HEAD.unpack_from(body)
    at, whole, odd = _HEAD.size, *divmod(low, 8)
    size = max(count - 1, 0)
    keys = np.zeros(count, np.uint64)
    taken = keys.view(np.uint8).reshape(-1, 8)
    taken[1:, :whole] = np.frombuffer(body, np.uint8, size * whole, at).reshape(size, whole)
    at += size * whole
    if odd:
        cut = np.unpackbits(np.frombuffer(body, np.uint8, -(-size * odd // 8), at), count=size * odd).reshape(size, odd)
        taken[1:, whole : whole + 1] = np.packbits(cut, axis=1, bitorder="little")
        at += -(-size * odd // 8)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8, marked, at)))
    keys[1:] += (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    keys[:1] = first
    return np.cumsum(keys, dtype=np.uint64), at + marked


def _pack_small(values: np.ndarray) -> bytes:
    """Positive whole numbers below 2^32: a bit for each, a byte for those above 1, four bytes more for those above 255."""
    more = values > 1
    rest = values[more]
    wide = rest > 255
    return np.packbits(more).tobytes() + np.where(wide, 0, rest).astype(np.uint8).tobytes() + rest[wide].astype(np.uint32).tobytes()


def _unpack_small(size: int, body: bytes | pa.Buffer, at: int, kind: np.dtype) -> np.ndarray:
    bits = -(-size // 8)
    more = np.unpackbits(np.frombuffer(body, np.uint8, bits, at), count=size).view(bool)
    at += bits
    rest = np.frombuffer(body, np.uint8, int(more.sum()), at).astype(kind)
    wide = rest == 0
    rest[wide] = np.frombuffer(body, np.uint32, int(wide.sum()), at + len(rest))
    values = np.ones(size, kind)
    values[more] = rest
    return values


def pack_close(columns: list[np.ndarray]) -> bytes:
    keys, values = columns
    return pack_keys(keys) + _pack_small(values)


def unpack_close(sizes: list[int], bodies: list[pa.Buffer], kinds: list[np.dtype]) -> list[np.ndarray]:
    """What ``unpack`` gives, from blocks of ``pack_close``."""
    keys, values = [np.zeros(0, kinds[0])], [np.zeros(0, kinds[1])]
    for size, body in zip(sizes, bodies, strict=True):
        found, at = unpack_keys(body)
        keys.append(found)
        values.append(_unpack_small(size, body, at, kinds[1]))
    return [np.concatenate(keys), np.concatenate(values)]


def joined(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def blocks(columns: list[np.ndarray], parts: int, pack: Callable[[list[np.ndarray]], bytes] = joined) -> pa.RecordBatch | None:
    """Columns of equal length, the first one the sorted keys, cut into one block per part."""
    keys = columns[0]
    if len(keys) == 0:
        return None
    part = part_of(keys, parts)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    last = np.r_[first[1:], len(keys)]
    body = [pack([c[a:b] for c in columns]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first], pa.int32()), pa.array((last - first).astype(np.int32)), pa.array(body, pa.binary())],
        schema=ARROW_SCHEMA,
    )


def unpack(sizes: list[int], bodies: list[pa.Buffer], kinds: list[np.dtype]) -> list[np.ndarray]:
    """The columns of several blocks, one after the other."""
    found: list[list[np.ndarray]] = [[] for _ in kinds]
    for size, body in zip(sizes, bodies, strict=True):
        at = 0
        for column, kind in zip(found, kinds, strict=True):
            column.append(np.frombuffer(body, dtype=kind, count=size, offset=at))
            at += size * kind.itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(found, kinds, strict=True)]


def by_part(
    packed: DataFrame, work: Callable[[int, list[np.ndarray]], Iterator[pa.RecordBatch]], kinds: list[np.dtype], schema: str, unpack: Callable = unpack
) -> DataFrame:
    """Bring the blocks of each part together and apply ``work(part, columns)`` to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sizes, bodies = None, [], []
        for batch in batches:
            for p, size, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part and bodies:
                    yield from work(part, unpack(sizes, bodies, kinds))
                    sizes, bodies = [], []
                part = p
                sizes.append(size)
                bodies.append(body.as_buffer())  # no copy
        if bodies:
            yield from work(part, unpack(sizes, bodies, kinds))
        release()

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)
