"""Source divergence audit over K²-quadtrees of the group-term count matrix.

A group is a source within a language. Each language keeps the terms that occur in enough of its documents; every group gives
every kept term a smoothed share p in billionths, and two groups differ by the sum of floor((p-q)²/(p+q)) over all kept terms.
Most cells of the matrix of groups and terms are zero, and a zero cell's share depends on its group alone.

1. Tasks count terms in Arrow batches of documents, and send one row per group and term.
2. Those rows are dealt by (language, term). Counts per group, per language and the number of documents come out of that one
   exchange. Terms in too few documents end here.
3. The matrix of a language is cut into blocks of about ``BLOCK_TERMS`` terms and tiles of ``TILE_GROUPS`` groups; a pair of
   tiles and a block of terms is one small job. It builds a quadtree (k = 2): per level one bit for each quadrant of a quadrant
   that holds something. All pairs of its groups walk down the tree together, level by level. Where both quadrants are empty
   the walk ends and their price is width times the price of two zero cells; what is left are the leaves in which at least one
   of the two groups has a count.
4. Sums of the blocks are added per pair, and terms that none of a job's groups has are priced like any empty quadrant.

All arithmetic is in whole numbers (shares in DECIMAL(38), differences in 64 bits, for N below 10^19).

Rules: null text, language and source count as ''. Every group that occurs is compared, also one without terms; in a language
without kept terms all values are 0. Repeated rows count each, also as documents. Ties rank by item. A group alone in its
language has no pairs. An empty table gives an empty table. Extra columns are not read. Texts are read whole, at most a
megabyte of words at a time. The report holds all pairs of sources of a language, so the number of sources per language is
bounded by what one wants to read; groups are numbered by a window over that list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import pieces, small_side, stored, text_column

#: Documents of its language a term must occur in.
MIN_DOCUMENTS = 10
#: Ranks of the most telling terms of a group.
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK_TERMS = 512
TILE_GROUPS = 32
#: Entries a task counts before it sends them on.
HELD_ENTRIES = 400_000
_SLICE = 1 << 20

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, in slices of about a megabyte."""
    start = 0
    while start < len(text):
        end = min(start + _SLICE, len(text))
        while end < len(text) and _TERM_BYTES[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_TERM_BYTES).split()
        start = end


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    names = ["lang", "source", "term", "n", "docs"]

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            terms = list(n)
            columns = [
                pa.array([lang] * (len(terms) + 1), pa.string()),
                pa.array([source] * (len(terms) + 1), pa.string()),
                pa.array([*terms, None], pa.binary()).cast(pa.string()),
                pa.array([*n.values(), 0], pa.int64()),
                pa.array([*map(docs.__getitem__, terms), 0], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    for batch in pieces(batches, "text"):
        texts = text_column(batch, "text").cast(pa.large_binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for found in words(text):
                n.update(found)
                own.update(found)
            docs.update(own)
        if sum(len(n) for n, _ in seen.values()) > HELD_ENTRIES:
            yield from sent()
            seen.clear()
    yield from sent()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences in the group), docs (documents of the group with it); one row per group has term null."""
    empty = F.lit("")
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    sent = plain.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")
    dealt = sent.repartition("lang", "term")  # every task sends a group and term at most a few times: nothing to combine before
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)) in whole numbers; null without terms."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(27,0)")
    return F.when(terms > 0, 1 + F.call_function("div", scaled, (total + 2 * terms).cast("decimal(38,0)")))


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)² / (p + q)) in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class QuadTree:
    """K²-tree (k = 2) of the non-zero cells of a matrix: ``below[l][4 i + q]`` is the number of quadrant q of the i-th filled
    quadrant of level l among the filled quadrants of level l + 1, or -1 if it is empty."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, side_bits: int):
        code = np.zeros(len(rows), np.int64)
        for bit in range(side_bits):
            code |= ((rows >> bit & 1) << 2 * bit + 1) | ((cols >> bit & 1) << 2 * bit)
        order = np.argsort(code, kind="stable")
        self.values = values[order]
        self.below: list[np.ndarray] = []
        level = code[order]
        for _ in range(side_bits):
            above = np.unique(level >> 2)
            quadrants = np.full(4 * len(above), -1, np.int64)
            quadrants[4 * np.searchsorted(above, level >> 2) + (level & 3)] = np.arange(len(level))
            self.below.append(quadrants)
            level = above
        self.below.reverse()
        self.filled = len(values) > 0

    def child(self, level: int, nodes: np.ndarray, quadrants: np.ndarray) -> np.ndarray:
        if not len(self.below[level]):
            return np.full(len(nodes), -1, np.int64)
        return np.where(nodes >= 0, self.below[level][4 * np.maximum(nodes, 0) + quadrants], -1)


_CHILDREN = np.array([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], np.int64)


def pair_sums(tree: QuadTree, zero: np.ndarray, width: int, side_bits: int, across: int | None) -> np.ndarray:
    """Differences of all pairs of rows a < b, summed over ``width`` columns.

    ``zero`` is the share of a zero cell per row. With ``across``, only pairs of a row below and a row from that number on.
    """
    rows = len(zero)
    a = b = col = np.zeros(1, np.int64)
    at_a = at_b = np.full(1, 0 if tree.filled else -1, np.int64)
    empty = np.zeros((1, 1), np.int64)  # columns already known to be zero on both sides, per pair of row quadrants
    for level in range(side_bits):
        size = 1 << (side_bits - level - 1)
        many = len(a)
        qa, qb, qc = (np.tile(_CHILDREN[:, i], many) for i in range(3))
        at_a, at_b = (tree.child(level, np.repeat(at, 8), 2 * q + qc) for at, q in ((at_a, qa), (at_b, qb)))
        a, b, col = (2 * np.repeat(x, 8) + q for x, q in ((a, qa), (b, qb), (col, qc)))
        real = np.clip(width - col * size, 0, size)
        keep = (a <= b) & (b * size < rows) & (real > 0)
        if size == 1:
            keep &= a < b
        if across is not None:
            keep &= (a * size < across) & ((b + 1) * size > across)
        none = keep & (at_a < 0) & (at_b < 0)
        empty = np.kron(empty, np.ones((2, 2), np.int64))
        np.add.at(empty, (a[none], b[none]), real[none])
        keep &= ~none
        a, b, col, at_a, at_b = (x[keep] for x in (a, b, col, at_a, at_b))
    found = np.zeros((rows, rows), np.int64)
    if rows > 1:
        p = np.where(at_a >= 0, tree.values[np.maximum(at_a, 0)] if tree.filled else 0, zero[a])
        q = np.where(at_b >= 0, tree.values[np.maximum(at_b, 0)] if tree.filled else 0, zero[b])
        np.add.at(found, (a, b), (p - q) ** 2 // (p + q))
        found += empty[:rows, :rows] * ((zero[:, None] - zero[None, :]) ** 2 // (zero[:, None] + zero[None, :]))
    return found


def _price(job: pd.DataFrame) -> pd.DataFrame:
    """Sums of the pairs of one job: a pair of tiles and a block of terms."""
    groups = job[job["term"].isna()].sort_values("idx")
    cells = job[job["term"].notna()]
    first, second = int(job["ti"].iloc[0]), int(job["tj"].iloc[0])
    row = cells["idx"].to_numpy() - TILE_GROUPS * np.where(cells["tile"].to_numpy() == first, first, second - 1)
    col, seen = pd.factorize(cells["term"])
    zero = groups["zero"].to_numpy(np.int64)
    side_bits = max(1, int(max(len(zero), len(seen), 2) - 1).bit_length())
    tree = QuadTree(row.astype(np.int64), col.astype(np.int64), cells["p"].to_numpy(np.int64), side_bits)
    across = TILE_GROUPS if first < second else None
    found = pair_sums(tree, zero, len(seen), side_bits, across)
    a, b = np.triu_indices(len(zero), 1)
    if across is not None:
        a, b = (x[(a < across) & (b >= across)] for x in (a, b))
    names = groups["source"].to_numpy()
    return pd.DataFrame(
        {
            "lang": job["lang"].iloc[0], "a": names[a], "b": names[b], "value": found[a, b], "priced": len(seen),
            "empty": (zero[a] - zero[b]) ** 2 // (zero[a] + zero[b]), "terms": groups["terms"].iloc[0],
        }
    )


def pair_divergence(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (the other source), value for every two sources of a language."""
    tile = F.floor(F.col("idx") / TILE_GROUPS)
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    names = ["lang", "source", "idx", "tile", "block", "term", "p", "zero", "terms", "tiles"]
    filled = cells.withColumns({"tile": tile, "block": block}).select(names)
    marks = groups.withColumns(
        {"tile": tile, "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "term": F.lit(None).cast("string"), "p": F.lit(0).cast("long")}
    )
    rows = filled.unionByName(marks.select(names)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other")}).drop("other", "tiles")
    told = "lang string, a string, b string, value long, priced long, empty long, terms long"
    priced = rows.groupBy("lang", "ti", "tj", "block").applyInPandas(_price, told)
    summed = priced.groupBy("lang", "a", "b").agg(
        (F.sum("value") + (F.max("terms") - F.sum("priced")) * F.max("empty")).alias("value")
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for every other source, ``term`` rows for the terms a group has most
    in excess of its language."""
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs, text, lang, source).withColumns(
        {
            "lang_docs": F.sum("docs").over(by_term),
            "lang_n": F.sum("n").over(by_term),
            "one": (F.col("source") == F.min("source").over(by_term)).cast("long"),
        }
    )
    is_term = F.col("term").isNotNull()
    kept = stored(counted.filter(~is_term | (F.col("lang_docs") >= min_documents)).drop("docs", "lang_docs"), "divergence-cells")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.when(is_term, F.col("one")).otherwise(0)).alias("terms"))
    by_lang = Window.partitionBy("lang")
    zero = F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(1).cast("long"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    groups = groups.withColumns(
        {
            "zero": zero,
            "idx": F.row_number().over(by_lang.orderBy("source")).cast("long") - 1,
            "tiles": F.ceil(F.count(F.lit(1)).over(by_lang) / TILE_GROUPS),
            "blocks": F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1).cast("long")),
        }
    )
    groups = stored(groups, "divergence-groups")
    cells = kept.filter(is_term & (F.col("n") > 0)).join(small_side(groups), ["lang", "source"])
    cells = cells.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    names = ["lang", "source", "part", "item", "value"]
    pairs = pair_divergence(cells, groups).withColumn("part", F.lit("pair")).select(names)
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    telling = cells.withColumn("q", q).filter(F.col("p") > F.col("q"))
    telling = telling.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(best)
    top = telling.withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", rank).unionByName(top)
