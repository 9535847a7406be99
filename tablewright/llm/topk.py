"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become whole numbers, floor(256 x). All vectors are rotated onto the singular directions of the whole table (from
the d x d matrix of second moments, summed in the tasks), so that the first coordinates carry most of a product. Candidates
are dealt evenly into strata; a task takes one stratum in order of descending length and runs every block of queries over
it. A run of candidates is skipped for a query once length times length cannot reach its k-th best score; within a run,
the partial sum over the first coordinates plus the product of the remaining lengths is an upper bound, and only pairs
whose bound reaches the k-th best score are computed, exactly, in whole numbers. Each stratum gives at most k rows per
query; the last step keeps the best k of those.

What is replicated is the query set (a fixed share of the rows), in blocks, once per stratum. Scores start from the k-th
best over the ``HEAD_ROWS`` longest vectors, which are broadcast (bounded).

Rules: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Shorter vectors
count as padded with zeros; an empty vector scores 0 everywhere. A query skips every row with its own id. Repeated candidate
rows each take a rank; a query id that occurs with several vectors is answered for the smallest of them. Ties go to the
smaller id. Scores beyond 64 bits are cut to the largest or smallest long. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored

#: Most rows of a stratum; smaller tables get smaller strata, one per core, of LEAST_ROWS at least.
STRATUM_ROWS = 65_536
LEAST_ROWS = 2048
QUERY_BLOCK = 256
RUN_ROWS = 1024
HEAD_ROWS = 2048
#: Share of the coordinates in the partial sum.
LEADING = 0.25
_EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def _whole(x: Column) -> Column:
    """floor(256 x) as a double; from 2**53 on every double is whole, while floor() would end at the largest long."""
    y = x * 256
    return F.when(F.abs(y) < F.lit(_EXACT), F.floor(y).cast("double")).otherwise(y)


def whole_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and floor(256 x) of the rows that take part, and the vector's length."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(good).select("id", F.transform("x", _whole).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)))


@dataclass
class Rotation:
    """Singular directions, the number of leading ones, and the widest vector."""

    axes: np.ndarray
    leading: int

    def matrix(self, vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), len(self.axes)))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        rotation = Rotation(np.eye(width), width)
        for batch in batches:
            m = rotation.matrix(batch.column(0).to_pylist())
            scale = np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1.0)
            total += (m / scale).T @ (m / scale)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "line"])

    return run


def fit_rotation(vectors: DataFrame) -> Rotation:
    """Directions of largest second moment of the unit vectors, summed over the whole table."""
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if width <= 0:
        return Rotation(np.zeros((0, 0)), 0)
    lines = vectors.select("v").mapInArrow(_moments(width), "i int, line array<double>")
    summed = lines.select("i", F.posexplode("line").alias("j", "m")).groupBy("i", "j").agg(F.sum("m").alias("m")).toArrow()
    moments = np.zeros((width, width))
    moments[summed["i"].to_numpy(), summed["j"].to_numpy()] = summed["m"].to_numpy()
    _, axes = np.linalg.eigh((moments + moments.T) / 2)
    return Rotation(np.ascontiguousarray(axes[:, ::-1]), max(1, int(width * LEADING)))


class Side:
    """Whole-number vectors with their rotated leading part and the lengths of the rest."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, rotation: Rotation):
        self.ids, self.whole = ids, whole
        turned = whole @ rotation.axes
        self.lead = turned[:, : rotation.leading]
        self.rest = np.linalg.norm(turned[:, rotation.leading :], axis=1)
        self.norm = np.linalg.norm(whole, axis=1)
        self.largest = float(np.abs(whole).max(initial=0.0))

    def part(self, rows) -> Side:
        out = object.__new__(Side)
        for name in ("ids", "whole", "lead", "rest", "norm"):
            setattr(out, name, getattr(self, name)[rows])
        out.largest = self.largest
        return out


def _lowered(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles that are not above them."""
    out = scores.astype(np.float64)
    return np.where(np.abs(out) < _EXACT, out, out - np.abs(out) * 2.0**-50)


def products(queries: Side, candidates: Side, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact inner products of the pairs of rows."""
    q, c = pairs
    if queries.largest * candidates.largest * max(queries.whole.shape[1], 1) < _EXACT:
        if len(q) > 0.1 * len(queries.ids) * len(candidates.ids):
            return (queries.whole @ candidates.whole.T)[q, c].astype(np.int64)
        out = np.empty(len(q), np.int64)
        for a in range(0, len(q), 65_536):
            z = slice(a, a + 65_536)
            out[z] = np.einsum("ij,ij->i", queries.whole[q[z]], candidates.whole[c[z]]).astype(np.int64)
        return out
    exact = (sum(int(x) * int(y) for x, y in zip(queries.whole[i], candidates.whole[j], strict=True)) for i, j in zip(q, c, strict=True))
    return np.array([min(max(x, LONG_MIN), LONG_MAX) for x in exact], np.int64)


def search(queries: Side, candidates: Side, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the best k per query that reach ``least``; candidates come by descending length."""
    n = len(queries.ids)
    best_q, best_id, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bar = least.copy()
    slack = 1e-9 * (1.0 + queries.norm)
    for a in range(0, len(candidates.ids), RUN_ROWS):
        run = candidates.part(slice(a, a + RUN_ROWS))
        longest = float(run.norm[0]) if len(run.norm) else 0.0
        margin = slack * (1.0 + longest)
        active = np.flatnonzero(queries.norm * longest + margin >= bar)
        if len(active) == 0:
            break
        bound = queries.lead[active] @ run.lead.T + queries.rest[active][:, None] * run.rest[None, :]
        row, col = np.nonzero(bound >= (bar - margin)[active][:, None])
        row = active[row]
        other = queries.ids[row] != run.ids[col]
        row, col = row[other], col[other]
        score = products(queries, run, (row, col))
        good = score >= bar[row]
        best_q = np.concatenate([best_q, row[good]])
        best_id = np.concatenate([best_id, run.ids[col[good]]])
        best_s = np.concatenate([best_s, score[good]])
        order = np.lexsort((best_id, ~best_s, best_q))
        best_q, best_id, best_s = best_q[order], best_id[order], best_s[order]
        first = np.searchsorted(best_q, np.arange(n), side="left")
        rank = np.arange(len(best_q)) - first[best_q]
        kth = rank == k - 1
        bar[best_q[kth]] = np.maximum(bar[best_q[kth]], _lowered(best_s[kth]))
        keep = rank < k
        best_q, best_id, best_s = best_q[keep], best_id[keep], best_s[keep]
    return best_q, best_id, best_s


def _search_strata(rotation: Rotation, head, k: int):
    names = ["query_id", "vec_id", "score"]

    def side(rows: list[tuple[int, list]]) -> Side:
        return Side(np.array([r[0] for r in rows], np.int64), rotation.matrix([r[1] for r in rows]), rotation)

    def found(queries: Side, candidates: Side, top: Side) -> pa.RecordBatch:
        least = np.full(len(queries.ids), -np.inf)
        if len(top.ids) > k:  # one of them may be the query itself
            q, c = np.divmod(np.arange(len(queries.ids) * len(top.ids)), len(top.ids))
            scores = products(queries, top, (q, c)).reshape(len(queries.ids), -1)
            least = _lowered(np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)])
        q, ids, scores = search(queries, candidates, k, least)
        return pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(ids), pa.array(scores)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = side(head.value)
        stratum, rows, queries, candidates = None, [], [], None
        for batch in batches:
            for s, is_query, i, v in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
                if s != stratum:
                    if queries:
                        yield found(side(queries), candidates, top)
                    stratum, rows, queries, candidates = s, [], [], None
                if not is_query:
                    rows.append((i, v))
                    continue
                if candidates is None:
                    candidates, rows = side(rows), []
                queries.append((i, v))
                if len(queries) == QUERY_BLOCK:
                    yield found(side(queries), candidates, top)
                    queries = []
        if queries:
            yield found(side(queries), candidates, top)

    return run


def top_products(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products over all candidates but its own id."""
    spark = candidates.sparkSession
    rows = stored(whole_vectors(candidates, id_col, vector), "topk-vectors")
    asked = whole_vectors(queries, id_col, vector).groupBy("id").agg(F.min("v").alias("v"))
    rotation = fit_rotation(rows.unionByName(asked.withColumn("norm", F.lit(0.0))))
    longest = rows.orderBy(F.desc("norm"), "id").limit(HEAD_ROWS).select("id", "v").toArrow()
    # at most k rows of an id count towards the first bar, so that a query's own rows cannot raise it
    by_id = {}
    for i, v in zip(longest["id"].to_pylist(), longest["v"].to_pylist(), strict=True):
        by_id.setdefault(i, (i, v))
    head = spark.sparkContext.broadcast(list(by_id.values()))
    n = rows.count()
    strata = max(1, -(-n // STRATUM_ROWS), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    # lengths are spread evenly: neighbours in a random order of rows
    dealt = rows.withColumns({"stratum": F.pmod(F.xxhash64("id", "v"), F.lit(strata)).cast("int"), "is_query": F.lit(False)})
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(strata - 1))).alias("stratum"), F.lit(True).alias("is_query"), "id", "v", F.lit(0.0).alias("norm"))
    both = dealt.select("stratum", "is_query", "id", "v", "norm").unionByName(copies)
    sorted_rows = both.repartition(strata, "stratum").sortWithinPartitions("stratum", "is_query", F.desc("norm"), "id")
    found = sorted_rows.select("stratum", "is_query", "id", "v").mapInArrow(_search_strata(rotation, head, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_of_embeddings(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The rows whose vec_id is divisible by ``every`` against all rows."""
    return top_products(rows.filter(F.col("vec_id") % every == 0), rows, k)
