import math

import pytest

from tablewright.llm import topk


def brute(rows, asked, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wanted = {}
    for i, v in good:
        if i in asked:
            wanted[i] = min(wanted.get(i, v), v)
    out = set()
    for q, v in wanted.items():
        cut = lambda s: min(max(s, topk.LONG_MIN), topk.LONG_MAX)
        scores = sorted((-cut(sum(a * b for a, b in zip(v, w, strict=False))), i) for i, w in good if i != q)
        for rank, (s, i) in enumerate(scores[:k], 1):
            out.add((q, rank, i, -s))
    return out


@pytest.mark.parametrize("rows_per_stratum", [40, 2048])
def test_embeddings(spark, monkeypatch, rows_per_stratum):
    monkeypatch.setattr(topk, "LEAST_ROWS", rows_per_stratum)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    asked = {i for i, _ in rows if i % 50 == 0}
    assert set(map(tuple, topk.top_of_embeddings(df).collect())) == brute(rows, asked, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]),
        (7, None), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (None, [9.0, 9.0]), (50, [3.0]), (100, []), (11, [-1.0, -2.0]),
        (12, [5.0, 0.1, 7.0]), (12, [5.0, 0.1, 7.0]), (150, [0.001, 0.5]), (150, [0.0, 0.5]),
    ]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, norm int")
    found = topk.top_of_embeddings(df, k=3).collect()
    assert set(map(tuple, found)) == brute(rows, {0, 50, 100, 150}, 3)
    assert topk.top_of_embeddings(df.limit(0)).count() == 0
    assert topk.top_of_embeddings(df.filter("vec_id = 0")).count() == 0


@pytest.mark.parametrize("size", [1.0, 100.0, 1e4])
def test_large_whole_numbers(spark, size):
    """Products beyond 2**53, and with the largest size beyond 64 bits."""
    rows = [(i, [size * 3 ** (i % 7) * 100 * (-1) ** i, size * i * 123.45678, size * (1e5 + i)]) for i in range(60)] + [(60, [size * 1e9, size, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(map(tuple, topk.top_of_embeddings(df).collect())) == brute(rows, {0, 50}, 5)


def test_spread_lengths_are_pruned(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-2, 2)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "LEAST_ROWS", 500)
    assert set(map(tuple, topk.top_of_embeddings(df).collect())) == brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
