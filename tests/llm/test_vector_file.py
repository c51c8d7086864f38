"""Exact top-k search against whole products of Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import vector_file
from barloom.llm.vector_file import LARGEST, LOWEST

COLUMNS = "vec_id long, embedding array<double>, label int, node string, low string, key string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "a", "b", "c", 2) for k, v in rows], COLUMNS).repartition(5)


def plain(rows, k, asked, scale=256):
    good = [(key, [math.floor(x * scale) for x in v]) for key, v in rows
            if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v)]
    out = []
    for i, (key, q) in enumerate(good):
        if not asked(key):
            continue
        scores = []
        for j, (other, c) in enumerate(good):
            if i != j:
                score = min(max(sum(a * b for a, b in zip(q, c)), LOWEST), LARGEST)
                scores.append((-score, other is None, other or 0, other))
        out += [(key, rank + 1, other, -s) for rank, (s, _, _, other) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(df, k=5, **options):
    found = vector_file.top_k(df, F.col("vec_id") % 5 == 0, k, **options)
    return sorted([(r["query"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()], key=str)


def fifth(key):
    return key is not None and key % 5 == 0


def random_rows(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dims) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"cells": 2, "block_rows": 50}, {"cells": 256, "sample_nodes": 40, "block_rows": 333}])
def test_equals_products(spark, options):
    rows = random_rows(700, 12, 1)
    assert got(frame(spark, rows), **options) == plain(rows, 5, fifth)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    hot = [0.5, -0.25, 1.0]
    rows = [(i, hot) for i in range(400)] + [(1000 + i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    rows += [(5, hot), (5, hot), (None, hot), (None, [1.0, 1.0, 1.0]), (2000, None), (2005, [1.0, None, 1.0]), (2010, [math.nan, 0.0, 0.0])]
    rows += [(2015, [math.inf, 0.0, 0.0]), (2020, []), (2025, [1.0]), (2030, [1.0, 2.0, 3.0, 4.0]), (2035, [0.0, 0.0, 0.0])]
    assert got(frame(spark, rows), block_rows=100) == plain(rows, 5, fifth)


def test_near_copies_in_one_cell(spark):
    """Many distinct vectors that all bounds let through."""
    rows = [(i, [1.0, 1.0, i / 256.0]) for i in range(3000)]
    assert got(frame(spark, rows), k=3, cells=4, sample_nodes=10) == plain(rows, 3, fifth)


def test_large_values(spark):
    rows = random_rows(60, 4, 3, 1e9) + [(100 + i, v) for i, (_, v) in enumerate(random_rows(20, 4, 4, 1e30))]
    rows += [(200, [1e200] * 4), (205, [-1e200] * 4), (210, [1e308] * 4)]
    assert got(frame(spark, rows)) == plain(rows, 5, fifth)


def test_few_rows(spark):
    assert got(frame(spark, [(5, [1.0])])) == [] and got(frame(spark, [(5, [1.0])]).limit(0)) == []
    assert got(frame(spark, [(5, [1.0]), (7, [2.0])])) == [(5, 1, 7, 131072)]
    assert got(frame(spark, [(5, []), (7, [])])) == [(5, 1, 7, 0)]
    with pytest.raises(ValueError):
        got(frame(spark, [(5, [1.0])]), cells=300)
