"""Hot buckets and filters: no group of rows grows with them, and links are still found."""

import itertools
import uuid

import numpy as np
import pandas as pd
import pytest

from barloom.llm import bit_simhash, cap_filters
from barloom.llm.components import connected


@pytest.mark.parametrize("count", [20_000, 50_000])
def test_groups_of_a_hot_bucket_are_bounded(spark, monkeypatch, count):
    """Cells of at most two chunks are dealt to groups by hash: a group's rows do not grow with the bucket."""
    fps = np.random.default_rng(1).permutation(1 << 16)[:count].astype(np.int64)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps}))

    def counting(radius):
        return lambda rows: pd.DataFrame({"a": [len(rows)], "b": [0]})

    monkeypatch.setattr(bit_simhash, "_compare", counting)
    sizes = [r["a"] for r in bit_simhash.near_links(nodes).collect()]
    assert sum(sizes) > 10 * len(fps) and max(sizes) <= 3 * bit_simhash.GROUP_ROWS


def test_a_hot_bucket_is_compared_whole(spark):
    """Every pair of these differs in two bits at most, so all are one component through any chunk."""
    fps = sorted({(1 << a) | (1 << b) for a, b in itertools.product(range(40), repeat=2)} | {1 << a for a in range(40)})
    links = connected(bit_simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), chunk=16).distinct()).collect()
    assert {r["component"] for r in links} == {fps[0]} and len(links) == len(fps) - 1


def test_groups_of_a_hot_filter_are_bounded(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.05 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    folder = str(tmp_path)

    def counting(cosine, kind):
        def compared(group: pd.DataFrame) -> pd.DataFrame:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(len(group)))
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")

        return compared

    monkeypatch.setattr(cap_filters, "_compare", counting)
    assert cap_filters.near_vectors(df).count() == len(rows)
    sizes = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert sum(sizes) > 10 * len(rows) and max(sizes) <= 4 * cap_filters.GROUP_ROWS
