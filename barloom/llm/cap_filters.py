"""Near-duplicate vectors by spherical-cap filters (locality-sensitive filtering with random product codes).

A filter is a direction made of one random code word per block of coordinates; a vector belongs to every filter whose
inner product with it exceeds the cap height. The product structure lets a vector list all its filters without
looking at the others: block by block, prefixes that cannot reach the height any more are cut (list decoding).
Vectors that share a filter are candidates and are verified by their cosine in double precision.

- Cap height and number of filters follow from the number of vectors: a filter holds about `load` unrelated vectors,
  and a pair at exactly the cosine asked for shares `common` filters on average; closer pairs share more. Filters of
  one product code stand or fall together, so they come from `tables` independent codes: measured on pairs at the
  cosine itself, where it is highest, at most 0.0005 of them share no filter (tests/llm/test_near_duplicates.py).
- Equal vectors are one node with a weight, so copies cost one row however many there are.
- A filter with many vectors is dealt out by hash into chunks, and pairs of chunks are compared in separate cells:
  neither a task nor a row holds a whole hot filter.
- A pair that shares several filters counts in the smallest one only: each entry carries the vector's smaller
  filters. Cells give link counts per vector and a spanning forest, never pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.components import connected, forest
from barloom.llm.text import slices
from barloom.plans.settle import settle

COSINE = 0.9
COMMON = 45.0
LOAD = 0.1
BLOCKS = 3
TABLES = 40
SEED = 7
CHUNK = 512
GROUP_ROWS = 4000
LEAST_DIMS = 12


@dataclass(frozen=True)
class CapCode:
    """Random product codes, `tables` of them, for vectors of `dims` coordinates."""

    dims: int
    words: int
    height: float
    tables: int = TABLES
    blocks: int = BLOCKS
    seed: int = SEED

    @property
    def width(self) -> int:
        return -(-max(self.dims, LEAST_DIMS) // self.blocks)

    def filters(self, units: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector, over all tables."""
        step = max(1, (1 << 15) // self.words)
        out: list[np.ndarray] = []
        for at in range(0, len(units), step):
            part = units[at : at + step]
            found = [self._decode(part, t) for t in range(self.tables)]
            owner, number = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((number, owner))
            out += np.split(number[order], np.searchsorted(owner[order], np.arange(1, len(part))))
        return out

    def _decode(self, units: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for every filter of one table above the height: words are added block by block, and a
        prefix is dropped when even the best later words cannot lift it to the height."""
        turned = (units @ _rotation(self.dims, self.width * self.blocks, self.seed + 2 * table)).reshape(len(units), self.blocks, self.width)
        scores = np.einsum("nbw,bkw->nbk", turned, _code(self.blocks, self.words, self.width, self.seed + 2 * table), optimize=True)
        best = scores.max(axis=2)
        later = best[:, ::-1].cumsum(axis=1)[:, ::-1] - best
        owner, number, total = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
        for b in range(self.blocks):
            sums = total[:, None] + scores[owner, b]
            parent, word = np.nonzero(sums >= (self.height - later[owner, b])[:, None])
            owner, number, total = owner[parent], number[parent] * self.words + word, sums[parent, word]
        return owner, number + table * self.words**self.blocks


@lru_cache(maxsize=64)
def _rotation(dims: int, full: int, seed: int) -> np.ndarray:
    """Spreads a vector evenly over the blocks; short vectors are padded with zeros, which keeps cosines."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(full, full)))
    return np.ascontiguousarray(turn[:dims])


@lru_cache(maxsize=64)
def _code(blocks: int, words: int, width: int, seed: int) -> np.ndarray:
    code = np.random.default_rng(seed + 1).normal(size=(blocks, words, width))
    return code / (np.linalg.norm(code, axis=2, keepdims=True) * np.sqrt(blocks))


def _cap(height: float, dims: int) -> float:
    """Share of the unit sphere above `height`."""
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - t * t, 0) ** ((dims - 3) / 2)
    return float(density[t >= height].sum() / density.sum())


def _both(height: float, cosine: float, dims: int) -> float:
    """Share of the unit sphere above `height` as seen from both of two vectors at `cosine`."""
    axis = np.linspace(-1, 1, 2001)
    x, y = np.meshgrid(axis, axis)
    density = np.maximum(1 - x * x - y * y, 0) ** ((dims - 4) / 2) * (x * x + y * y < 1)
    inside = (x >= height) & (cosine * x + np.sqrt(1 - cosine * cosine) * y >= height)
    return float(density[inside].sum() / density.sum())


def plan_code(n: int, dims: int, cosine: float = COSINE, common: float = COMMON, load: float = LOAD, tables: int = TABLES, blocks: int = BLOCKS, seed: int = SEED) -> CapCode:
    full = -(-max(dims, LEAST_DIMS) // blocks) * blocks
    target = load / max(n, 64)
    low, high = 0.0, 0.999
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if _cap(middle, full) > target else (low, middle)
    count = common / tables / max(_both(low, cosine, full), 1e-15)
    return CapCode(dims, max(2, ceil(count ** (1 / blocks))), low, tables, blocks, seed)


def _valid(vector: Column) -> Column:
    """Vectors that have a direction: some component not zero, none NULL or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(~odd & some, F.lit(False))


def _units(vectors, dims: int) -> np.ndarray:
    """Unit vectors in double precision."""
    flat = np.asarray(vectors, np.float64).reshape(-1, dims)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # norms of very large or small vectors stay finite
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _coded(codes: dict[int, CapCode], kind: str):
    def coded(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            vectors = batch.column("vector").to_pylist()
            plain = [np.asarray(v, kind).tobytes() for v in vectors]
            lists = [b""] * len(vectors)
            by_dims: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dims.setdefault(len(v), []).append(i)
            for dims, rows in by_dims.items():
                block = _units([vectors[i] for i in rows], dims)
                for i, found in zip(rows, codes[dims].filters(block), strict=True):
                    lists[i] = found.astype("<i8").tobytes()
            out = [pa.array(plain, pa.binary()), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("dims"), *out], names=["node", "dims", "plain", "filters"])

    return coded


def _listed(batches):
    """One row per vector and filter."""
    for batch in batches:
        lists = [np.frombuffer(x, "<i8") for x in batch.column("filters").to_pylist()]
        sizes = [len(x) for x in lists]
        node = np.repeat(batch.column("node").to_numpy(), sizes)
        dims = np.repeat(batch.column("dims").to_numpy(), sizes)
        place = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]) if lists else np.empty(0, np.int32)
        found = np.concatenate(lists) if lists else np.empty(0, np.int64)
        names = ["dims", "filter", "node", "place"]
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(found, pa.int64()), pa.array(node, pa.int64()), pa.array(place, pa.int32())], names=names)


def _shared(smaller: list[np.ndarray]) -> np.ndarray:
    """Which pairs of lists have a number in common."""
    sizes = [len(x) for x in smaller]
    values, place, count = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    often = count[place] > 1
    member = np.zeros((len(smaller), int((count > 1).sum())), np.float32)
    member[np.repeat(np.arange(len(smaller)), sizes)[often], column[place[often]]] = 1
    return member @ member.T > 0


def _compare(cosine: float, kind: str):
    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dims", "filter", "a", "b"], ignore_index=True)
        keys = rows[["dims", "filter", "a", "b"]].to_numpy()
        starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(rows)]])
        node, weight, part = (rows[c].to_numpy() for c in ("node", "weight", "part"))
        plain, filters, place = rows["plain"].tolist(), rows["filters"].tolist(), rows["place"].to_numpy()
        found = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            dims, _, a, b = keys[s]
            block = _units(np.frombuffer(b"".join(plain[s:e]), kind), dims)
            linked = block @ block.T >= cosine
            np.fill_diagonal(linked, False)
            if a != b:
                side = part[s:e] == a
                linked &= side[:, None] != side[None, :]
            if not linked.any():
                continue
            linked &= ~_shared([np.frombuffer(f, "<i8")[:p] for f, p in zip(filters[s:e], place[s:e], strict=True)])
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            root = forest(e - s, i, j)
            links = linked @ weight[s:e]
            some = np.nonzero(links)[0]
            found.append((node[s:e][some], links[some], node[s:e][root[some]]))
        columns = zip(*found, strict=True) if found else [[np.empty(0, np.int64)]] * 3
        return pd.DataFrame({k: np.concatenate(list(c)) for k, c in zip(("node", "links", "root"), columns, strict=True)})

    return compared


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, common: float = COMMON, chunk: int = CHUNK) -> DataFrame:
    """(key, n_links, component): links to other rows at `cosine` or more, and the smallest key reachable over them.

    A vector that is NULL, empty, all zero, or holds a NULL, NaN or infinite component links with nothing and is its
    own component. Vectors of different lengths do not link. Every row counts as a vector: a repeated row links with
    its copy. Rows with a NULL key take part; a component is NULL only if all its keys are. Only the two named
    columns are read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    good = rows.where(_valid(F.col("vector")))
    nodes = good.groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("low"))
    nodes = settle(nodes.select("*", F.size("vector").alias("dims"), F.monotonically_increasing_id().alias("node")))
    counts = {r["dims"]: r["n"] for r in nodes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per vector length
    codes = {d: plan_code(n, d, cosine, common) for d, n in counts.items()}
    kind = "<f4" if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else "<f8"
    # vectors are sent to the tasks that compare them in their own type and made unit vectors in double precision there
    spread = nodes.select("node", "dims", F.col("vector").cast("array<double>").alias("vector")).repartition("node")
    coded = settle(spread.mapInArrow(_coded(codes, kind), "node long, dims int, plain binary, filters binary"))
    entries = settle(coded.select("node", "dims", "filters").mapInArrow(_listed, "dims int, filter long, node long, place int"))
    sizes = settle(entries.groupBy("dims", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    total = sizes.agg(F.coalesce(F.sum(F.col("size") * chunks), F.lit(0))).first()[0]  # a row goes to a cell per chunk
    parts = entries.join(sizes, ["dims", "filter"]).withColumn("chunks", chunks)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("chunks")).cast("int"))
    cells = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("dims", "filter", "node", "place", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    smaller = F.expr("substring(filters, 1, place * 8)").alias("filters")
    vectors = settle(coded.drop("dims").join(nodes.select("node", "weight"), "node"))
    cells = cells.join(vectors, "node").select("dims", "filter", "a", "b", "part", "node", "weight", "place", "plain", smaller)
    slot = F.pmod(F.xxhash64("dims", "filter", "a", "b"), F.lit(max(1, -(-total // GROUP_ROWS)))).alias("slot")
    found = settle(cells.select("*", slot).groupBy("slot").applyInPandas(_compare(cosine, kind), "node long, links long, root long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = connected(found.select("node", "root").distinct(), "node", "root")
    full = nodes.join(linked, "node", "left").join(part, "node", "left")
    full = settle(full.select("vector", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("part")))
    first = settle(full.groupBy("part").agg(F.min("low").alias("component")))
    named = settle(full.join(first, "part").select("vector", "n_links", "component"))
    joined = good.join(named, "vector").select(F.col("key").alias(key), "n_links", "component")
    alone = rows.where(~_valid(F.col("vector"))).select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return joined.unionByName(alone)
