"""Exact top-k search by inner product with a vector-approximation file.

Vectors are whole numbers: floor(scale * x) of each component. Equal vectors are one node. Every coordinate is cut
into cells between marks (quantiles of a sample; the ends of the cells come from all vectors), and a node's
approximation is one byte of cell number per coordinate. The ends bound an inner product from both sides.

A block of nodes is scanned by approximations only: the k-th best lower bound is a threshold, and nodes whose upper
bound reaches it are read exactly, best bound first, until no bound left reaches the k-th exact score. The result does
not depend on marks, cells, blocks or the sample: a poor sample only makes more vectors be read.

The stated query set meets all nodes, in blocks: a task holds one block and streams the queries past it, and only k
results per query and block leave it.
"""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.settle import settle

SCALE = 256
CELLS = 64
#: The marks are taken from about this many nodes.
SAMPLE_NODES = 20_000
BLOCK_ROWS, LEAST_BLOCK = 1 << 18, 1 << 12
#: Queries that one task streams past its block.
QUERY_ROWS = 1 << 20
#: Nodes and queries whose bounds are computed at once, and exact vectors read at once for a query.
SLICE, BATCH, READ = 1 << 13, 256, 16
#: Below this sums of products of whole numbers are exact in double precision.
EXACT = float(1 << 52)
LOWEST, LARGEST = -(1 << 63), (1 << 63) - 1


def _scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: x.cast("double") * float(scale))


def _finite(v: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False))


def _packed(kind: str):
    """Whole numbers of each vector as bytes."""

    def made(batches):
        for batch in batches:
            column = batch.column("v")
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False)).astype(kind)
            at = column.offsets.to_numpy()
            at = at - at[0]
            plain = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), pa.array(plain, pa.binary())], names=["key", "row", "plain"])

    return made


def _matrix(plain: list[bytes], kind: str, dims: int) -> np.ndarray:
    """One row per vector; shorter vectors are padded with zeros."""
    size = np.dtype(kind).itemsize
    lengths = np.array([len(p) // size for p in plain], np.int64)
    out = np.zeros((len(plain), dims), kind)
    out[np.arange(dims) < lengths[:, None]] = np.frombuffer(b"".join(plain), kind)
    return out


@dataclass(frozen=True)
class Grid:
    """Marks between the cells of each coordinate, and middle and half width of each cell."""

    kind: str
    marks: np.ndarray
    middle: np.ndarray | None = None
    half: np.ndarray | None = None

    @property
    def dims(self) -> int:
        return len(self.marks)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(vectors.shape, np.uint8)
        for d, marks in enumerate(self.marks):
            out[:, d] = np.searchsorted(marks, vectors[:, d].astype(np.float64), side="right")
        return out


def _coded(grid: Grid):
    def made(batches):
        for batch in batches:
            codes = grid.cells(_matrix(batch.column("plain").to_pylist(), grid.kind, grid.dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "code"])

    return made


def _ends(grid: Grid):
    """Least and largest value in each cell of the nodes a task reads: at most one row per coordinate and cell."""

    def made(batches):
        low, high = np.full((grid.dims, 256), np.inf), np.full((grid.dims, 256), -np.inf)
        for batch in batches:
            vectors = _matrix(batch.column("plain").to_pylist(), grid.kind, grid.dims).astype(np.float64)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, grid.dims)
            for d in range(grid.dims):
                np.minimum.at(low[d], codes[:, d], vectors[:, d])
                np.maximum.at(high[d], codes[:, d], vectors[:, d])
        d, c = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, c, low[d, c], high[d, c])], names=["d", "c", "low", "high"])

    return made


class Block:
    """Approximations and exact vectors of a block of nodes."""

    def __init__(self, grid: Grid, k: int, parts: list[pa.RecordBatch]):
        self.grid, self.k = grid, k
        table = pa.Table.from_batches(parts)
        self.nodes = table.column("node").to_numpy()
        self.low = table.column("low").to_numpy()
        self.codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, grid.dims)
        self.exact = _matrix(table.column("plain").to_pylist(), grid.kind, grid.dims)

    def _read(self, rows: np.ndarray, query: np.ndarray, small: bool) -> list[int]:
        """Exact scores; those beyond 64 bits count as the ends of that range."""
        if small:
            return (self.exact[rows].astype(np.float64) @ query).astype(np.int64).tolist()
        whole = [int(q) for q in query]
        sums = [sum(int(x) * q for x, q in zip(v, whole, strict=True)) for v in self.exact[rows].tolist()]
        return [min(max(s, LOWEST), LARGEST) for s in sums]

    def search(self, queries: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(-score, low, node) of the k best nodes of each query, in this order."""
        best: list[list] = [[] for _ in queries]
        floor = np.full(len(queries), -np.inf)
        size = np.abs(queries)
        every = np.arange(self.grid.dims)
        for at in range(0, len(self.nodes), SLICE):
            codes = self.codes[at : at + SLICE]
            middle, half = self.grid.middle[every, codes], self.grid.half[every, codes]
            reach = (np.abs(middle) + half).max(initial=0.0) * size.max(initial=0.0) * max(self.grid.dims, 1)
            small = bool(reach < EXACT)
            with np.errstate(over="ignore", invalid="ignore"):
                centre, spread = queries @ middle.T, size @ half.T
                if not small:  # rounding, and products beyond a double
                    spread = spread + (size @ np.abs(middle).T + spread) * 1e-9
                upper, lower = centre + spread, centre - spread
            if not small:
                upper, lower = np.nan_to_num(upper, nan=np.inf), np.nan_to_num(lower, nan=-np.inf)
                upper, lower = np.maximum(upper, float(LOWEST)), np.minimum(lower, float(LARGEST))
            if len(codes) >= self.k:
                floor = np.maximum(floor, np.partition(lower, len(codes) - self.k, axis=1)[:, len(codes) - self.k])
            hit = upper >= floor[:, None]
            for i in np.flatnonzero(hit.any(axis=1)):
                rows = np.flatnonzero(hit[i])
                rows = rows[np.argsort(-upper[i, rows], kind="stable")]
                found = best[i]
                for start in range(0, len(rows), READ):
                    some = rows[start : start + READ]
                    if upper[i, some[0]] < floor[i]:
                        break
                    for row, score in zip(some + at, self._read(some + at, queries[i], small), strict=True):
                        entry = (-score, int(self.low[row]), int(self.nodes[row]))
                        if len(found) < self.k or entry < found[-1]:
                            insort(found, entry)
                            del found[self.k :]
                    if len(found) == self.k:
                        floor[i] = max(floor[i], float(-found[-1][0]) if small else np.nextafter(float(-found[-1][0]), -np.inf))
        return best


def _scan(grid: Grid, k: int):
    def answers(block: Block | None, queries: list[tuple[int, bytes]]):
        if block is None or not queries:
            return
        found = block.search(_matrix([p for _, p in queries], grid.kind, grid.dims).astype(np.float64))
        rows = [(q, n, low, -s) for (q, _), best in zip(queries, found, strict=True) for s, low, n in best]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query", "node", "low", "score"])

    def made(batches):
        cell, parts, block, waiting = None, [], None, []
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("block", "part", "asks")), strict=True))
            cuts = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)] if cells else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                *place, asks = cells[a]
                if place != cell:
                    yield from answers(block, waiting)
                    cell, parts, block, waiting = place, [], None, []
                run = batch.slice(a, b - a)
                if not asks:  # the nodes of a cell come first
                    parts.append(run)
                    continue
                if block is None and parts:
                    block, parts = Block(grid, k, parts), []
                waiting += zip(run.column("node").to_pylist(), run.column("plain").to_pylist(), strict=True)
                while len(waiting) >= BATCH:
                    yield from answers(block, waiting[:BATCH])
                    waiting = waiting[BATCH:]
        yield from answers(block, waiting)

    return made


def _fitted(nodes: DataFrame, n: int, dims: int, kind: str, cells: int, sample_nodes: int) -> Grid:
    some = nodes.select("plain").sample(min(1.0, sample_nodes / max(n, 1)), seed=11).limit(2 * sample_nodes).collect()
    sample = _matrix([bytes(r["plain"]) for r in some], kind, dims).astype(np.float64)
    if not len(some):
        return Grid(kind, np.zeros((dims, 0)))
    shares = np.arange(1, cells) / cells
    return Grid(kind, np.quantile(sample, shares, axis=0, method="inverted_cdf").T.copy())


def top_k(
    df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    cells: int = CELLS, block_rows: int | None = None, sample_nodes: int = SAMPLE_NODES,
) -> DataFrame:
    """(query, rank, key, score): the k rows with the highest inner products for each row of `df` that `queries`
    (a condition on its columns) marks, over all rows but the query's own; fewer if there are fewer.

    Keys are integers. Ties go to the smaller key, a NULL key last. Vectors that are NULL or hold a NULL, NaN or
    infinite component, also after scaling, take no part; a shorter vector counts as padded with zeros, an empty one
    scores 0. Scores beyond 64 bits count as the ends of that range. A repeated row is a row of its own: it is found
    by its copy. Only the two columns and those of the condition are read.
    """
    if not 1 <= cells <= 256:
        raise ValueError("a cell number is one byte")
    spark = df.sparkSession
    scaled = _scaled(F.col(f"`{vector}`"), scale)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(queries, F.lit(False)).alias("asked"), scaled.alias("v")).where(_finite(F.col("v")))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims, largest = max(size[0] or 0, 1), size[1] or 0.0
    kind = "<i2" if largest < 32_000 else "<i4" if largest < 2e9 else "<f8"
    lean = rows.select(F.struct("key", "asked").alias("key"), "row", "v")
    plain = settle(lean.mapInArrow(_packed(kind), "key struct<key: long, asked: boolean>, row long, plain binary").select("key.*", "row", "plain"))

    # equal vectors: the k + 1 smallest keys are all that any query can need
    same = Window.partitionBy("plain").orderBy(F.col("key").asc_nulls_last(), "row")
    members = plain.drop("asked").withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    members = settle(members.withColumn("node", F.min(F.struct("place", "row")).over(Window.partitionBy("plain"))["row"]))
    nodes = members.where("place = 1").select("node", F.coalesce("key", F.lit(LARGEST)).alias("low"), "plain")
    n = nodes.count()
    asked = settle(plain.where("asked").drop("asked").join(nodes.select("node", "plain"), "plain").drop("plain"))
    asking = settle(nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "plain"))

    grid = _fitted(nodes, n, dims, kind, cells, sample_nodes)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_rows = block_rows or min(max(-(-n // width), LEAST_BLOCK), BLOCK_ROWS)
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-asking.count() // QUERY_ROWS))
    kept = settle(nodes.mapInArrow(_coded(grid), "node long, low long, plain binary, code binary"))
    ends = kept.select("plain", "code").mapInArrow(_ends(grid), "d long, c long, low double, high double")
    ends = ends.groupBy("d", "c").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row per coordinate and cell
    middle, half = np.zeros((dims, 256)), np.zeros((dims, 256))
    for d, c, low, high in ends:
        middle[d, c], half[d, c] = low / 2 + high / 2, high / 2 - low / 2
    grid = Grid(kind, grid.marks, middle, half)

    spread = lambda name, by, count: F.pmod(F.xxhash64(F.col(name), F.lit(by)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    stored = kept.select(spread("node", 1, blocks).alias("block"), every(parts).alias("part"), F.lit(False).alias("asks"), "node", "low", "plain", "code")
    nothing = (F.lit(0).cast("long").alias("low"), "plain", F.lit(b"").alias("code"))
    sent = asking.select(every(blocks).alias("block"), spread("node", 2, parts).alias("part"), F.lit(True).alias("asks"), "node", *nothing)
    cells_ = stored.unionByName(sent).repartition("block", "part").sortWithinPartitions("block", "part", "asks")
    found = cells_.mapInArrow(_scan(grid, k + 1), "query long, node long, low long, score long")

    first = Window.partitionBy("query").orderBy(F.desc("score"), "low", "node")
    found = settle(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select("query", "node", "score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "row")
    each = found.join(members.select("node", "key", "row"), "node").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "key", "row", "score"))).alias("hits"))
    lists = settle(lists.withColumnRenamed("query", "node"))
    others = F.slice(F.filter("hits", lambda h: h["row"] != F.col("row")), 1, k)
    out = asked.join(lists, "node").select(F.col("key").alias("query"), F.posexplode(others).alias("pos", "hit"))
    return out.select("query", (F.col("pos") + 1).alias("rank"), F.col("hit.key").alias(key), F.col("hit.score").alias("score"))
