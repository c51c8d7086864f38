"""Merkle manifest of a table: one tree per group of rows, one tree over the groups' roots, a proof for every row.

A node is the hash of up to `run` consecutive nodes below it. Ranks are written as digits to the base `run`; inside a
bounded block of ranks the digit columns are grouped away one after another, last digit first, and every grouping
nests the child structs in their parent. A block is then one row that holds its whole subtree, and the blocks' roots
are the next tier's leaves. On the way down a transform per digit opens the nested structs and hands every child its
siblings, and explode emits rows with their proofs. What the tiers above know reaches a block by a union and a
grouping by block; nothing is joined to the leaves, and no group is larger than a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.settle import settle

RUN = 2
BLOCK_ROWS = 1024
#: A step of a proof: the siblings before and after a node, as hex text.
STEP = "struct<before: string, after: string>"


def H(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return H(F.concat(*[field(v) for v in values]))


@dataclass(frozen=True)
class Shape:
    """Children of a node, and digits per block."""

    run: int = RUN
    block_rows: int = BLOCK_ROWS

    def __post_init__(self):
        if self.run < 2 or self.block_rows < self.run:
            raise ValueError("a node has two or more children and a block holds at least one full node")

    @property
    def digits(self) -> int:
        count = 1
        while self.run ** (count + 1) <= self.block_rows:
            count += 1
        return count

    @property
    def block(self) -> int:
        return self.run**self.digits


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds `rank` within the group (0-based, by `order`) and `n`, the group's rows.

    Rows are range-sorted and written; a row's rank is its place in its sort partition's part of the group plus the
    parts before it. Equal rows are spread by their place in the input, so that a hot row fills no single partition.
    """
    tie = F.xxhash64(F.monotonically_increasing_id()).alias("_tie")
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = settle(rows.select("*", tie).orderBy(*keys, "_tie").select("*", F.monotonically_increasing_id().alias("_place")).drop("_tie"))
    part = F.shiftright("_place", 33).alias("_part")
    counts = placed.groupBy(group, part).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    counts = settle(counts.select(F.col(group).alias("_g"), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n")))
    joined = placed.select("*", part).alias("r").join(counts.alias("c"), F.col(f"r.{group}").eqNullSafe(F.col("c._g")) & (F.col("r._part") == F.col("c._part")))
    return joined.select(*[f"r.{c}" for c in rows.columns], (F.col("_place") + F.col("_shift")).alias("rank"), "n")


def _up(nodes: DataFrame, shape: Shape, digits: int) -> DataFrame:
    """Blocks (g, block, n, top): `top` nests every node of the block, and `n` counts the group's blocks.

    nodes: g, rank, n, h, item. A group's only node is its root and not hashed again.
    """
    run, block = shape.run, shape.run**digits
    names = [f"d{i}" for i in range(digits)]
    digit = [f"cast(pmod(floor(rank / {run**i}), {run}) as int) as {c}" for i, c in enumerate(names)]
    level = nodes.selectExpr("g", f"floor(rank / {block}) as block", "n", *digit, "named_struct('h', h, 'item', item) as node").repartition("g", "block")
    sql = "{level}"
    for i, name in enumerate(names):
        rest = ", ".join(["g", "block", "n", *names[i + 1 :]])
        found = f"array_sort(collect_list(named_struct('d', {name}, 'node', node)), (a, b) -> a.d - b.d)"
        # the group's only node at this level is handed up
        h = f"if(ceil(n / {run**i}) = 1, kids[0].h, sha2(array_join(transform(kids, k -> k.h), ''), 256))"
        sql = f"(SELECT {rest}, named_struct('h', {h}, 'kids', kids) AS node FROM (SELECT {rest}, transform({found}, f -> f.node) AS kids FROM {sql} GROUP BY {rest}))"
    return nodes.sparkSession.sql(f"SELECT g, block, ceil(n / {block}) AS n, node AS top FROM {sql}", level=level)


def _down(blocks: DataFrame, digits: int) -> DataFrame:
    """(g, item, h, path, above): every node of the blocks with its steps up to its root; blocks: g, top, above."""
    opened = f"array(named_struct('node', top, 'path', cast(array() AS array<{STEP}>)))"
    for i in range(digits):
        at, kid = f"at{i}", f"kid{i}"
        kids = f"{at}.node.kids"
        side = lambda start, length: f"array_join(transform(slice({kids}, {start}, {length}), k -> k.h), '')"
        step = f"named_struct('before', {side('1', 'i')}, 'after', {side('i + 2', f'size({kids})')})"
        # a node that was handed up is its parent: there is no step
        path = f"if({kid}.h = {at}.node.h, {at}.path, concat(array({step}), {at}.path))"
        opened = f"flatten(transform({opened}, {at} -> transform({kids}, ({kid}, i) -> named_struct('node', {kid}, 'path', {path}))))"
    found = blocks.selectExpr("g", "above", f"explode({opened}) as at")
    return found.selectExpr("g", "at.node.item as item", "at.node.h as h", "concat(at.path, above.path) as path", "above")


@dataclass(frozen=True)
class Tier:
    blocks: DataFrame
    digits: int


def _tiers(nodes: DataFrame, shape: Shape) -> list[Tier]:
    """Blocks of every tier, up to the one where each group is a single block; nodes are written."""
    most, tiers = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        digits = 1
        while digits < shape.digits and shape.run**digits < most:
            digits += 1
        blocks = settle(_up(nodes, shape, digits))
        tiers.append(Tier(blocks, digits))
        most = -(-most // shape.run**digits)
        if most <= 1:
            return tiers
        nodes = blocks.selectExpr("g", "block as rank", "n", "top.h as h", "block as item")


def _told(tiers: list[Tier], above: DataFrame) -> DataFrame:
    """`_down` of the lowest tier; above: (g, above) with one row per group."""
    known = above.selectExpr("g", "0L as block", "above")
    for number, tier in reversed(list(enumerate(tiers))):
        both = tier.blocks.select("g", "block", "top").unionByName(known, allowMissingColumns=True)
        both = both.groupBy("g", "block").agg(F.first("top", ignorenulls=True).alias("top"), F.first("above", ignorenulls=True).alias("above"))
        found = _down(both, tier.digits)
        if number:
            known = found.selectExpr("g", "item as block", "named_struct('path', path, 'subroot', above.subroot, 'root', above.root) as above")
    return found


def folded(path: Column, start: Column) -> Column:
    """The root that a proof's steps make of a leaf."""
    return F.aggregate(path, start, lambda h, s: H(F.concat(s["before"], h, s["after"])))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, from the leaf up, left to right."""
    return H(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(df: DataFrame, fields: tuple[str, ...], key: str = "doc_id", group: str = "lang", found: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """(key, leaf, found, path, subroot, root) for every row of `df`.

    `leaf` is the hash of the row's `fields`; `path` proves it: `folded(path, leaf)` is `root`. `found` is the hash the
    row is checked by (the leaf, unless given as an expression over the columns of `df`). Leaves of a group ascend by
    key, a NULL key first; equal keys by leaf, so repeated rows have a proof each. NULL is a group of its own and the
    first; groups ascend bytewise. A lone leaf is its group's root, a lone group's root the root. An empty table has
    no rows. Only the named columns and those of `found` are read, whatever the others are called.
    """
    own = leaf(*[F.col(f"`{c}`") for c in fields])
    rows = df.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{key}`").alias("key"), own.alias("leaf"), (own if found is None else found).alias("found"))
    # a leaf that is as expected is stored once
    rows = settle(rows.select("g", "key", "leaf", F.when(F.col("found") != F.col("leaf"), F.col("found")).alias("found")))
    leaves = settle(ranked(rows, "g", "key", "leaf").select("g", "rank", "n", F.col("leaf").alias("h"), F.struct("key", "found").alias("item")))
    tiers = _tiers(leaves, shape)
    roots = ranked(tiers[-1].blocks.select(F.lit(0).alias("all"), F.col("g").alias("group"), F.col("top.h").alias("h")), "all", "group")
    upper = _tiers(roots.select(F.col("all").alias("g"), "rank", "n", "h", F.col("group").alias("item")), shape)
    none = F.expr(f"cast(array() AS array<{STEP}>)")
    start = upper[-1].blocks.select("g", F.struct(none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("top.h").alias("root")).alias("above"))
    groups = _told(upper, start)
    each = F.struct("path", F.col("h").alias("subroot"), F.col("above.root").alias("root")).alias("above")
    proofs = _told(tiers, settle(groups.select(F.col("item").alias("g"), each)))
    return proofs.select(F.col("item.key").alias(key), F.col("h").alias("leaf"), F.coalesce("item.found", "h").alias("found"), "path", "above.subroot", "above.root")
