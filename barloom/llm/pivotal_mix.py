"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; each of its documents wants target / source size copies. The whole part
is taken as it is. The fractional parts are rounded dependently: two documents at a time exchange mass, one becomes
0 or 1, the other carries the rest on, so that the words taken stay the same and every document keeps its expected
number of copies. What is left of a group is at most one fractional document.

Groups are hash chunks of a source, however large the source; their leftovers are grouped again, `FAN_IN` at a
time, until one document per source is left, whose coin is thrown. A source therefore misses its target by less than
the words of one document. All chances come from a hash of the document, so reruns agree, whatever the partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.ranks import global_rank
from barloom.llm.text import packed, unpacked, word_count
from barloom.plans.settle import settle

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
CHUNK_ROWS = 4096
FAN_IN = 1024
SEED = 17


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_rows, target). rows: source, size. Sources in code point order, NULL last, take the
    weights in turn and divide `share` of all words; a target stops at `most` times the source's words and the excess
    is divided again by weight until none is above."""
    sums = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    ranked = global_rank(sums, F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(turn, F.pmod("rank", F.lit(len(weights))).cast("int")))
    ranked = settle(ranked.withColumn("most", F.col("source_size") * F.lit(float(most))))
    total = share * float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(full, F.col("most"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            level = float("inf")
            break
        before, level = level, (total - (row["held"] or 0.0)) / row["open"]
        if level <= before:
            break
    target = F.least(F.col("most"), F.lit(level) * F.col("weight")) if level < float("inf") else F.col("most")
    return ranked.select("source", "source_size", "n_rows", target.alias("target"))


def _round_group(size: np.ndarray, part: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded parts, and the position that stays fractional (-1: none). Words taken stay the same."""
    out = part.copy()
    held = -1
    for i in range(len(out)):
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        ratio = size[i] / size[held]
        up = min(1.0 - out[held], out[i] * ratio)  # held gains `up`, i loses up / ratio
        down = min(out[held], (1.0 - out[i]) * ratio)
        if chance[i] * (up + down) < down:
            rest = (out[held] + up, out[i] - up / ratio)
            whole_held = up == 1.0 - out[held]
            ends = (1.0, 0.0)
        else:
            rest = (out[held] - down, out[i] + down / ratio)
            whole_held = down == out[held]
            ends = (0.0, 1.0)
        if whole_held:
            out[held], out[i] = ends[0], min(max(rest[1], 0.0), 1.0)
            held = i if 0.0 < out[i] < 1.0 else -1
        else:
            out[i], out[held] = ends[1], min(max(rest[0], 0.0), 1.0)
            held = held if 0.0 < out[held] < 1.0 else -1
    return out, held


def _rounded(last: bool):
    def rounded(table):
        table = table.sort_by([("chance", "ascending"), ("mark", "ascending"), ("size", "ascending")])
        chance = table.column("chance").to_numpy()
        out, held = _round_group(table.column("size").to_numpy().astype(float), table.column("part").to_numpy(), chance)
        if last and held >= 0:
            out[held] = 1.0 if chance[held] < out[held] else 0.0
            held = -1
        left = np.zeros(len(out), bool)
        if held >= 0:
            left[held] = True
        names = table.column_names
        table = table.set_column(names.index("part"), "part", pa.array(out, pa.float64()))
        return table.set_column(names.index("left"), "left", pa.array(left))

    return rounded


def kind_copies(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """`rows` without repetition, with source_size, target, `alike` (how many rows are equal) and `copies`, the times
    that these are taken in all. Rows equal in every column are one row that wants `alike` times the copies, so a
    chunk holds each kind once."""
    targets = settle(source_targets(rows, weights, share, most).withColumnRenamed("source", "of"))
    kinds = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("alike"))
    wide = kinds.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    want = F.when(F.col("size") > 0, want * F.col("alike")).otherwise(0.0)
    whole = F.floor(want)
    chance = F.pmod(F.xxhash64("key", "mark", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    wide = wide.select("*", whole.cast("long").alias("whole"), (want - whole).alias("part"), chance.alias("chance"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / CHUNK_ROWS)).cast("long")
    wide = wide.select("*", F.pmod(F.xxhash64("key", "mark", F.lit(seed + 1)), chunks).alias("chunk"), F.lit(True).alias("left"))
    largest = targets.agg(F.max(F.ceil(F.col("n_rows") / CHUNK_ROWS))).first()[0] or 1
    done, open_ = [], wide
    while True:
        last = largest <= 1
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in open_.schema.fields])
        # NULL and the empty text are different sources, and grouping keeps them apart
        level = settle(open_.groupBy("source", "chunk").applyInArrow(_rounded(last), schema))
        done.append(level.where(~F.col("left")))
        if last:
            break
        open_ = level.where("left").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        largest = -(-largest // FAN_IN)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    names = [*rows.columns, "source_size", "target", "alike"]
    return result.select(*names, (F.col("whole") + F.round("part").cast("long")).alias("copies"))


def _share(number: Column) -> Column:
    """Copies of one of `alike` rows, numbered from 0: they differ by one at most."""
    return F.floor(F.col("copies") / F.col("alike")) + (number < F.col("copies") % F.col("alike")).cast("long")


def copies(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The columns of `rows` (key, mark, size, source) with source_size, target and `copies`, the times it is taken.

    `mark` tells documents with equal keys apart and orders ties. Documents without words are taken 0 times. Rows
    equal in every column share the copies of their kind evenly. NULL is a source of its own.
    """
    kinds = settle(kind_copies(rows, weights, share, most, seed))
    parts = kinds.withColumn("block", F.explode(F.expr(f"sequence(0L, (alike - 1) div {CHUNK_ROWS})")))
    if (kinds.agg(F.max("alike")).first()[0] or 1) > CHUNK_ROWS:  # the rows of a large kind are made in many tasks
        parts = parts.repartition("key", "mark", "block")
    number = F.expr(f"sequence(block * {CHUNK_ROWS}, least(alike, (block + 1) * {CHUNK_ROWS}) - 1)")
    each = parts.withColumn("number", F.explode(number))
    return each.select(*rows.columns, "source_size", "target", _share(F.col("number")).alias("copies"))


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The narrow rows that `copies` works on: words of the text, its source, and a hash of the text as mark."""
    cols = [F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("mark"), word_count(f"`{text}`").alias("size"), F.col(f"`{source}`").alias("source")]
    return df.select(*cols)


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix with the columns of `df`, each repeated as often as it is taken.

    Rows alike in key, text and source are one kind: the kind is taken as often as all its rows are, its rows equally
    often or once more, and each keeps its own other columns. Which of them are taken once more follows the order in
    which they are stored. NULL texts have no words and are not taken. Columns of any name are carried along.
    """
    kind = F.struct("key", "mark", "source").alias("kind")
    taken = settle(kind_copies(settle(sized(df, key, text, source)), **options).where("copies > 0").select(kind, "alike", "copies"))
    rows = packed(df, kind=F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("mark"), F.col(f"`{source}`").alias("source")))
    if (taken.agg(F.max("alike")).first()[0] or 1) > 1:
        # numbered in the blocks they are written in: no window holds more of a kind than one task wrote
        rows = settle(rows.withColumn("block", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())).join(taken, "kind")
        blocks = rows.groupBy("kind", "block").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("kind").orderBy("block")) - F.col("n")
        blocks = blocks.select(F.col("kind").alias("of"), F.col("block").alias("in"), before.alias("before"))
        inside = F.row_number().over(Window.partitionBy("kind", "block").orderBy("at")) - 1
        numbers = rows.select("kind", "block", "at", inside.alias("inside")).join(blocks, (F.col("kind") == F.col("of")) & (F.col("block") == F.col("in")))
        numbers = settle(numbers.select(F.col("at").alias("here"), (F.col("before") + F.col("inside")).alias("number")))
        rows = rows.join(numbers, F.col("at") == F.col("here"))
    else:
        rows = rows.join(taken, "kind").withColumn("number", F.lit(0))
    rows = rows.withColumn("times", _share(F.col("number"))).where("times > 0")
    return unpacked(rows.withColumn("copy", F.explode(F.expr("sequence(1, times)"))))
