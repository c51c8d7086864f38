"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprint: one bit per position, set if more than half of the shingles' 64-bit hashes have it set.
2. Equal fingerprints are one node, so a group of exact copies of any size costs one row.
3. Candidates: two fingerprints at `radius` or fewer differing bits agree in at least `blocks - radius` of `blocks`
   bit blocks, so each choice of that many blocks is a bucket key. Nothing within the radius is missed. More blocks
   mean longer keys; their number follows from the number of distinct fingerprints.
4. Buckets beyond `chunk` rows are dealt out by hash into chunks, and pairs of chunks are compared in separate cells.
5. In a cell the fingerprints stand as 64 bit planes, 64 fingerprints to a machine word. A query's distances to 64
   others are updated plane by plane with carry-save counters, and a word is abandoned once all its lanes exceed
   the radius. Only a spanning forest of the links found leaves the cell.
6. Components by alternating stars.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.components import connected, forest
from barloom.llm.text import slices, utf8
from barloom.plans.settle import settle

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
CHUNK = 4096
#: Rows dealt to one group of cells, on average.
GROUP_ROWS = 30_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Queries times words that are compared at once.
JOBS = 1 << 18
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of a text given as UTF-8: words, ASCII lower-cased, in shingles of `width`, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, view = xxhash.xxh64_intdigest, joined
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        cut = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts[cut].tolist(), ends[cut].tolist(), strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed long. NULL, empty and blank texts have fingerprint 0."""

    def hashed(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            values = np.array([fingerprint(t, width) for t in batch.column("bytes").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values, pa.int64())], names=["key", "fp"])

    rows = df.select(F.col(f"`{key}`").alias("key"), utf8(f"`{text}`").alias("bytes"))
    schema = T.StructType([rows.schema["key"], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(hashed, schema)


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that must agree, as signed longs: the fewest blocks whose keys leave about 32 of `n` random
    fingerprints to a bucket."""
    want = min(max(8.0, log2(max(n, 1)) - 5), 40.0)
    blocks = next(k for k in range(radius + 1, BITS + 1) if BITS * (k - radius) // k >= want or comb(k, radius) > 200)
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(parts[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint i is bit i % 64 of word i // 64 in plane b."""
    words = -(-len(fp) // BITS)
    bits = np.zeros((words * BITS, BITS), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _lanes(low: np.ndarray, high: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bits of `word` that stand for positions low <= p < high."""
    a = np.clip(low - word * BITS, 0, BITS)
    b = np.clip(high - word * BITS, 0, BITS)
    below = lambda k: np.where(k >= BITS, ONES, (np.uint64(1) << np.minimum(k, BITS - 1).astype(np.uint64)) - np.uint64(1))
    return below(b) & ~below(a)


def near_pairs(fp: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int = RADIUS):
    """Yields arrays (i, j): every position low[i] <= j < high[i] whose fingerprint is within `radius` bits of fp[i]."""
    planes = _planes(fp)
    width = radius.bit_length()
    start = (1 << width) - 1 - radius  # the counter overflows when it reaches 2^width: at radius + 1 differing bits
    first, last = low // BITS, (np.maximum(high, low + 1) - 1) // BITS
    spans = np.where(high > low, last - first + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(spans)])
    at = 0
    while at < len(fp):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + JOBS, side="right")) - 1)
        query = np.repeat(np.arange(at, end), spans[at:end])
        word = first[query] + np.arange(len(query)) - (cuts[query] - cuts[at])
        at = end
        over = ~_lanes(low[query], high[query], word)
        counter = [np.full(len(query), ONES if start >> k & 1 else 0, np.uint64) for k in range(width)]
        mine = fp[query]
        for bit in range(BITS):
            carry = planes[bit, word] ^ (np.uint64(0) - ((mine >> np.uint64(bit)) & np.uint64(1)))
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if bit % 8 == 7:
                open_ = over != ONES
                if not open_.all():
                    query, word, over, mine = query[open_], word[open_], over[open_], mine[open_]
                    counter = [c[open_] for c in counter]
        if len(query):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            job, lane = np.nonzero(hit)
            yield query[job], word[job] * BITS + lane


def _compare(radius: int):
    """Spanning forest of the links inside each cell of a group."""

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        side = (rows["part"].to_numpy() != a).astype(np.int64)
        order = np.lexsort((side, b, a, rows["bucket"].to_numpy(), rows["mask"].to_numpy()))
        rows, a, b, side = rows.iloc[order], a[order], b[order], side[order]
        fp = np.ascontiguousarray(rows["fp"].to_numpy(np.int64)).view(np.uint64)
        bucket, mask = rows["bucket"].to_numpy(), rows["mask"].to_numpy()
        n = len(fp)
        change = (bucket[1:] != bucket[:-1]) | (mask[1:] != mask[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.concatenate([[0], np.nonzero(change)[0] + 1])
        lengths = np.diff(np.concatenate([starts, [n]]))
        ends = np.repeat(starts + lengths, lengths)
        fronts = np.repeat(np.add.reduceat(1 - side, starts), lengths) + np.repeat(starts, lengths)
        same = a == b
        low = np.where(same, np.arange(n) + 1, np.where(side == 0, fronts, n))
        high = np.where(same | (side == 0), ends, n)
        low = np.minimum(low, high)
        # one fingerprint may stand in several cells of the group: its first place speaks for it
        values, place = np.unique(fp, return_inverse=True)
        root = np.arange(len(values))
        for i, j in near_pairs(fp, low, high, radius):  # links are folded as they come, never held together
            root = forest(len(values), root[place[i]], root[place[j]])[root]
        moved = np.nonzero(root != np.arange(len(values)))[0]
        return pd.DataFrame({"a": values[moved].view(np.int64), "b": values[root[moved]].view(np.int64)})

    return linked


def near_links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column `fp`) that connect all within `radius` bits."""
    n = nodes.count()
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(n, radius)])
    entries = nodes.select("fp", F.posexplode(masks).alias("mask", "bits")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("bucket"))
    sizes = settle(entries.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    total = sizes.agg(F.coalesce(F.sum(F.col("size") * chunks), F.lit(0))).first()[0]  # a row goes to a cell per chunk
    parts = entries.join(sizes, ["mask", "bucket"]).withColumn("chunks", chunks)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("fp", "mask"), F.col("chunks")).cast("int"))
    cells = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("fp", "mask", "bucket", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    slots = max(1, -(-total // GROUP_ROWS))
    slot = F.pmod(F.xxhash64("mask", "bucket", "a", "b"), F.lit(slots)).alias("slot")
    return cells.select("*", slot).groupBy("slot").applyInPandas(_compare(radius), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(key, fp, component): the smallest key reachable over links of `radius` or fewer differing bits.

    NULL, empty and blank texts share fingerprint 0, which links like any other. Rows with a NULL key take part;
    component is NULL only if all keys of the component are. Repeated rows give repeated rows. Only `key` and `text`
    are read, so other columns may have any name.
    """
    rows = settle(fingerprints(df, key, text, width))
    nodes = settle(rows.groupBy("fp").agg(F.min("key").alias("low")))
    parts = settle(connected(near_links(nodes.select("fp"), radius).distinct()))
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    named = settle(named)
    first = settle(named.groupBy("part").agg(F.min("low").alias("component")))
    found = settle(named.join(first, "part").select("fp", "component"))
    return rows.join(found, "fp").select(F.col("key").alias(key), "fp", "component")


def fingerprint_text(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
