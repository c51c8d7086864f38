"""Sharding by balanced label propagation.

Nodes are distinct texts, weighted by their documents; two texts are linked if they share a line. Links are kept as
memberships (text, line), never as pairs: per round, each line sums the weights of its texts per shard (one row of
`shards` numbers), and each text adds up the rows of its lines. A text moves to the shard that holds most of its
neighbours if that holds more than its own.

Quotas: for each two shards only as much weight moves one way as moves the other way, plus what the shard has room
for. Who moves is decided by a hash of the text. At the end documents are ranked inside their shard; those beyond
the shard's share fill the free places of the others, so counts differ by one at most.

A hot text is one node, a hot line one row after map-side combining. Such rows are written before they are joined
back to their documents or texts, so both sides of the join are plain exchanges and AQE may split the hot one.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.ranks import global_rank
from barloom.plans.settle import Rounds, settle

SHARDS = 16
#: Rounds go on while the share of link weight inside shards grows by this much.
GAIN = 0.005
#: Shorter lines make no link; 0 takes all lines.
MIN_LINE = 20
#: Room above an even share while texts move; the last step is exact whatever it is.
SLACK = 0.03
SEED = 23


def memberships(rows: DataFrame, min_line: int = MIN_LINE) -> DataFrame:
    """(node, hub): distinct texts with the lines of at least `min_line` characters that they share with others.
    rows: node, text."""
    long_lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= min_line)
    lines = F.array_distinct(F.transform(long_lines, lambda x: F.xxhash64(x, F.lit(SEED))))
    texts = rows.where("text IS NOT NULL").select("node", F.explode(lines).alias("hub")).distinct()
    pairs = settle(texts)
    shared = settle(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hub"))
    return pairs.join(shared, "hub")


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _allowed(flows: dict[tuple[int, int], float], held: list[float], room: float) -> dict[tuple[int, int], float]:
    """Weight that may move between each two shards: as much as moves back, and what fits below `room`."""
    allowed = {(a, b): min(w, flows.get((b, a), 0.0)) for (a, b), w in flows.items()}
    for b in range(len(held)):
        more = {ab: w - allowed[ab] for ab, w in flows.items() if ab[1] == b}
        total, free = sum(more.values()), max(0.0, room - held[b])
        for ab, w in more.items():
            allowed[ab] += w * min(1.0, free / total) if total else 0.0
    return allowed


def propagated(
    nodes: DataFrame, pairs: DataFrame, shards: int = SHARDS, gain: float = GAIN, slack: float = SLACK,
    rounds: int | None = None, report: list[float] | None = None,
) -> DataFrame:
    """(node, weight, shard) by balanced label propagation. nodes: node, weight; pairs: node, hub.

    A round is the last one if the share of link weight that stays inside shards grew by less than `gain` since the one
    before, or if no text wants to move; only a caller who gives `rounds` ends it earlier. `report` takes that share
    before each round.
    """
    if rounds is None and not gain > 0:
        raise ValueError("without a number of rounds the gain must be above 0")
    pairs = settle(pairs)
    start = F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.lit(shards)).cast("int")
    state = settle(nodes.select("node", "weight", start.alias("shard")))
    total = state.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    per_shard = [F.sum(F.when(F.col("shard") == s, F.col("weight")).otherwise(0)).cast("double") for s in range(shards)]
    written, turn, inside = Rounds(), 0, None
    while rounds is None or turn < rounds:
        hubs = pairs.join(state, "node").groupBy("hub").agg(F.array(*per_shard).alias("held"), F.sum("weight").cast("double").alias("all"))
        # a line's word counts by how few texts share it
        hubs = settle(hubs.select("hub", F.transform("held", lambda x: x / F.col("all")).alias("held")))
        rows = pairs.join(hubs, "hub")
        votes = rows.groupBy("node").agg(F.array(*[F.sum(F.col("held")[s]) for s in range(shards)]).alias("votes"))
        best = F.array_max("votes")
        to = (F.array_position("votes", best) - 1).cast("int")
        own = F.get("votes", F.col("shard"))
        linked = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x)
        wish = state.join(votes, "node", "left").select("node", "weight", "shard", F.when(best > own + 1e-9, to).otherwise(F.col("shard")).alias("to"), own.alias("own"), linked.alias("linked"))
        wish = settle(wish)
        # one row for each two shards
        sums = [F.sum("weight").alias("w"), *(F.sum(F.coalesce(F.col("weight") * F.col(c), F.lit(0.0))).alias(c) for c in ("own", "linked"))]
        moves = wish.groupBy("shard", "to").agg(*sums).collect()
        counts = {(r["shard"], r["to"]): float(r["w"]) for r in moves}
        before, inside = inside, sum(r["own"] for r in moves) / (sum(r["linked"] for r in moves) or 1.0)
        if report is not None:
            report.append(inside)
        if rounds is None and before is not None and inside - before < gain:
            break
        held = [sum(w for (a, _), w in counts.items() if a == s) for s in range(shards)]
        flows = {ab: w for ab, w in counts.items() if ab[0] != ab[1]}
        if not flows:
            break
        allowed = _allowed(flows, held, (1 + slack) * total / shards)
        chance = [x for (a, b), w in flows.items() for x in (F.lit(a * shards + b), F.lit(min(1.0, allowed[a, b] / w)))]
        goes = _draw(SEED + 2 + turn) < F.coalesce(F.create_map(*chance)[F.col("shard") * shards + F.col("to")], F.lit(0.0))
        state = written.settle(wish.select("node", "weight", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        turn += 1
    return state


def placed(rows: DataFrame, state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The columns of `rows` (with node and key) and shard, slot: counts per shard differ by one at most, slots are
    gapless from 0. Documents of one text stay next to each other, so few texts are torn at the edges."""
    near = rows.join(state.select("node", "shard"), "node")
    ranked = settle(global_rank(near, "shard", F.xxhash64("node", F.lit(SEED)), "node", "key"))
    counts = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [counts.get(s, 0) for s in range(shards)]
    n = sum(counts)
    share = [n // shards + (s < n % shards) for s in range(shards)]
    if n:
        # the larger shares go to the shards that hold most, so that fewer documents move
        for s, most in zip(sorted(range(shards), key=lambda s: -counts[s]), sorted(share, reverse=True), strict=True):
            share[s] = most
    before = list(accumulate(counts, initial=0))
    extra = list(accumulate((max(0, c - q) for c, q in zip(counts, share, strict=True)), initial=0))
    free = list(accumulate((max(0, q - c) for c, q in zip(counts, share, strict=True)), initial=0))
    at = lambda values: F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("shard"))
    slot = F.col("rank") - at(before[:-1])
    over = slot - at(share) + at(extra[:-1])  # place among all documents that move
    to, seat = F.lit(0), F.lit(0).cast("long")
    for s in range(shards):
        inside = (over >= free[s]) & (over < free[s + 1])
        to, seat = F.when(inside, s).otherwise(to), F.when(inside, over - free[s] + counts[s]).otherwise(seat)
    stays = slot < at(share)
    cols = [F.col(c) for c in rows.columns]
    return ranked.select(*cols, F.when(stays, F.col("shard")).otherwise(to).cast("int").alias("shard"), F.when(stays, slot).otherwise(seat).alias("slot"))


def assigned(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, min_line: int = MIN_LINE, gain: float = GAIN) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row.

    NULL texts count as empty. Texts without a shared line stay where their hash puts them. A text with more
    documents than a shard holds is spread over several. Repeated rows take a slot each; ties go by key.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body, F.lit(SEED)).alias("node"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = settle(rows)
    texts = df.select(F.xxhash64(body, F.lit(SEED)).alias("node"), body.alias("text"))
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    state = propagated(nodes, memberships(texts, min_line), shards, gain)
    out = placed(rows, state, shards)
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")
