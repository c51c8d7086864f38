"""URL filter by rules and link-graph propagation.

Rules name a host and a path; the longest one that fits a url decides. For urls without a rule, the url's host
decides: personalised PageRank spreads trust from hosts that the rules allow along host edges, and distrust from
hosts they block along reversed edges (who links to a blocked host inherits distrust). A host whose distrust exceeds
`margin` times its trust is blocked.

Host edges are absolute links of the pages, counted per pair of hosts, and edges between a host and the domain above
it, both ways; a host's user and port are no part of its node. Edges are pre-aggregated per pair and hold both
directions' weights; every step is one join of the edges with one row per host and one sum per host, so a hub is
joined to a single row and its edges may be split. Some steps make a round, which is one job: it writes the new values
and finds the largest change, and the round before is removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barloom.llm.text import ascii_lower
from barloom.plans.settle import Rounds, settle

DAMPING = 0.85
#: Largest change of a host's trust or distrust in the last round, as a share of it.
TOLERANCE = 1e-6
#: Changes of values near the smallest double are not looked at.
LEAST = 1e-290
#: Steps of the walk between two tests of the change, and hosts per written file.
STEPS = 5
HOSTS_PER_FILE = 200_000
DOMAIN_WEIGHT = 1.0
MARGIN = 1.0
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def of_host(self, host: Column) -> Column:
        return (host == self.host) | host.endswith("." + self.host)

    def fits(self, host: Column, path: Column) -> Column:
        return self.of_host(host) & path.startswith(self.path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for NULL or without `://`."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def node(host: Column) -> Column:
    """The graph's name for a host: without user and port."""
    return F.regexp_replace(host, r"^[^@]*@|:\d*$", "")


def _first(rules: list[Rule], fits) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, NULL without one; block goes before allow at equal length."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        hit = fits(rule)
        name, verdict = F.when(hit, rule.name).otherwise(name), F.when(hit, rule.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, domain_weight: float = DOMAIN_WEIGHT) -> DataFrame:
    """(src, dst, weight). pages: host, html. Links within a host are left out."""
    pages = pages.where("host <> ''")
    linked = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    linked = linked.select(F.col("host").alias("src"), ascii_lower(node(F.col("to"))).alias("dst"))
    linked = linked.where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select("host").distinct().union(linked.select(F.col("dst").alias("host"))).distinct()
    labels = r"size(split(host, '[.]'))"
    # each host and the domain above it, up to the domain of two labels
    chain = f"transform(sequence(0, {labels} - 3), i -> struct(substring_index(host, '.', i - {labels}) AS low, substring_index(host, '.', i + 1 - {labels}) AS up))"
    steps = hosts.where(f"{labels} > 2").select(F.explode(F.expr(chain)).alias("s")).select("s.low", "s.up").distinct()
    both = steps.select(F.col("low").alias("src"), F.col("up").alias("dst")).union(steps.select(F.col("up").alias("src"), F.col("low").alias("dst")))
    both = both.withColumn("weight", F.lit(float(domain_weight)))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_trust(edges: DataFrame, hosts: DataFrame, rules: list[Rule], damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust), each summing to 1 over all hosts (0 without seeds).

    A host is trusted if the longest rule for its root path allows it, or if it has no such rule but an allowed path
    and no blocked one; it is blocked if the rule for its root path blocks it. The walk restarts at the seeds; what
    ends in hosts without edges goes back to them too, which only rescales the result and is done at the end.

    The walk goes on until no host's value has changed by more than `tolerance` of itself over the last few steps, so a
    host that is reached for the first time keeps it going however far it is from the seeds. Only a caller who gives
    `rounds` (the steps to take) ends it earlier.
    """
    if rounds is None and not (tolerance > 0 and damping < 1):
        raise ValueError("without a number of rounds the tolerance must be above 0 and the damping below 1")
    edges = settle(edges)
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into"))
    shares = settle(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("weight") / F.col("out")).alias("forth"), (F.col("weight") / F.col("into")).alias("back")))
    none = F.lit(0.0)
    ways = shares.select(F.col("src").alias("from"), F.col("dst").alias("to"), "forth", none.alias("back"))
    ways = ways.union(shares.select("dst", "src", none, "back")).groupBy("from", "to").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back"))
    ways = settle(ways)
    nodes = hosts.select("host").union(edges.select(F.col("src").alias("host"))).union(edges.select(F.col("dst").alias("host"))).distinct()
    host = F.col("host")
    _, root = _first(rules, lambda r: r.fits(host, F.lit("/")))
    allowed, blocked = (F.lit(False), F.lit(False))
    for rule in rules:
        if rule.verdict == "allow":
            allowed = allowed | rule.of_host(host)
        else:
            blocked = blocked | rule.of_host(host)
    good = (root == "allow") | (root.isNull() & allowed & ~blocked)
    nodes = nodes.select("host", F.coalesce(good, F.lit(False)).cast("double").alias("good"), F.coalesce(root == "block", F.lit(False)).cast("double").alias("bad"))
    seeds = settle(nodes)
    sums = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-sums["n"] // HOSTS_PER_FILE))
    seed = [F.col(c) / F.lit(sums[c] or 1.0) for c in ("good", "bad")]
    seeds = settle(seeds.select("host", seed[0].alias("good"), seed[1].alias("bad")).coalesce(parts))
    # what every step adds to a host, and the values it starts with
    again = seeds.select("host", ((1 - damping) * F.col("good")).alias("trust"), ((1 - damping) * F.col("bad")).alias("distrust"))
    ranks = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))

    def step(ranks: DataFrame) -> DataFrame:
        sent = ways.join(ranks, F.col("from") == F.col("host"))
        sent = sent.select(F.col("to").alias("host"), (damping * F.col("trust") * F.col("forth")).alias("trust"), (damping * F.col("distrust") * F.col("back")).alias("distrust"))
        return sent.unionByName(again).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))

    change = lambda c: F.abs(F.col(c) - F.col(f"old_{c}")) / F.greatest(F.col(c), F.col(f"old_{c}"), F.lit(LEAST))
    written, done = Rounds(), 0
    while rounds is None or done < rounds:
        old = ranks.select("host", F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust"))
        for _ in range(STEPS if rounds is None else min(STEPS, rounds - done)):
            ranks, done = step(ranks), done + 1
        seen = Observation()
        moved = F.greatest(change("trust"), change("distrust"))
        both = ranks.join(old, "host").observe(seen, F.max(moved).alias("moved"))
        ranks = written.settle(both.select("host", "trust", "distrust").coalesce(parts))
        if (seen.get["moved"] or 0.0) < tolerance:
            break
    sums = ranks.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    return ranks.select("host", *[(F.col(c) / F.lit(sums[c] or 1.0)).alias(c) for c in ("trust", "distrust")])


def judged(df: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html", margin: float = MARGIN) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) for every row of `df`.

    NULL urls and urls without `://` have an empty host and path, fit no rule and are allowed. Hosts without seeds in
    reach have no trust and no distrust and are allowed; so are ties. Pages without html have no links. Repeated rows
    are judged alike, their links count once per row. A host with a port is judged by the trust of its node without
    it. Pages are read whole, however long. The key must not be named like an output; other columns may.
    """
    if key in ("host", "path", "rule", "verdict", "trust", "distrust"):
        raise ValueError(f"key column {key} is named like an output")
    host, path = url_parts(F.col(f"`{url}`"))
    pages = df.select(F.col(f"`{key}`").alias("key"), host.alias("host"), path.alias("path"), F.col(f"`{html}`").alias("html"))
    sites = pages.select(node(F.col("host")).alias("host"), "html")
    edges = settle(host_edges(sites))
    trust = settle(host_trust(edges, sites.where("host <> ''").select("host").distinct(), rules))
    name, verdict = _first(rules, lambda r: r.fits(F.col("host"), F.col("path")))
    narrow = pages.select("key", "host", "path", node(F.col("host")).alias("node"), name.alias("rule"), verdict.alias("by_rule"))
    joined = narrow.join(trust.withColumnRenamed("host", "node"), "node", "left")
    distrusted = F.coalesce(F.col("distrust") > margin * F.col("trust"), F.lit(False))
    method = F.when(distrusted, "block").otherwise("allow")
    return joined.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
