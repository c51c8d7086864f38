"""Label propagation and language evidence against versions over plain lists."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import balanced_shards, language_evidence
from barloom.llm.queries import page_languages


def plain_shards(weights, pairs, draws, start, shards, gain, slack):
    """(shard of each node, share of link weight inside before each round)."""
    shard, report, turn = dict(start), [], 0
    total = sum(weights.values())
    while True:
        held, everything, votes = defaultdict(lambda: [0.0] * shards), Counter(), {}
        for node, hub in pairs:
            held[hub][shard[node]] += weights[node]
            everything[hub] += weights[node]
        for node, hub in pairs:
            mine = votes.setdefault(node, [0.0] * shards)
            for s in range(shards):
                mine[s] += held[hub][s] / everything[hub]
        wish, own, linked, counts = {}, 0.0, 0.0, Counter()
        for node in weights:
            v = votes.get(node)
            here = shard[node]
            wish[node] = v.index(max(v)) if v and max(v) > v[here] + 1e-9 else here
            counts[here, wish[node]] += weights[node]
            if v:
                own += weights[node] * v[here]
                linked += weights[node] * sum(v)
        report.append(own / (linked or 1.0))
        if len(report) > 1 and report[-1] - report[-2] < gain:
            return shard, report
        flows = {ab: float(w) for ab, w in counts.items() if ab[0] != ab[1]}
        if not flows:
            return shard, report
        room = [float(sum(w for (a, _), w in counts.items() if a == s)) for s in range(shards)]
        allowed = balanced_shards._allowed(flows, room, (1 + slack) * total / shards)
        for node, to in wish.items():
            ab = (shard[node], to)
            if ab in flows and draws[turn][node] < min(1.0, allowed[ab] / flows[ab]):
                shard[node] = to
        turn += 1


def test_propagation_equals_a_plain_version(spark):
    rng = random.Random(7)
    weights = {i: rng.choice([1, 1, 1, 4]) for i in range(400)}
    pairs = sorted({(i, (i % 23) * 10 + rng.randrange(4)) for i in weights for _ in range(3)} | {(i, 9999) for i in range(0, 400, 3)})
    nodes = spark.createDataFrame(list(weights.items()), "node long, weight long")
    table = nodes.select("node", F.pmod(F.xxhash64("node", F.lit(balanced_shards.SEED + 1)), F.lit(6)).cast("int"),
                         *[balanced_shards._draw(balanced_shards.SEED + 2 + t) for t in range(60)]).collect()
    start, draws = {r[0]: r[1] for r in table}, [{r[0]: r[2 + t] for r in table} for t in range(60)]
    shard, wanted = plain_shards(weights, pairs, draws, start, 6, 0.005, 0.03)
    seen = []
    got = balanced_shards.propagated(nodes, spark.createDataFrame(pairs, "node long, hub long").repartition(5), 6, report=seen)
    assert {r["node"]: r["shard"] for r in got.collect()} == shard
    assert np.allclose(seen, wanted) and len(seen) > 3 and seen[-1] > seen[0] + 0.1
    with pytest.raises(ValueError):
        balanced_shards.propagated(nodes, nodes.select("node", F.lit(1).alias("hub")), gain=0.0)


def test_short_lines_count_where_asked(spark):
    texts = spark.createDataFrame([(1, "ab\nlong enough to be a line"), (2, "ab\nother"), (3, None)], "node long, text string")
    assert balanced_shards.memberships(texts).count() == 0
    assert balanced_shards.memberships(texts, 0).count() == 2


def fused(rows, model, strength=language_evidence.STRENGTH, smooth=language_evidence.SMOOTH):
    """(language, probability, text language) of rows (text, declared, host, suffix)."""
    classes = [*model.languages, "und"]
    k = len(classes)
    scores = [[*model.scores(t.encode()), 0.0] if t and t.strip() else None for t, *_ in rows]
    best = [None if s is None else int(np.argmax(s)) for s in scores]
    whole = np.array([sum(b == c for b in best) for c in range(k)]) + smooth
    whole = whole / whole.sum()

    def counted(values):
        out = defaultdict(lambda: np.zeros(k))
        for v, b in zip(values, best, strict=True):
            if v is not None:
                out[v] += [b == c for c in range(k)]
        return out

    hosts = counted([r[2] for r in rows])
    site, top = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    sites, tops = defaultdict(lambda: np.zeros(k)), defaultdict(lambda: np.zeros(k))
    for h, n in hosts.items():
        sites[site(h)] += n
        tops[top(h)] += n
    smoothed = lambda n, p: (n + strength * p) / (n.sum() + strength)
    prior = {h: smoothed(n, smoothed(sites[site(h)], smoothed(tops[top(h)], whole))) for h, n in hosts.items()}

    def likelihood(values):
        table = counted(values)
        totals = sum(table.values(), np.zeros(k)) + smooth * len(table)
        return {v: np.log((n + smooth) / totals) for v, n in table.items()}

    declared, suffix = likelihood([r[1] for r in rows]), likelihood([r[3] for r in rows])
    out = []
    for (_, d, h, s), score, b in zip(rows, scores, best, strict=True):
        logs = np.log(prior.get(h, whole)) + declared.get(d, 0.0) + suffix.get(s, 0.0) + (0.0 if score is None else np.array(score))
        at = int(np.argmax(logs))
        out.append((classes[at], 1.0 / np.exp(logs - logs[at]).sum(), None if b is None else classes[b]))
    return out


def test_documents_equal_a_plain_posterior(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"], r["lang"], f"{rng.choice('ab')}.{r['source']}.org", rng.choice(["org", "de", None])) for r in docs.collect()]
    rows += [(9000, None, "de", None, None), (9001, " \n", None, "a.b.org", "fr"), (9002, "zzzz qqqq xxxx", "en", None, None), (None, "und so weiter", None, None, "de")]
    rows += [(9100 + i, rows[0][1], "fr", "hot.site.org", "org") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, end string")
    model = language_evidence.fit_text_model(frame)
    found = language_evidence.identified(frame, declared=F.col("lang"), host=F.col("host"), suffix=F.col("end"), model=model)
    got = {r["row"]["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for row, (language, probability, by_text) in zip(rows, fused([(t, d, h, s) for _, t, d, h, s in rows], model), strict=True):
        r = got[row[0]]
        assert (r["language"], r["text_language"]) == (language, by_text)
        assert math.isclose(r["probability"], probability, rel_tol=1e-6)
        assert r["accepted"] == (by_text is not None and language != "und")


def test_a_hot_text_is_one_of_the_sample(spark):
    rows = [(f"deutscher text nummer {i} und noch mehr", "de") for i in range(200)] + [("the same english text", "en")] * 3000 + [(f"another english text {i}", "en") for i in range(50)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    once = spark.createDataFrame(sorted(set(rows)), "text string, lang string")
    a, b = (language_evidence.fit_text_model(f, sample_rows=10_000) for f in (frame, once))
    assert np.array_equal(a.ratios, b.ratios)


def test_pages_equal_a_plain_posterior(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in page_languages(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    rows = []
    for p in pages:
        html, url = p["html"] or "", p["url"] or ""
        lang = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", html)
        bare = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", html)
        host = re.match(r"[^:/?#]*://([^/?#:]+)", url)
        host = host[1].lower() if host else None
        rows.append((re.sub(r"<[^>]*>", " ", bare), lang[1].lower() if lang else None, host, host.split(".")[-1] if host else None))
    frame = spark.createDataFrame([(t, d) for t, d, _, _ in rows], "text string, lang string")
    model = language_evidence.fit_text_model(frame)
    for p, row, (language, probability, by_text) in zip(pages, rows, fused(rows, model), strict=True):
        r = got[p["page_id"]]
        assert (r["host"], r["suffix"], r["declared"]) == (row[2], row[3], row[1])
        assert (r["language"], r["text_language"]) == (language, by_text)
        assert math.isclose(r["probability"], probability, rel_tol=1e-6)
