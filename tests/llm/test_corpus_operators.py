"""URL verdicts, sharding, mixing, site lines, the n-gram model and the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import balanced_shards, kneser_ney, link_trust, pivotal_mix, site_lines
from barloom.llm.queries import RULES
from barloom.llm.text import unpacked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, kind string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", 1, "b", "c") for i, t, s in rows], DOCS)


def test_url_parts(spark):
    urls = {"HTTPS://Ä.Ex.COM/A/b?c://d#e": ("Ä.ex.com", "/A/b"), "http://h": ("h", ""), "http://h?x/y": ("h", ""), "http://h#/y": ("h", ""), "no": ("", ""), None: ("", ""), "://": ("", ""), "a://b://c/d": ("b:", "//c/d"), "": ("", "")}
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r["u"]: (r["h"], r["p"]) for r in frame.select("u", *[c.alias(n) for c, n in zip(link_trust.url_parts(F.col("u")), "hp", strict=True)]).collect()}
    assert got == urls


def dense_rank(n, edges, seeds, rounds):
    step = np.zeros((n, n))
    for (a, b), w in edges.items():
        step[a, b] = w / sum(x for (s, _), x in edges.items() if s == a)
    rank = seeds
    for _ in range(rounds):
        rank = 0.15 * seeds + 0.85 * rank @ step
    return rank / rank.sum()


def test_trust_against_dense_matrices(spark):
    rng = random.Random(2)
    names = [f"h{i}.org" for i in range(8)] + [f"h{i}.com" for i in range(8)] + [f"h{i}.net" for i in range(4)]
    edges = {(a, b): float(rng.randint(1, 4)) for a in range(20) for b in rng.sample(range(20), 3) if a != b}
    frame = spark.createDataFrame([(names[a], names[b], w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    got = {r["host"]: r for r in link_trust.host_trust(frame, frame.select(F.col("src").alias("host")), RULES, rounds=12).collect()}
    good = np.array([n.endswith("org") for n in names]) / 8
    bad = np.array([n.endswith("net") for n in names]) / 4
    trust, distrust = dense_rank(20, edges, good, 12), dense_rank(20, {(b, a): w for (a, b), w in edges.items()}, bad, 12)
    for i, n in enumerate(names):
        assert math.isclose(got[n]["trust"], trust[i], abs_tol=1e-12) and math.isclose(got[n]["distrust"], distrust[i], abs_tol=1e-12)


def test_url_verdicts(spark):
    link = lambda host: f'<a HREF = "https://User@{host}:80/x">'
    pages = [
        (1, "http://a.org/fr/x", link("b.com")), (2, "http://a.net/x", None), (3, "http://x.example.net/en/1", ""), (4, "http://www.example.com/de/1", ""),
        (5, "http://b.com/x", "<p>"), (6, "http://spam.com/x", link("a.net") * 3), (7, None, "x"), (8, "nothing", link("a.net")), (9, "http://lone.io/", ""), (None, "http://spam.com/x", ""), (2, "http://a.net/x", None), (10, "http://a.net", ""),
    ]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, verdict string")
    got = sorted((tuple(r)[:5] for r in link_trust.judged(df, RULES).collect()), key=str)
    want = [
        (1, "a.org", "/fr/x", "org/fr/", "allow"), (2, "a.net", "/x", "net/", "block"), (2, "a.net", "/x", "net/", "block"), (3, "x.example.net", "/en/1", "example.net/en/", "allow"),
        (4, "www.example.com", "/de/1", "example.com/de/", "block"), (5, "b.com", "/x", None, "allow"), (6, "spam.com", "/x", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "lone.io", "/", None, "allow"), (None, "spam.com", "/x", None, "block"), (10, "a.net", "", None, "block"),
    ]
    assert got == sorted(want, key=str)
    assert link_trust.judged(df.limit(0), RULES).count() == 0


def test_shards_are_even_and_cut_few_links(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join([f"a line that all of topic {i % 40} share", *(f"topic {i % 40} line number {rng.randrange(30)}" for _ in range(3)), f"own line of document {i}"]), "s") for i in range(2000)]
    rows += [(5000 + i, "one text that a third of all documents repeat", "s") for i in range(1000)] + [(None, None, None), (1, "", "s"), (9000, "word " * 50_000, "s"), (9000, "word " * 50_000, "s")]
    got = balanced_shards.assigned(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["doc_id"], r["size"]) for r in got if r["doc_id"] in (None, 9000)} == {(None, 1), (9000, 250_001)}
    shard = {r["doc_id"]: r["shard"] for r in got}

    def cut(of):
        topics = [Counter(of(i) for i in range(2000) if i % 40 == t) for t in range(40)]
        return 1 - sum(sum(n * (n - 1) for n in t.values()) for t in topics) / sum(sum(t.values()) * (sum(t.values()) - 1) for t in topics)

    assert cut(lambda i: shard[i]) < 0.7 * cut(lambda i: hash(str(i)) % 16)
    assert balanced_shards.assigned(frame(spark, rows).limit(0)).count() == 0


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def mix_rows():
    rng = random.Random(6)
    sources = ["b", "a", "é", "", None, "z\U0001f600", "z\uffff"]
    rows = [(i, "w " * rng.randrange(1, 60), rng.choices(sources, (9, 3, 1, 2, 1, 1, 1))[0]) for i in range(1500)]
    return rows + [(None, "x y", "a"), (7000, None, "a"), (7001, "  ", None), (7002, "v " * 3000, "b"), (3, "q q", "b"), (3, "q q", "b"), (3, "r", "b"), (8000, None, "empty")]


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(pivotal_mix, "CHUNK_ROWS", 50)
    monkeypatch.setattr(pivotal_mix, "FAN_IN", 4)
    rows = mix_rows()
    docs = frame(spark, rows)
    got = pivotal_mix.copies(pivotal_mix.sized(docs)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, largest = plain_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert r["copies"] in (0, 1, 2) and (r["size"] > 0 or r["copies"] == 0)
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    again = pivotal_mix.copies(pivotal_mix.sized(docs.repartition(13))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mixed_documents(spark):
    docs = frame(spark, mix_rows())
    counts = Counter()
    for r in pivotal_mix.copies(pivotal_mix.sized(docs)).collect():
        counts[r["key"], r["source"], r["size"]] += r["copies"]
    out = pivotal_mix.mixed(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in out.collect())
    assert got == +counts
    assert pivotal_mix.mixed(docs.limit(0)).count() == 0


def test_rounding_keeps_sums_and_expectations():
    rng = np.random.default_rng(4)
    size, part = rng.integers(1, 50, 30).astype(float), rng.random(30)
    mean = np.zeros(30)
    for _ in range(3000):
        out, held = pivotal_mix._round_group(size, part, rng.random(30))
        assert math.isclose((out * size).sum(), (part * size).sum(), rel_tol=1e-9)
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != held)
        mean += out / 3000
    assert np.abs(mean - part).max() < 0.05


def plain_lines(rows, ratio, least):
    ident = lambda x: x.strip(" \t\x0b\x0c\r")
    pages, on = Counter(), Counter()
    for _, t, s in rows:
        if s is not None:
            pages[s] += 1
            for line in {ident(x) for x in t.split("\n")} if t is not None else ():
                on[s, line] += 1
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (s is not None and ident(x) and on[s, ident(x)] >= least and on[s, ident(x)] > ratio * pages[s])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_site_lines(spark):
    rng = random.Random(8)
    lines = ["menu", " menu\t", "", "  ", "footer é", *(f"line {i}" for i in range(30))]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6))), rng.choice(["a", "a", "a", "b", None, ""])) for i in range(300)]
    rows += [(None, "menu", "a"), (400, None, "a"), (401, "menu\nmenu", "solo"), (402, "x " * 100_000 + "\nmenu", "a"), (3, "menu", "a"), (3, "menu", "a")]
    docs = frame(spark, rows)
    out = site_lines.without_site_lines(docs, max_ratio=0.15, min_pages=4)
    got = [tuple(r) for r in out.select("row.doc_id", "clean", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=str) == plain_lines(rows, 0.15, 4)
    assert unpacked(out).columns == docs.columns
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert site_lines.without_site_lines(docs.limit(0)).count() == 0


class PlainKneserNey:
    """The same model from its definition, over dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            tokens = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
            self.words.update(tokens)
            self.pairs.update(zip(["<s>", *tokens], tokens, strict=False))
        self.before = Counter(w for _, w in self.pairs)
        self.d2, self.d1 = self.discounts(self.pairs.values()), self.discounts(self.before.values())
        self.after = defaultdict(dict)
        for (v, w), c in self.pairs.items():
            self.after[v][w] = c

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), k) if n[k] else 0.0 for k in (1, 2, 3)]

    def lower(self, w):
        total = sum(self.before.values())
        if not total:
            return 1.0
        spare = sum(self.d1[min(c, 3) - 1] for c in self.before.values()) / total
        c = self.before.get(w, 0)
        return (max(c - self.d1[min(c, 3) - 1], 0) / total if c else 0.0) + spare / (len(self.words) + 1)

    def probability(self, v, w):
        after = self.after.get(v)
        if not after:
            return self.lower(w)
        total, c = sum(after.values()), after.get(w, 0)
        held = sum(self.d2[min(x, 3) - 1] for x in after.values()) / total
        return (max(c - self.d2[min(c, 3) - 1], 0) / total if c else 0.0) + held * self.lower(w)

    def score(self, text):
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), None]
        return sum(math.log10(self.probability(v, w)) for v, w in zip(["<s>", *tokens], tokens, strict=False))

    def base(self, text):
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), None]
        n, v = sum(self.words.values()), len(self.words)
        return len(tokens), sum(t in self.words for t in tokens), sum(math.log10((self.words[t] + 1) / (n + v + 1)) for t in tokens)


def ngram_texts():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(400)]
    return [*texts, None, "", " \n", "A b A", "a B a", texts[0], texts[0], "hot pair " * 3000]


def test_ngram_model_against_its_definition(spark):
    texts = ngram_texts()
    docs = frame(spark, [(i if i else None, t, "s") for i, t in enumerate(texts)])
    train = docs.where("doc_id IS NULL OR doc_id % 3 <> 1")
    model = kneser_ney.fit(train.repartition(5), shard_bytes=2000)
    plain = PlainKneserNey([t for i, t in enumerate(texts) if i == 0 or i % 3 != 1])
    assert model.tokens == sum(plain.words.values()) and model.types == len(plain.words)
    assert np.allclose(model.pair_discounts, plain.d2) and np.allclose(model.word_discounts, plain.d1)
    got = {r["doc_id"]: r for r in kneser_ney.scored(docs, model).collect()}
    for i, t in enumerate(texts):
        r, (n, known, base) = got[i if i else None], plain.base(t)
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], plain.score(t), rel_tol=1e-9)
    held = [r for r in got.values() if r["doc_id"] and r["doc_id"] % 3 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_ngram_probabilities_sum_to_one():
    plain = PlainKneserNey(ngram_texts())
    for v in ("<s>", "w1", "hot", "nowhere"):
        total = sum(plain.probability(v, w) for w in plain.words) + plain.probability(v, "unseen")
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_ngram_edges(spark):
    docs = frame(spark, [(1, "a b", "s"), (2, None, "s")])
    empty = kneser_ney.fit(docs.limit(0))
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in kneser_ney.scored(docs, empty).orderBy("doc_id").collect()] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert kneser_ney.scored(docs.limit(0), empty).count() == 0
    with pytest.raises(ValueError):
        kneser_ney.mounted("hdfs://name/folder")


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain counterpart on its own input; the last stage's rows are those of run()."""
    from test_near_duplicates import brute_components

    raw = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(None, None, "en", "src1", 0), (700, "", None, None, 0), (0, raw.where("doc_id = 0").first()["text"], "fr", "src0", 1), (701, raw.where("doc_id = 2").first()["text"], "en", None, 1)], raw.schema)
    raw.union(extra).union(raw.where("doc_id = 0")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sets = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == raw.columns
        out.write.parquet(f"{tmp_path}/{number}")
        sets.append((docs, docs := spark.read.schema(out.schema).parquet(f"{tmp_path}/{number}")))
    rows = [([(r["doc_id"], r["text"], r["source"]) for r in a.collect()], [(r["doc_id"], r["text"], r["source"]) for r in b.collect()]) for a, b in sets]
    before, after = rows[0]
    assert Counter(after) == Counter(r for r in before if r[1])  # every clean document stays
    before, after = rows[1]
    assert sorted(((i, t) for i, t, _ in after), key=str) == sorted(((i, t) for i, t, _, _ in plain_lines(before, site_lines.MAX_RATIO, site_lines.MIN_PAGES)), key=str)
    before, after = rows[2]
    parts = {(i, c) for i, _, c in brute_components([(i, t) for i, t, _ in before])}
    assert sorted(i for i, _, _ in after) == sorted(i for i, c in parts if i == c)
    before, after = rows[3]
    want = plain_targets(sum((Counter({s: len((t or "").split())}) for _, t, s in before), Counter()))
    taken = sum((Counter({s: len(t.split())}) for _, t, s in after), Counter())
    largest = max(len((t or "").split()) for _, t, _ in before)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(i for i, _, _ in after)
