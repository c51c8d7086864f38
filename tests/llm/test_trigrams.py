"""The n-gram model of order three against its definition over dictionaries."""

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_corpus_operators import PlainKneserNey, frame, ngram_texts

from barloom.llm import kneser_ney


def tokens_of(text):
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), None]


class PlainTrigrams(PlainKneserNey):
    """Pairs that begin a text keep their counts, others count the distinct words before them."""

    def __init__(self, texts):
        super().__init__(texts)
        self.triples = Counter()
        for t in texts:
            tokens = tokens_of(t)
            self.triples.update(zip(tokens, tokens[1:], tokens[2:], strict=False))
        before = Counter((v, w) for _, v, w in self.triples)
        self.adjusted = {(v, w): c if v == "<s>" else before[v, w] for (v, w), c in self.pairs.items()}
        self.d3, self.d2 = self.discounts(self.triples.values()), self.discounts(self.adjusted.values())
        self.after, self.after2 = defaultdict(dict), defaultdict(dict)
        for (v, w), c in self.adjusted.items():
            self.after[v][w] = c
        for (u, v, w), c in self.triples.items():
            self.after2[u, v][w] = c

    def of_two(self, u, v, w):
        after = self.after2.get((u, v))
        if not after:
            return self.probability(v, w)
        total, c = sum(after.values()), after.get(w, 0)
        held = sum(self.d3[min(x, 3) - 1] for x in after.values()) / total
        return (max(c - self.d3[min(c, 3) - 1], 0) / total if c else 0.0) + held * self.probability(v, w)

    def score(self, text):
        t = tokens_of(text)
        return math.log10(self.probability(t[0], t[1])) + sum(math.log10(self.of_two(*x)) for x in zip(t, t[1:], t[2:], strict=False))


def test_trigram_model_against_its_definition(spark):
    texts = [*ngram_texts(), *["one two three", "four two five"] * 300]
    docs = frame(spark, [(i if i else None, t, "s") for i, t in enumerate(texts)])
    train = docs.where("doc_id IS NULL OR doc_id % 3 <> 1")
    model = kneser_ney.fit(train.repartition(5), shard_bytes=2000, order=3)
    plain = PlainTrigrams([t for i, t in enumerate(texts) if i == 0 or i % 3 != 1])
    assert np.allclose(model.triple_discounts, plain.d3) and np.allclose(model.pair_discounts, plain.d2) and np.allclose(model.word_discounts, plain.d1)
    got = {r["doc_id"]: r["score"] for r in kneser_ney.scored(docs, model).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i if i else None], plain.score(t), rel_tol=1e-9)
    for u, v in (("<s>", "w1"), ("w1", "w1"), ("hot", "pair"), ("one", "two"), ("no", "where")):
        assert math.isclose(sum(plain.of_two(u, v, w) for w in plain.words) + plain.of_two(u, v, "unseen"), 1.0, rel_tol=1e-9)


def test_scores_use_two_words_of_history(spark):
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(["one two three", "four two five"] * 20)])
    model = kneser_ney.fit(docs, order=3)
    asked = frame(spark, [(0, "one two three", "s"), (1, "one two five", "s")])
    got = {r["doc_id"]: r["score"] for r in kneser_ney.scored(asked, model).collect()}
    assert got[0] > got[1] + 0.5


def test_trigram_edges(spark):
    docs = frame(spark, [(1, "a b", "s"), (2, None, "s")])
    empty = kneser_ney.fit(docs.limit(0), order=3)
    assert [(r["n_known"], r["score"]) for r in kneser_ney.scored(docs, empty).orderBy("doc_id").collect()] == [(0, 0.0), (0, 0.0)]
    textless = kneser_ney.fit(docs.where("doc_id = 2"), order=3)
    assert all(r["score"] <= 0 for r in kneser_ney.scored(docs, textless).collect())
    with pytest.raises(ValueError):
        kneser_ney.fit(docs, order=4)


def test_a_lost_shard_is_an_error_and_chunks_do_not_matter(spark, monkeypatch):
    texts = [*ngram_texts(), "word " * 50_000]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    model = kneser_ney.fit(docs, shard_bytes=2000, order=3)
    whole = {r["doc_id"]: r["score"] for r in kneser_ney.scored(docs, model).collect()}
    assert all(math.isclose(whole[r["doc_id"]], r["score"], rel_tol=1e-12) for r in kneser_ney.scored(docs.repartition(13), model).collect())
    for kind in ("triples", "pairs", "words"):
        shard = max(getattr(model, kind).held)
        path = f"{model.words.folder}/{kind}-{shard}.npy"
        kept = np.load(path)
        os.remove(path)
        kneser_ney._mapped.cache_clear()
        with pytest.raises(FileNotFoundError):
            getattr(model, kind).find(np.array(kept))
        np.save(path, kept)


def test_columns_named_like_outputs(spark):
    docs = frame(spark, [(1, "a b", "s")]).withColumnRenamed("doc_id", "bytes")
    model = kneser_ney.fit(docs, order=3)
    assert kneser_ney.scored(docs, model, keys=("bytes",)).columns == ["bytes", "n_tokens", "n_known", "base_score", "score"]
    for keys in (("score",), ("bytes", "bytes")):
        with pytest.raises(ValueError):
            kneser_ney.scored(docs.withColumnRenamed("text", "t").selectExpr("*", "t AS text", "0 AS score"), model, keys=keys)
