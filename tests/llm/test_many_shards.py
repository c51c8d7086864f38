"""A model of many shards: files are mapped once, words are cut and hashed at once, and keys keep their shards' order."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from barloom.llm import kneser_ney as kn


def test_scoring_maps_each_file_once(spark):
    rng = np.random.default_rng(5)
    texts = [(" ".join(f"w{k}" for k in rng.integers(0, 40, 1000)),) for _ in range(200)]
    model = kn.fit(spark.createDataFrame(texts, "text string").repartition(4), shard_bytes=1600, order=3)
    assert len(model.triples.held) == 512
    words = np.concatenate([np.load(f"{model.words.folder}/words-{s}.npy") for s in sorted(model.words.held)])
    kn._mapped.cache_clear()
    opened, files = [], len(os.listdir("/proc/self/fd"))
    for _ in range(3):
        kn._score_chunk(model, rng.choice(words[words != kn.END], 100_000), np.full(100, 1000))
        opened.append(kn._mapped.cache_info().misses)
    assert opened[0] > 3000 and opened[2] - opened[1] < 100  # a file may hold nothing that the first texts ask for
    assert len(os.listdir("/proc/self/fd")) < files + 100 or not kn.UNTRACKED


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_words_are_those_of_split(monkeypatch, most):
    monkeypatch.setattr(kn, "BYTES_AT_ONCE", most)
    rng = np.random.default_rng(1)
    odd = [b"", b" ", b"A b\x0ba\tB\x0c\r\nc", b"a\x1cb a\xa0b", b"\xff\xfe \xc3", b"x", b"\x00 \x00\x00 a\x00", "Ärger ÄRGER".encode(), b"eightABC eightabc eightabcd", b"q" * 100, b"q" * 99, b" lead and trail "]
    odd += [bytes(rng.choice([32, 9, 65, 97, 98, 0, 200], int(n)).astype(np.uint8)) for n in rng.integers(0, 300, 200)]
    padded = pa.array([b"before", *odd, b"behind"], pa.binary()).slice(1, len(odd))
    found = [*kn._chunks([padded, pa.array([], pa.binary())], 100)]
    hashes, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
    words = [w for t in odd for w in (*t.lower().split(), None)]
    assert sizes.tolist() == [len(t.split()) + 1 for t in odd] and len(hashes) == len(words)
    assert all((h == kn.END) == (w is None) for h, w in zip(hashes, words, strict=True))
    assert len({*zip(hashes.tolist(), words, strict=True)}) == len({*words}) == len({*hashes.tolist()})


@pytest.mark.parametrize("kind, bits, largest", [("words", 3, 1 << 64), ("pairs", 2, 1), ("pairs", 3, 40), ("pairs", 9, 1 << 44), ("triples", 6, 1 << 64)])
def test_keys_in_shard_order(kind, bits, largest):
    rng = np.random.default_rng(bits)
    keys = rng.integers(0, largest - 1, 5000, dtype=np.uint64, endpoint=True)
    keys = keys[rng.integers(0, 2500, 5000)]
    shards = kn.Shards("", kind, bits, ())
    turned, most = shards.turned(keys)
    assert (shards.turned_back(turned, most) == keys).all() and most <= 64
    groups, back = shards.grouped(keys)
    assert (groups[back] == keys).all() and (np.diff(shards.of(groups)) >= 0).all() and len(groups) < 1.01 * len(np.unique(keys))
    batch = kn._blobs(shards, keys)
    both = pa.Table.from_batches([batch, batch])
    merged = [(s.as_py(), *kn._merged(both.filter(pc.equal(both.column("shard"), s)))) for s in batch.column("shard")]
    whole = np.concatenate([shards.whole(s, k) for s, k, _ in merged])
    count = np.concatenate([n for _, _, n in merged])
    order = np.argsort(whole)
    known, times = np.unique(keys, return_counts=True)
    assert (whole[order] == known).all() and (count[order] == 2 * times).all()
    assert all((np.diff(k.astype(object)) > 0).all() for _, k, _ in merged)
