"""Keys of pairs and triples take about half of eight bytes, and each is found at its place and nothing else is."""

import os

import numpy as np
import pytest

from barloom.llm import kneser_ney as kn


@pytest.mark.parametrize("count, largest", [(1, 1), (1, 1 << 60), (300, 300), (5_000, 1 << 20), (100_000, 1 << 44), (9_000, 1 << 63)])
def test_keys_are_found(tmp_path, count, largest):
    rng = np.random.default_rng(count)
    keys = np.unique(rng.integers(0, largest, count, dtype=np.uint64))
    keys = keys << np.uint64(1) | np.uint64(1)
    kn._save_keys(str(tmp_path), "k", keys, 1)
    held = kn.Keys(f"{tmp_path}/k", 1)
    assert len(held) == len(keys) and (held.all() == keys).all() and (held.at(np.arange(len(keys))) == keys).all()
    others = [rng.integers(0, top, 400, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for top in (largest, 1 << 63)]
    asked = np.concatenate([keys, *others])
    place, hit = held.find(asked)
    assert (hit == np.isin(asked, keys)).all() and (keys[place[hit]] == asked[hit]).all()


def test_a_model_takes_about_half_of_eight_bytes_a_key(spark):
    rng = np.random.default_rng(3)
    texts = [(" ".join(f"w{k}" for k in rng.integers(0, 3000, 400)),) for _ in range(300)]
    model = kn.fit(spark.createDataFrame(texts, "text string").repartition(4), shard_bytes=200_000, order=3)
    for kind in ("pairs", "triples"):
        names = [x for x in os.listdir(model.words.folder) if x.startswith(kind)]
        sizes = {x[:-4]: os.path.getsize(f"{model.words.folder}/{x}") for x in names}
        keys = sum(v for x, v in sizes.items() if x.count("-") == 1 or x.endswith("behind"))
        held = sum(v - 128 for x, v in sizes.items() if x.endswith("-n"))  # one byte each behind the header
        assert held > 80_000 and keys < 5 * held
        shards = [sizes[f"{kind}-{s}"] for s in getattr(model, kind).held]
        assert max(shards) < 1.5 * min(shards)
