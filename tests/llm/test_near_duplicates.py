"""Bit-sliced SimHash, cap filters and components against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash

from barloom.llm import bit_simhash, cap_filters
from barloom.llm.components import connected, forest


def parts(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    words = ["Ab", "É", "x y", "zz", "\x1c", "the", "THE"]
    for n in (0, 1, 2, 3, 4, 50):
        for _ in range(10):
            text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
            assert bit_simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_near_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([base, base[:30] ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)), base[:20] ^ np.uint64(0b1011), base[:20] ^ np.uint64(0b1111 << 60), base ^ base[::-1], [0, (1 << 64) - 1]]).astype(np.uint64)
    n = len(fp)
    low, high = np.arange(n) + 1, np.minimum(np.arange(n) + 90, n)
    got = {(int(i), int(j)) for a, b in bit_simhash.near_pairs(fp, low, high, radius) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(n) for j in range(low[i], high[i]) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    assert got == want


def test_every_pair_within_the_radius_shares_a_key():
    rng = random.Random(4)
    for n in (10, 10**6, 10**10):
        masks = [m & (1 << 64) - 1 for m in bit_simhash.block_masks(n)]
        for _ in range(200):
            other = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not other & m for m in masks)


def test_links_with_a_hot_bucket(spark):
    """Fingerprints that agree in most bits: one bucket beyond the chunk size."""
    rng = np.random.default_rng(9)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 9, 300, dtype=np.int64) << 3, rng.integers(-(1 << 62), 1 << 62, 200)]))
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    links = connected(bit_simhash.near_links(nodes, 3, chunk=40).distinct()).collect()
    got = dict.fromkeys(map(int, fps)) | {r["node"]: r["component"] for r in links}
    near = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if ((int(fps[i]) ^ int(fps[j])) & (1 << 64) - 1).bit_count() <= 3]
    root = parts(len(fps), near)
    first = {}
    for i, r in enumerate(root):
        first[r] = min(first.get(r, 1 << 70), int(fps[i]))
    assert {f: c if c is not None else f for f, c in got.items()} == {int(f): first[root[i]] for i, f in enumerate(fps)}


def brute_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = parts(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    low = {}
    for (key, _), r in zip(rows, root, strict=True):
        low[r] = min((x for x in (low.get(r), key) if x is not None), default=None)
    return sorted(((k, f"{fp:016x}", low[r]) for (k, _), fp, r in zip(rows, fps, root, strict=True)), key=str)


def test_near_duplicates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (903, rows[3][1]), (903, rows[3][1]), (904, "one"), (905, "ONE"), (906, rows[5][1] * 300), (907, (rows[5][1] * 300).upper())]
    frame = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], "doc_id long, text string, fp long, key string, component string")
    got = bit_simhash.near_duplicates(frame).select("doc_id", bit_simhash.fingerprint_text(), "component")
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)
    assert bit_simhash.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 500)] + [(7000, 7000)] + [(5, 2000), (3, 2000)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {i: 0 for i in range(1, 61)} | {1000 + k: 1000 for k in range(1, 500)} | {2000: 0}
    assert got == want
    i, j = np.array([4, 2, 0]), np.array([5, 4, 1])
    assert forest(6, i, j).tolist() == [0, 0, 2, 3, 2, 2]


def brute_vectors(rows):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(rows, good, strict=True)]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    root, low, n = parts(len(rows), links), {}, [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for (key, _), r in zip(rows, root, strict=True):
        low[r] = min((x for x in (low.get(r), key) if x is not None), default=None)
    return sorted(((k, n[i], low[root[i]]) for i, (k, _) in enumerate(rows)), key=str)


def planted(rng, count, dims, cosines):
    rows = []
    for c in cosines:
        for _ in range(count):
            a, b = rng.normal(size=(2, dims))
            a /= np.linalg.norm(a)
            b -= (a @ b) * a
            b /= np.linalg.norm(b)
            rows += [a * rng.uniform(0.1, 9), (c * a + math.sqrt(1 - c * c) * b) * rng.uniform(0.1, 9)]
    return rows


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vectors = planted(rng, 25, 64, (0.88, 0.901, 0.91, 0.95, 0.999)) + list(rng.normal(size=(200, 64)))
    hot = rng.normal(size=64)
    vectors += [hot + 0.02 * rng.normal(size=64) for _ in range(120)] + [hot] * 30
    vectors += planted(rng, 5, 8, (0.8, 0.95))
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None, *[1.0] * 63]), (9005, [float("inf"), *[1.0] * 63]), (None, rows[-1][1]), (9006, rows[0][1]), (9006, rows[0][1]), (9007, [2.0]), (9008, [3.0]), (9009, [-3.0])]
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "vec_id long, embedding array<float>, label string, node string, links string")
    got = cap_filters.near_vectors(frame, chunk=32)
    assert sorted(map(tuple, got.collect()), key=str) == brute_vectors(rows)
    assert cap_filters.near_vectors(frame.limit(0)).count() == 0
    assert cap_filters.near_vectors(frame.where("vec_id = 9000")).collect()[0]["component"] == 9000


def test_pairs_at_the_limit_share_filters():
    """Recall at the cosine itself, where it is lowest; the number of filters stays near its plan."""
    rng = np.random.default_rng(3)
    for n, dims in ((1000, 64), (50_000, 64), (10**6, 64), (5000, 24)):
        code = cap_filters.plan_code(n, dims)
        vectors = cap_filters._units(planted(rng, 300, dims, (0.9,)), dims)
        found = code.filters(vectors)
        both = [len(np.intersect1d(a, b)) for a, b in zip(found[::2], found[1::2], strict=True)]
        assert np.mean(np.array(both) > 0) >= 0.995
        assert np.mean([len(f) for f in found]) < 400
