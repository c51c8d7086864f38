"""Merkle manifests against trees built from lists."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle
from barloom.llm.merkle import Shape

FIELDS = ("doc_id", "lang", "text")
COLUMNS = "doc_id long, lang string, text string, rank string, n string, g string, leaf string, path string, block string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(leaves, run):
    """Root and, per leaf, the steps (before, after) to it."""
    paths, level, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, up_owners = [], []
        for at in range(0, len(level), run):
            kids = level[at : at + run]
            for k, mine in enumerate(owners[at : at + run]):
                for i in mine:
                    paths[i].append(("".join(kids[:k]), "".join(kids[k + 1 :])))
            up.append(h("".join(kids)))
            up_owners.append(sum(owners[at : at + run], []))
        level, owners = up, up_owners
    return level[0], paths


def plain(rows, run):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([leaf for _, _, leaf, _ in sorted(groups[g])], run) for g in names}
    root, above = climbed([trees[g][0] for g in names], run)
    out = []
    for place, g in enumerate(names):
        for (_, _, leaf, key), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((str(key), leaf, trees[g][0], root, [*path, *above[place]]))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], COLUMNS)


def rows_of(n):
    langs = ["en", None, "de", "é", "z", "a", ""]
    out = [(i * 7 % 1000, langs[i % 3], f"text {i}" * (i % 4)) for i in range(n)]
    out += [(1, "one", "alone"), (2, "é", None), (5, "z", "x" * 200_000), (None, "en", "no key"), (None, "en", None), (None, None, None)]
    return out + [(3, "", "same")] * 5


@pytest.mark.parametrize("shape", [Shape(2, 8), Shape(2, 1024), Shape(3, 9), Shape(16, 16), Shape(2, 2)])
def test_manifest_equals_lists(spark, shape):
    rows = rows_of(101)
    found = merkle.manifest(frame(spark, rows), FIELDS, shape=shape)
    found = found.select("*", merkle.folded(F.col("path"), F.col("leaf")).alias("again"), merkle.proof_digest(F.col("path")).alias("digest")).collect()
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in found)
    assert got == plain(rows, shape.run)
    assert all(r["again"] == r["root"] for r in found)
    assert all(r["digest"] == h("".join(a + b for a, b in r["path"])) for r in found)


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = rows_of(40)
    changed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf(F.col("doc_id"), F.col("lang"), F.concat("text", F.lit("!"))))
    own = merkle.leaf(*[F.col(c) for c in FIELDS])
    found = merkle.manifest(frame(spark, rows), FIELDS, found=F.coalesce(changed, own))
    found = found.withColumn("again", merkle.folded(F.col("path"), F.col("found"))).collect()
    texts = {plain_leaf(r): r for r in rows}
    for r in found:
        key, _, text = texts[r["leaf"]]
        intact = key is None or key % 3 != 0 or text is None
        assert (r["again"] == r["root"]) == intact


def test_small_tables(spark):
    assert merkle.manifest(frame(spark, [(1, "en", "x")]).limit(0), FIELDS).count() == 0
    (only,) = merkle.manifest(frame(spark, [(1, None, "x")]), FIELDS).collect()
    assert only["root"] == only["subroot"] == only["leaf"] == plain_leaf((1, None, "x")) and only["path"] == []


def test_ranks_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else "cold", 1 if i % 2 else i) for i in range(3000)], "g string, key long")
    for parts in (1, 7, 40):
        got = merkle.ranked(rows.repartition(parts), "g", "key").orderBy("g", "rank").collect()
        for g in ("hot", "cold"):
            mine = [r for r in got if r["g"] == g]
            assert [r["rank"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
            assert [r["key"] for r in mine] == sorted(r["key"] for r in mine)
