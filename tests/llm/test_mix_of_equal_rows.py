"""Rows alike in key and text: one row of a chunk, and each keeps its own other columns."""

from collections import Counter

from test_corpus_operators import DOCS

from barloom.llm import pivotal_mix


def docs(spark):
    rows = [(None, "one text again", "en", "b", 14, f"own {i}", 1, "b", "c") for i in range(700)]
    rows += [(i, "w " * (i % 50 + 1), "en", ("a", "b", "c")[i % 3], 1, "a", 1, "b", "c") for i in range(1500)]
    return spark.createDataFrame(rows, DOCS)


def test_equal_rows_are_one_row_of_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(pivotal_mix, "CHUNK_ROWS", 50)
    rows = pivotal_mix.sized(docs(spark))
    kinds = pivotal_mix.kind_copies(rows).where("key IS NULL").collect()
    assert len(kinds) == 1 and kinds[0]["alike"] == 700
    got = [r["copies"] for r in pivotal_mix.copies(rows).collect() if r["key"] is None]
    assert len(got) == 700 and sum(got) == kinds[0]["copies"] and max(got) - min(got) <= 1


def test_rows_alike_keep_their_own_columns(spark):
    rows = docs(spark)
    total = pivotal_mix.kind_copies(pivotal_mix.sized(rows)).where("key IS NULL").first()["copies"]
    got = Counter(r["row"] for r in pivotal_mix.mixed(rows.repartition(7)).where("doc_id IS NULL").collect())
    assert sum(got.values()) == total and len(got) == min(total, 700) and max(got.values()) - (min(got.values()) if len(got) == 700 else 0) <= 1
