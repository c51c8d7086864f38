"""Fill-in-the-middle examples against plain string work."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import piece_table
from barloom.llm.piece_table import PLAIN, PSM, SPM, Pieces, Recipe
from barloom.llm.text import unpacked

COLUMNS = "doc_id long, text string, row string, n string, form string, key string, bytes string, example string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], COLUMNS)


def plain(key, text, recipe=Recipe()):
    """(n, form, prefix, middle, output) by lists of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"{recipe.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in (recipe.prefix, recipe.middle, recipe.suffix)) or h[2] % 100 >= 100 - recipe.plain_percent:
        return n, PLAIN, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < recipe.spm_percent:
        return n, SPM, len(pre), len(mid), recipe.suffix + suf + recipe.prefix + pre + recipe.middle + mid
    return n, PSM, len(pre), len(mid), recipe.prefix + pre + recipe.suffix + suf + recipe.middle + mid


TEXTS = [
    "", None, "\n", "\n\n\n", "one line", "one line\n", "é\nñ中\n文字", "has <P> inside\nx", "ends <\n<S\n<M", "<S>",
    "a\r\nb\rc\n", "row\n" * 40_000, "x" * 300_000 + "\n" + "中" * 100_000, "one line", "\x00\n\x85 two",
]


@pytest.mark.parametrize("recipe", [Recipe(), Recipe(plain_percent=30, spm_percent=0), Recipe("[pre]", "[mid]", "[suf]", seed=3, spm_percent=100)])
def test_examples_equal_string_work(spark, recipe):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no\nkey\nat\nall"), (3, "\n\n\n")]
    rows += [(100 + i, "".join(rng.choice(["ab", "\n", "<", "P>", "é", " "]) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs = frame(spark, rows)
    got = piece_table.digests(docs, recipe=recipe).collect()
    assert len(got) == len(rows)
    made = {(r["row"]["doc_id"], r["row"]["text"]): r for r in got}
    for key, text in rows:
        n, form, pre, mid, output = plain(key, text, recipe)
        r = made[key, text]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, pre, mid)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    examples = piece_table.transformed(docs, recipe=recipe)
    assert unpacked(examples).columns == docs.columns
    texts = {(r["row"]["doc_id"], r["row"]["text"]): r["example"] for r in examples.collect()}
    assert all(texts[key, text] == plain(key, text, recipe)[4] for key, text in rows)
    back = piece_table.originals(examples.select(F.col("row.text").alias("text"), "example", "form"), recipe=recipe).collect()
    assert len(back) == len(rows) and all(r["original"] == (r["row"]["text"] or "") for r in back)


def test_empty_table_and_missing_examples(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert piece_table.digests(none).count() == 0 and piece_table.transformed(none).count() == 0
    lost = spark.createDataFrame([(None, PSM), ("x", None), ("x", PLAIN)], "example string, form string")
    assert [r["original"] for r in piece_table.originals(lost).collect()] == [None, None, "x"]


def test_descriptors():
    whole = Pieces.of(b"abcdef")
    parts = whole.cut(0, 2, 2, 6)
    assert [bytes(p) for p in parts] == [b"", b"ab", b"", b"cdef", b""]
    assert parts.cut(3).bytes() == b"abcdef" and len(parts.buffers) == 1
    order = (3, 0, 4, 1, 2)
    moved = parts.permuted(order)
    assert moved.bytes() == b"cdefab" and moved.inverse(order).table == parts.table
    assert moved.sha256() == hashlib.sha256(b"cdefab").hexdigest()
    assert Pieces.of(b"ab").cut(1).behind((b"<", b">>")).bytes() == b"<a>>b"


def test_ambiguous_sentinels_are_refused():
    for mark in ("", "aba", "<<"):
        with pytest.raises(ValueError):
            Recipe(prefix=mark)
