"""Byte-level BPE, line labelling and language evidence."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, language_evidence, line_crf
from barloom.llm.queries import RANKS
from barloom.llm.text import unpacked

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, row string, kind string, bytes string, scores string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "s", "i") for r in rows], DOCS)


LONG = "word " * 60_000 + "a1b2" * 9000 + "x" * 3000 + "\n\n  tail's end 'll"
TEXTS = ["", None, " \n\t", "a", "don't 'll 12ab", "é ñ 中文字 　 x", LONG, "<|endoftext|> is text", "don't 'll 12ab"]


def test_bpe_whole_texts(spark):
    enc = byte_bpe.encoding(PATH, PATTERN)
    docs = frame(spark, [(i if i else None, t, None, None) for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: r for r in byte_bpe.token_digests(docs, PATH, PATTERN, piece_chars=1000).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        row = got[i if i else None]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_pieces_join_to_the_whole():
    enc, rng = byte_bpe.encoding(PATH, PATTERN), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "é", "9", " ", "\n", "'s", "'", "  ", "$", " ", "Ω", "中"]) for _ in range(400))
        assert "".join(byte_bpe.pieces(text, 20)) == text
        assert byte_bpe.encode(text, enc, 20) == enc.encode_ordinary(text)


def test_bpe_tokens_carry_all_columns(spark):
    docs = frame(spark, [(1, "hi there", "en", "a"), (1, "hi there", "en", "a"), (None, None, None, None)])
    out = byte_bpe.tokenized(docs, PATH, PATTERN)
    assert unpacked(out).columns == docs.columns
    assert [bytes(r["decoded"]) for r in out.orderBy("row.doc_id").collect()] == [b"", b"hi there", b"hi there"]
    assert byte_bpe.tokenized(docs.limit(0), PATH, PATTERN).count() == 0


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_base_counts_match_plain_python():
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice(["a ", "b ", "é ", "\n", "|", "# ", "cc\n", "\x1c", "\r", "a b c "]) for _ in range(rng.randrange(80)))
        t = line_crf.read_text(text.encode())
        assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == plain_base(text), text


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(2)
    for _ in range(40):
        field = line_crf.LineField(tuple(rng.normal(size=len(line_crf.FEATURES))), tuple(map(tuple, rng.normal(size=(2, 2)))))
        x = rng.normal(size=(7, len(line_crf.FEATURES)))
        node = x @ np.array(field.node)

        def score(labels, node=node, field=field):
            return sum(n for n, y in zip(node, labels, strict=True) if y) + sum(field.step[a][b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=7), key=score)
        assert field.labels(x).tolist() == list(best)


def test_line_quality_learns_and_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = line_crf.judged(docs.select("doc_id", "text"), line_crf.fit(docs, labels, sample_docs=1500))
    rows = out.select("row.doc_id", "base_failed", "kept").join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.5


def test_line_quality_edges(spark):
    docs = frame(spark, [(1, None, None, None), (2, "", None, None), (None, "word " * 60, None, None), (3, LONG, None, None), (3, LONG, None, None)])
    field = line_crf.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = [(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in line_crf.judged(docs, field).select("row.doc_id", "n_words", "base_failed", "kept").collect()]
    n = len(LONG.split())
    assert sorted(got, key=str) == sorted([(1, 0, True, False), (2, 0, True, False), (None, 60, True, False), (3, n, True, False), (3, n, True, False)], key=str)
    assert line_crf.judged(docs.limit(0), field).count() == 0


@pytest.fixture(scope="module")
def spoken(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_languages_of_held_out_documents(spark, spoken):
    odd = F.pmod("doc_id", F.lit(2)) == 1
    model = language_evidence.fit_text_model(spoken.where(~odd))
    found = language_evidence.identified(spoken.where(odd), host=F.col("source"), model=model)
    rows = found.select("row.lang", "language", "accepted").collect()
    assert sum(r["lang"] == r["language"] for r in rows) >= 0.99 * len(rows)
    assert all(r["accepted"] for r in rows)


def test_language_edges(spark, spoken):
    model = language_evidence.fit_text_model(spoken)
    german = [r["text"] for r in spoken.where("lang = 'de'").orderBy("doc_id").limit(30).collect()]
    rows = [(i, t, "de", "h.example.de") for i, t in enumerate(german)]
    rows += [(100, None, "de", "h.example.de"), (101, "", None, None), (102, "Ω≈ç√ ∫˜µ≤ " * 50, None, "h.example.de"), (None, german[0], None, None), (None, german[0], None, None), (103, german[0] * 200, "", "")]
    docs = frame(spark, rows)
    found = language_evidence.identified(docs, declared=F.col("lang"), host=F.col("source"), suffix=F.substring_index("source", ".", -1), model=model)
    assert unpacked(found).columns == docs.columns
    got = found.select("row.doc_id", "language", "accepted", "probability").collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["language"] == "de" and by_id[i]["accepted"] for i in (*range(30), None, 103))
    assert by_id[100]["language"] == "de" and not by_id[100]["accepted"]  # other evidence names it, but there is no text
    assert not by_id[101]["accepted"] and not by_id[102]["accepted"] and by_id[102]["language"] == language_evidence.UND
    assert language_evidence.identified(docs.limit(0), declared=F.col("lang"), host=F.col("source")).count() == 0


def test_evidence_decides_where_text_is_silent(spark, spoken):
    """A short ambiguous text follows the declared language; without it, the host's other pages."""
    model = language_evidence.fit_text_model(spoken)
    by = {lang: [r["text"] for r in spoken.where(F.col("lang") == lang).orderBy("doc_id").limit(40).collect()] for lang in ("de", "fr")}
    rows = [(i, t, lang, f"{lang}.example") for lang in by for i, t in enumerate(by[lang])]
    rows += [(1000, "e", None, "de.example"), (1001, "e", None, "fr.example"), (1002, "e", "fr", None), (1003, "e", "de", None)]
    found = language_evidence.identified(frame(spark, rows), declared=F.col("lang"), host=F.col("source"), model=model)
    got = {r["doc_id"]: r["language"] for r in found.select("row.doc_id", "language").where("doc_id >= 1000").collect()}
    assert got == {1000: "de", 1001: "fr", 1002: "fr", 1003: "de"}


def test_markup_and_address(spark):
    rows = [("<HTML x='1' lang='De-at'><script>no</script><p>yes</p><!-- no --><b>on", "https://Www.Example.ORG:8080/a?b"), (None, None), ("<p>t", "no address")]
    lang, text = language_evidence.markup("html")
    host, suffix = language_evidence.address("url")
    got = spark.createDataFrame(rows, "html string, url string").select(lang, text, host, suffix).collect()
    assert [got[0][0], got[0][1].split(), got[0][2], got[0][3]] == ["de", ["yes", "on"], "www.example.org", "org"]
    assert tuple(got[1]) == (None,) * 4 and got[2][0] is None and got[2][2] is None


def merged(data, ranks):
    """The merge rule written out: the pair with the lowest rank is joined first, the leftmost among equals."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("white", [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\n ", "　"])
def test_bpe_of_long_white_space(white):
    enc = byte_bpe.encoding(PATH, PATTERN)
    ranks = {enc.decode_single_token_bytes(i): i for i in range(enc.n_vocab) if i < 50_256}
    for n in (1000, 12_000, 60_000):
        for text in (white * n, "ab" + white * n, white * n + "cd", "a\n" + white * n + "!" + white * n + "'s"):
            assert byte_bpe.encode(text, enc, 500) == enc.encode_ordinary(text)
    assert byte_bpe.encode(white * 300 + "x", enc) == [*merged((white * 300)[:-1].encode(), ranks), *enc.encode_ordinary(white[-1] + "x")]
    # where the library itself gives up, from a run of a length that it can take
    for text, tail in (("ab%scd", "cd"), ("%s", ""), ("%s!", "!")):
        ids = byte_bpe.encode(text % (white * 2_000_000), enc)
        assert byte_bpe.decode(ids, enc) == (text % (white * 2_000_000)).encode()
        short = enc.encode_ordinary(text % (white * 20_000))
        assert ids[:1000] == short[:1000] and ids[-50:] == short[-50:]


def test_bpe_of_a_table_with_ten_million_blanks(spark):
    text = "start" + " " * 10_000_000 + "end"
    (row,) = byte_bpe.token_digests(frame(spark, [(1, text, None, None)]), PATH, PATTERN).collect()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
