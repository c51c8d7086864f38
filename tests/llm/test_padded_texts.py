"""Wide white space does not change what a text says about its language."""

import numpy as np

from barloom.llm import language_evidence


def test_white_space_counts_as_one_blank():
    plain = "The quick fox jumps over the lazy dog é".encode()
    whole = lambda data: np.concatenate([*language_evidence.trigrams(data)])
    for gap in (b"  ", b" \t ", b"\r\n", b"\n \x0b\x0c" * 40):
        assert np.array_equal(whole(b"\n " + plain.replace(b" ", gap) + b"  "), whole(plain))


def test_padded_text_gets_the_same_verdict(spark):
    words = {"en": "the and of with that this from have", "de": "der und die mit dass aus haben nicht"}
    rows = [(i, " ".join(w.split()[(i + k) % 8] for k in range(12)), lang) for lang, w in words.items() for i in range(40)]
    wide = [(100 + i, t.replace(" ", " " * 60), lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    model = language_evidence.fit_text_model(spark.createDataFrame(rows, schema))
    found = language_evidence.identified(spark.createDataFrame(rows + wide, schema), model=model).collect()
    got = {(r["row"]["doc_id"], r["row"]["lang"]): (r["language"], r["text_language"], r["accepted"], r["probability"]) for r in found}
    for i, _, lang in rows:
        assert got[i, lang] == got[100 + i, lang] and got[i, lang][0] == lang and got[i, lang][2]
