"""Language identification by Bayesian fusion of independent evidence.

log posterior(language) = log host prior + text log likelihood + log P(declared | language) + log P(suffix | language)

- Text: hashed byte trigrams under one model per language, mixed with a uniform model so that no trigram can cost
  more than a bounded amount. Trigrams overlap threefold, so their sum counts a third. A further class, `und`, gives
  every trigram the uniform probability: texts that fit no language end there.
- Declared language (markup or metadata) and address suffix: P(value | language) counted over all rows by the
  language that the text alone suggests, smoothed.
- Host prior: languages counted per host, smoothed towards the host's site, that towards the top-level label, that
  towards the whole corpus.

The trigram models are fitted on a sample of declared rows bounded by `sample_rows` per language; everything else is
counted over all rows by grouped aggregation. What reaches the driver is the model (languages x 65,536 counts) and
a handful of totals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import ascii_lower, packed, utf8
from barloom.plans.settle import settle

LANGUAGES = ("de", "en", "es", "fr")
UND = "und"
BUCKETS = 1 << 16
SAMPLE_ROWS = 5000
UNIFORM_SHARE = 0.2
OVERLAP = 3.0
STRENGTH = 20.0
#: Counts added to every class, so that nothing is impossible.
SMOOTH = 0.5
BLOCK = 1 << 18


#: A-Z in lower case, every white-space character as a blank.
FOLD = bytes(32 if chr(b).isspace() and b < 128 and not 28 <= b <= 31 else ord(chr(b).lower()) if b < 128 else b for b in range(256))


def trigrams(data: bytes):
    """Yields arrays of trigram buckets of a text given as UTF-8, in blocks; white space counts as one blank."""
    bare = data.strip().translate(FOLD)
    if b"  " in bare:
        bare = b" ".join(bare.split())
    if not bare:
        return
    codes = np.frombuffer(b" " + bare + b" ", np.uint8).astype(np.uint32)
    for at in range(0, len(codes) - 2, BLOCK):
        part = codes[at : at + BLOCK + 2]
        code = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        yield (code * np.uint32(2654435761)) >> np.uint32(16)


@dataclass(frozen=True)
class TextModel:
    """Log likelihood ratios of each trigram bucket against the uniform model, one column per language."""

    languages: tuple[str, ...]
    ratios: np.ndarray

    def scores(self, data: bytes) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for part in trigrams(data):
            total += self.ratios[part].sum(axis=0, dtype=np.float64)
        return total / OVERLAP


def fit_text_model(df: DataFrame, text: str = "text", declared: str = "lang", languages=LANGUAGES, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Trigram models from texts that rows declare to be in one of `languages`, about `sample_rows` texts of each, chosen
    by hash. Copies of a text count once, so that a hot text is neither the whole sample nor more than its bound."""
    names = sorted(languages)
    value = ascii_lower(F.col(f"`{declared}`"))
    rows = df.select(value.alias("lang"), F.col(f"`{text}`").alias("text")).where(F.col("lang").isin(names))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_rows / n)).otherwise(share)
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6
    sample = rows.where(chance < share).groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.min("text").alias("text"))
    sample = sample.select("lang", utf8("text").alias("bytes"))
    order = {lang: i for i, lang in enumerate(names)}

    def counted(batches):
        table = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                for part in trigrams(data):
                    table[order[lang]] += np.bincount(part, minlength=BUCKETS)
        lang, bucket = np.nonzero(table)
        arrays = [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(table[lang, bucket], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "n"])

    found = sample.mapInArrow(counted, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(names), BUCKETS))
    table[found["lang"].to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    probable = (table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    mixed = (1 - UNIFORM_SHARE) * probable * BUCKETS + UNIFORM_SHARE
    mixed[table.sum(axis=1) == 0] = UNIFORM_SHARE  # a language without a sample never wins by its text
    return TextModel(tuple(names), np.ascontiguousarray(np.log(mixed).T, np.float32))


def _text_scores(df: DataFrame, model: TextModel):
    """A column function: scores per language, then 0 for `und`; NULL for a text without a word."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x languages

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series([[*known.scores(t), 0.0] if t and t.strip() else None for t in texts])

    return scores


def _site(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _top(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _best(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def host_priors(rows: DataFrame, classes: int, strength: float = STRENGTH) -> DataFrame:
    """(host, prior): smoothed class shares per host. rows: host, best (class by text, NULL without text)."""
    hits = [F.sum((F.col("best") == k).cast("double")) for k in range(classes)]
    zero = [F.coalesce(h, F.lit(0.0)) for h in hits]
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(F.array(*zero).alias("n"))
    hosts = settle(hosts.select("host", _site(F.col("host")).alias("site"), _top(F.col("host")).alias("top"), "n"))
    everything = _corpus(rows, classes)
    total = lambda name: F.array(*[F.sum(F.col("n")[k]) for k in range(classes)]).alias(name)
    sites = hosts.groupBy("site").agg(total("n_site"), F.max("top").alias("top"))
    tops = hosts.groupBy("top").agg(total("n_top"))

    def smoothed(own: Column, above: Column) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.zip_with(own, above, lambda n, p: n + strength * p), lambda x: x / (size + strength))

    tops = tops.select("top", smoothed(F.col("n_top"), everything).alias("p_top"))
    sites = sites.join(tops, "top").select("site", smoothed(F.col("n_site"), F.col("p_top")).alias("p_site"))
    return hosts.join(sites, "site").select("host", smoothed(F.col("n"), F.col("p_site")).alias("prior"))


def _corpus(rows: DataFrame, classes: int) -> Column:
    found = rows.agg(*[F.sum((F.col("best") == k).cast("double")).alias(f"n{k}") for k in range(classes)]).first()
    n = np.array([x or 0.0 for x in found]) + SMOOTH
    return F.array(*[F.lit(float(x)) for x in n / n.sum()])


def value_likelihoods(rows: DataFrame, column: str, classes: int) -> DataFrame:
    """(column, logs): log P(value | class) of every value, counted over the rows whose text suggests a class."""
    hits = [F.coalesce(F.sum((F.col("best") == k).cast("double")), F.lit(0.0)) for k in range(classes)]
    known = settle(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.array(*hits).alias("n")))
    whole = known.agg(F.count(F.lit(1)).alias("values"), *[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(classes)]).first()
    totals = [(whole[f"n{k}"] or 0.0) + SMOOTH * whole["values"] for k in range(classes)]
    logs = [F.log((F.col("n")[k] + SMOOTH) / F.lit(totals[k] or 1.0)) for k in range(classes)]
    return known.select(column, F.array(*logs).alias(f"of_{column}"))


def identified(df: DataFrame, text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, model: TextModel | None = None, languages=LANGUAGES) -> DataFrame:
    """(`row`, language, probability, text_language, accepted) for every row of `df`, whose columns are in `row`.

    `declared`, `host` and `suffix` are columns of `df`; NULL in any of them is no evidence. A text without a word
    gets its language from the other evidence and is not accepted; nor is one whose language is `und`. Ties go to the
    alphabetically first language. Repeated rows are judged alike.
    """
    nothing = F.lit(None).cast("string")
    model = model or fit_text_model(df.select(F.col(f"`{text}`").alias("text"), (declared if declared is not None else nothing).alias("lang")), languages=languages)
    classes = [*model.languages, UND]
    udf = _text_scores(df, model)
    keys = {"text_": utf8(f"`{text}`"), "declared": ascii_lower(declared) if declared is not None else nothing, "host": host if host is not None else nothing, "suffix": suffix if suffix is not None else nothing}
    full = packed(df, **keys).withColumn("scores", udf("text_"))
    seen = settle(full.select("declared", "host", "suffix", _best(F.col("scores")).alias("best")))
    zero = F.array(*[F.lit(0.0)] * len(classes))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    # everything but the text depends on these three values alone: one small table, one join with the rows
    context = seen.select("declared", "host", "suffix").distinct().join(host_priors(seen, len(classes)), "host", "left")
    for name in ("declared", "suffix"):
        context = context.join(value_likelihoods(seen, name, len(classes)), name, "left")
    prior = F.transform(F.coalesce("prior", _corpus(seen, len(classes))), lambda p: F.log(p))
    values = add(F.coalesce("of_declared", zero), F.coalesce("of_suffix", zero))
    context = settle(context.select(*[F.col(c).alias(f"c_{c}") for c in ("declared", "host", "suffix")], add(prior, values).alias("context")))
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in ("declared", "host", "suffix")]
    joined = full.join(context, same[0] & same[1] & same[2])
    posterior = add(F.col("context"), F.coalesce("scores", zero))
    names = F.array(*[F.lit(c) for c in classes])
    judged = joined.select("row", "scores", posterior.alias("posterior"))
    most = F.array_max("posterior")
    weight = F.aggregate(F.transform("posterior", lambda x: F.exp(x - most)), F.lit(0.0), lambda a, x: a + x)
    judged = judged.select("row", "scores", F.get(names, _best(F.col("posterior"))).alias("language"), (1 / weight).alias("probability"), F.get(names, _best(F.col("scores"))).alias("text_language"))
    accepted = F.col("scores").isNotNull() & (F.col("language") != UND)
    return judged.select("row", "language", "probability", "text_language", accepted.alias("accepted"))


def markup(html: str) -> tuple[Column, Column]:
    """Declared language of a page's root element, and its text without scripts, styles, comments and tags."""
    page = F.col(html)
    lang = F.regexp_extract(page, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->", " ")
    return F.when(lang != "", ascii_lower(lang)), F.regexp_replace(bare, r"<[^>]*+>", " ")


def address(url: str) -> tuple[Column, Column]:
    """Host of an address and its last label; NULL without a host."""
    host = ascii_lower(F.regexp_extract(F.col(url), r"^[^:/?#]*://([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return host, _top(host)
