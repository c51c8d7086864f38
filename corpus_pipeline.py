"""From raw documents to token digests in five written stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bit_simhash, byte_bpe, language_evidence, pivotal_mix, site_lines
from barloom.llm.queries import RANKS
from barloom.llm.text import packed, unpacked
from barloom.plans.settle import scratch_path, settle, shuffles_removed


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    found = language_evidence.identified(docs, declared=F.col("lang"), host=F.col("source"))
    return unpacked(found.where("accepted"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    found = site_lines.without_site_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(found, text=F.col("clean"), n_chars=changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, of equal ids and texts the first by all columns."""
    kind = F.struct("doc_id", F.xxhash64("text").alias("text"))
    found = bit_simhash.near_duplicates(docs.select(kind.alias("kind"), "text"), key="kind")
    kept = settle(found.where(F.col("kind").eqNullSafe(F.col("component"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
    rows = packed(docs, kind=kind).join(kept, "kind", "left_semi")
    if (kept.agg(F.max("n")).first()[0] or 1) > 1:  # repeated ids with one text
        rows = rows.groupBy("kind").agg(F.min("row").alias("row"))
    return unpacked(rows)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return pivotal_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of each document."""
    return byte_bpe.token_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", languages),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            out.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}")
    return docs


#: The near-duplicate, mixing and encoding stages are beyond SQL; tests/llm/test_corpus_operators.py has a plain counterpart.
ORACLE_SQL = None
