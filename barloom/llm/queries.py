"""One query per operator over its whole table, and the pipeline's helpers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import balanced_shards, bit_simhash, byte_bpe, cap_filters, kneser_ney, language_evidence, line_crf, link_trust, merkle, piece_table, pivotal_mix, site_lines, vector_file

RANKS = "byte_bpe_multi_50k.tiktoken"
RULES = [
    link_trust.Rule("block", "net"),
    link_trust.Rule("allow", "example.net", "/en/"),
    link_trust.Rule("block", "example.com", "/de/"),
    link_trust.Rule("allow", "org", "/fr/"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = cap_filters.near_vectors(_table(spark, folder, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    field = line_crf.fit(docs, _table(spark, folder, "labels"))
    return line_crf.judged(docs.select("doc_id", "text"), field).select("row.doc_id", *(n for n, _ in line_crf.FINDINGS if n != "boilerplate_lines"), F.size("boilerplate_lines").cast("long").alias("n_boilerplate_lines"))


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return link_trust.judged(_table(spark, folder, "pages"), RULES)


def balanced_placement(spark: SparkSession, folder: str) -> DataFrame:
    found = balanced_shards.assigned(_table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.token_digests(_table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = bit_simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", bit_simhash.fingerprint_text().alias("fingerprint"), F.col("component").alias("component_id"))


def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    found = language_evidence.identified(docs, declared=F.col("lang"), host=F.col("source"))
    return found.select("row.doc_id", F.col("row.lang").alias("declared"), "language", "probability", "text_language", F.col("accepted").alias("kept"))


def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    declared, text = language_evidence.markup("html")
    host, suffix = language_evidence.address("url")
    pages = _table(spark, folder, "pages").select("page_id", text.alias("text"), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"))
    found = language_evidence.identified(pages, declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix"))
    return found.select("row.page_id", "row.host", "row.suffix", "row.declared", "language", "probability", "text_language", F.col("accepted").alias("kept"))


def target_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    rows = pivotal_mix.settle(pivotal_mix.sized(docs))
    taken = pivotal_mix.copies(rows)
    return taken.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def site_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = site_lines.without_site_lines(_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return found.select("row.doc_id", "row.source", "n_lines", "n_dropped", F.col("clean").alias("text"))


def kneser_ney_scores(spark: SparkSession, folder: str) -> DataFrame:
    mark = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(7)) == 2
    docs = _table(spark, folder, "documents").select("doc_id", "text", mark.alias("held_out"))
    model = kneser_ney.fit(docs.where("NOT held_out"), order=3)
    found = kneser_ney.scored(docs, model, keys=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = piece_table.digests(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh row or so is checked as if its n_chars had been raised by one."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = merkle.leaf(*[more if c == "n_chars" else F.col(c) for c in fields])
    found = merkle.manifest(_table(spark, folder, "documents"), fields, found=F.when(hit, changed))
    rebuilt = found.select("*", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("path"), F.col("found")).alias("folded_root"))
    return rebuilt.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def exact_top_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_file.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


QUERIES = {
    "op1_cap_filter_near_dup": embedding_near_duplicates,
    "op2_line_crf_quality": line_quality,
    "op3_link_trust_url_filter": url_verdicts,
    "op4_balanced_label_shards": balanced_placement,
    "op5_byte_bpe": byte_level_bpe,
    "op6_bit_sliced_simhash": simhash_components,
    "op7_language_evidence": document_languages,
    "op8_pivotal_mix": target_mix,
    "op9_site_line_dedup": site_line_dedup,
    "op10_kneser_ney_scores": kneser_ney_scores,
    "op11_piece_table_middle": fill_in_middle,
    "op12_merkle_manifest": merkle_manifest,
    "op13_vector_file_top_k": exact_top_vectors,
    "page_language_evidence": page_languages,
}
