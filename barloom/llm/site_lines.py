"""Site-relative line dedup, in DataFrame functions only.

A line's ratio is the number of a host's pages that contain it over the host's pages. Lines above `max_ratio` that
stand on at least `min_pages` pages are boilerplate of that host and are dropped from all its pages.

Scale: lines are reduced to 64-bit hashes and counted per (host, line) with map-side combining, so neither a hot host
nor a hot line meets in one task. A host's boilerplate lines number at most its mean lines per page over `max_ratio`,
so they travel as one array per host, and texts are never taken apart across rows. The join back is by host against
one row per host; AQE splits a hot host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import packed
from barloom.plans.settle import settle

MAX_RATIO = 0.1
MIN_PAGES = 5


def _identity(line: Column) -> Column:
    """Lines are compared without blanks around them; a line without a word has no identity."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.when(bare != "", F.xxhash64(bare))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def host_lines(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, pages, dropped): every host with its page total and the hashes of its boilerplate lines, sorted."""
    pages = df.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).where("host IS NOT NULL")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _identity), lambda h: h.isNotNull()))
    lines = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("on_pages"))
    often = lines.where(F.col("on_pages") >= min_pages).join(totals, "host").where(F.col("on_pages") > max_ratio * F.col("pages"))
    dropped = often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("dropped"))
    return totals.join(dropped, "host", "left")


def without_site_lines(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(`row`, `clean`, `n_lines`, `n_dropped`): `row` holds all columns of `df`, `clean` the text without the lines.

    Every input row gives one output row, repeated rows included (each counts as a page). NULL texts stay NULL and
    have no lines; an empty text is one line without a word, which is never dropped. Pages without a host keep all
    their lines. A line at exactly the ratio stays. Columns may have any name; they travel inside `row`.
    """
    table = settle(host_lines(df, host, text, max_ratio, min_pages).select("host", "dropped"))
    rows = packed(df, host=F.col(f"`{host}`"), text=F.col(f"`{text}`"))
    joined = rows.join(table, "host", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<bigint>")))
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("dropped"), _identity(x)), F.lit(False)))
    some = F.size("dropped") > 0
    out = joined.select("row", "text", F.when(some, kept).otherwise(lines).alias("kept"), F.size(lines).alias("all"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.col("all")).cast("long")
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept")).cast("long")
    return out.select("row", F.array_join("kept", "\n").alias("clean"), n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))
