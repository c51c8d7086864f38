"""What several operators share about texts: words, ASCII lower case, whole rows carried past joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; `bytes.split()` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf8(column: str) -> Column:
    """The bytes of a text column, NULL as no bytes: Python then needs no decoding."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def slices(batch, rows: int = 1000):
    """An Arrow batch in parts, so that few texts at a time are copied into Python."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """`row` holds all columns of `df`, so that the named keys beside it cannot clash with any of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def unpacked(df: DataFrame, **replaced: Column) -> DataFrame:
    """The columns inside `row`, some of them replaced."""
    names = df.schema["row"].dataType.names
    return df.select(*[replaced.get(n, F.col("row").getField(n)).alias(n) for n in names])
