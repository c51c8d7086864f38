"""JSON export of named sections; values JSON cannot hold become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)


def json_safe(col: Column, kind: T.DataType) -> Column:
    """NaN and infinities to NULL, at any depth of structs, arrays and map values; times to ISO text."""
    if isinstance(kind, FLOATS):
        return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.TimestampType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ssXXX")
    if isinstance(kind, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, x: json_safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[json_safe(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(col.isNotNull(), fields)
    return col


def safe_rows(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def json_rows(df: DataFrame, private: str = "_") -> DataFrame:
    """One `record` of JSON text per row, nulls written out; columns that start with `private` stay out."""
    public = [x for x in df.columns if not x.startswith(private)]
    safe = safe_rows(df.select(*public))
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("record"))


class ResultFolder:
    """Named sections of a result, written as one folder of JSON lines per section plus `meta`."""

    def __init__(self, spark: SparkSession, **meta: str) -> None:
        self.spark = spark
        self.meta = {k: str(v) for k, v in meta.items()}
        self.sections: dict[str, DataFrame] = {}

    def add(self, section: str, df: DataFrame) -> ResultFolder:
        if section == "meta":
            raise ValueError("meta is set by set_meta")
        self.sections[section] = df
        return self

    def set_meta(self, **meta: str) -> ResultFolder:
        self.meta.update({k: str(v) for k, v in meta.items()})
        return self

    def save(self, path: str, mode: str = "errorifexists") -> str:
        for name, df in self.sections.items():
            json_rows(df).withColumnRenamed("record", "value").write.mode(mode).text(f"{path}/{name}")
        meta = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in self.meta.items()] or [F.lit(None).alias("none")])
        json_rows(meta).withColumnRenamed("record", "value").write.mode(mode).text(f"{path}/meta")
        return path
