"""Write masked rows and masking counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.operators.metrics import COUNTS, KEYS


def stringify_rows(df: DataFrame) -> DataFrame:
    """Every value as text, nested ones as JSON text, null stays null."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        out.append((F.to_json(col) if nested else col.cast("string")).alias(f.name))
    return df.select(*out)


def stringify_documents(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, scalars keep their type."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            col = F.to_json(col)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
            col = col.cast("string")
        out.append(col.alias(f.name))
    return df.select(*out)


def write_rows(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "append") -> None:
    """Store masked rows; the file format is any that Spark can write."""
    df.write.format(file_format).mode(mode).save(path)


def write_metrics(metrics: DataFrame, path: str, day: str | None = None) -> None:
    """Append metric rows, one folder per day. Only names and counts are stored."""
    rows = metrics if day is None else metrics.withColumn("day", F.lit(day).cast("date"))
    rows.select("day", *KEYS, *COUNTS).write.partitionBy("day").mode("append").parquet(path)
