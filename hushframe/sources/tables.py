"""Read tables and documents with a cap, and list what a database holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.operators.documents import doc_walk
from hushframe.operators.labels import confirmed_labels

__all__ = ["capped_read", "catalog_inventory", "confirmed_labels", "document_read", "field_inventory", "spark_catalog"]

# Schemas that belong to the database itself.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "mysql", "performance_schema", "sys")


def capped_read(df: DataFrame, max_rows: int | None, order_by: Sequence[Column | str] | None = None) -> DataFrame:
    """At most `max_rows` rows, all for None; give an order for a fixed result."""
    if max_rows is not None and max_rows <= 0:
        raise ValueError("max_rows must be positive, or None for no cap")
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered if max_rows is None else ordered.limit(max_rows)


def document_read(
    df: DataFrame,
    predicate: Column | None = None,
    limit: int | None = None,
    max_rows: int | None = None,
    order_by: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Documents that match, up to the smaller of the statement's limit and the row cap; None is no limit."""
    given = [n for n in (limit, max_rows) if n is not None]
    return capped_read(df if predicate is None else df.filter(predicate), min(given, default=None), order_by)


def catalog_inventory(info_schema: DataFrame, system_schemas: Sequence[str] = SYSTEM_SCHEMAS) -> DataFrame:
    """schema_name, object_name, kind of an information-schema table, system schemas left out.

    Expects table_schema, table_name, table_type. Kinds: r table, v view, m materialized view,
    f foreign table, S sequence, collection.
    """
    kind = F.upper(F.trim("table_type"))
    short = (
        F.when(kind.isin("BASE TABLE", "TABLE", "MANAGED", "EXTERNAL"), F.lit("r"))
        .when(kind == "MATERIALIZED VIEW", F.lit("m"))
        .when(kind.rlike("VIEW|TEMPORARY"), F.lit("v"))
        .when(kind.rlike("FOREIGN"), F.lit("f"))
        .when(kind == "SEQUENCE", F.lit("S"))
        .when(kind == "COLLECTION", F.lit("collection"))
    )
    own = ~F.col("table_schema").isin(*system_schemas) & ~F.col("table_schema").startswith("pg_toast")
    return (
        info_schema.filter(own)
        .select(F.col("table_schema").alias("schema_name"), F.col("table_name").alias("object_name"), short.alias("kind"))
        .filter(F.col("kind").isNotNull())
        .orderBy("schema_name", "object_name")
    )


def spark_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The session's own tables and views in the shape catalog_inventory reads."""
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    rows = [(".".join(t.namespace or []) or "", t.name, t.tableType or "TABLE") for t in found]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def field_inventory(
    df: DataFrame, object_id: str, sample_docs: int | None = None, order_by: Sequence[str] = (), json_cols: Sequence[str] = ()
) -> DataFrame:
    """object_id, field_path of every column; a document column gives the string paths that occur in it.

    All documents are looked at unless `sample_docs` asks for a sample. `json_cols` names columns of JSON text.
    """
    flat, docs = [], []
    for f in df.schema.fields:
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) or f.name in json_cols
        (docs if nested else flat).append(f.name)
    out = df.sparkSession.createDataFrame(
        [(object_id, n) for n in flat], "object_id string, field_path string"
    )
    for name in docs:
        sample = capped_read(df.select(*order_by, name), sample_docs, list(order_by) or None)
        numbered = sample.select(F.lit(0).alias("_id"), F.col(name))
        paths = doc_walk(numbered, "_id", name).filter(~F.col("is_key"))
        shown = F.when(F.col("path") == "", F.lit(name)).when(
            F.col("path").startswith("["), F.concat(F.lit(name), F.col("path"))
        ).otherwise(F.concat(F.lit(name + "."), F.col("path")))
        found = paths.select(F.lit(object_id).alias("object_id"), shown.alias("field_path")).distinct()
        out = out.unionByName(found)
    return out.orderBy("field_path")
