"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.llm import quality
from hushframe.llm.common import remainder
from hushframe.llm.registry import query, table


def weights(spark, folder):
    """Learned from the labelled rows whose remainder is not 0."""
    labels = table(spark, folder, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    return quality.train(table(spark, folder, "documents"), labels)


@query("op6_quality")
def op6_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", quality.score(spark, weights(spark, folder), F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )
