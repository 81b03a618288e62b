"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.llm import language
from hushframe.llm.common import remainder
from hushframe.llm.registry import query, table


def learned(spark, folder):
    """From the documents whose remainder is not 0."""
    docs = table(spark, folder, "documents")
    return language.train(docs.where(remainder(F.col("doc_id"), 5) != 0))


@query("op9_language")
def op9_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = docs.select("doc_id", language.identify(spark, learned(spark, folder), F.col("text")).alias("x"))
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("x.lang").alias("lang_pred"),
        F.col("x.score").alias("score"),
    )
