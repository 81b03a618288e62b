"""Query of toxicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.llm import toxicity
from hushframe.llm.common import remainder
from hushframe.llm.registry import query, table


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    cost = toxicity.letter_model(docs)
    weights = toxicity.train(docs, labels, cost)
    scored = docs.select("doc_id", toxicity.score(spark, cost, weights, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )
