"""Query of language-model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.llm.common import remainder
from hushframe.llm.katz import katz_scores
from hushframe.llm.registry import query, table


@query("op1_katz")
def op1_katz(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scores = katz_scores(docs, remainder(F.col("doc_id"), 7) != 2)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
