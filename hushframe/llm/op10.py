"""Query of near-duplicate embeddings."""

from __future__ import annotations

from hushframe.llm.registry import query, table
from hushframe.llm.vectors import near_duplicate_vectors


@query("op10_vectors")
def op10_vectors(spark, folder):
    return near_duplicate_vectors(table(spark, folder, "embeddings"))
