"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from hushframe.llm.neardup import near_duplicates
from hushframe.llm.registry import query, table


@query("op2_jaccard_join")
def op2_jaccard_join(spark, folder):
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text")).drop("fp", "root")
