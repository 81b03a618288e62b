"""Query of token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hushframe.llm.registry import query, table
from hushframe.llm.tokencount import token_counts, vocabulary


@query("op7_token_counts")
def op7_token_counts(spark, folder):
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", token_counts(spark, pieces, F.col("text")).alias("t")).select("doc_id", "t.n_tokens", "t.score")
