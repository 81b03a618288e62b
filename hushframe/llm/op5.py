"""Query of token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hushframe.llm import rans
from hushframe.llm.registry import query, table


@query("op5_rans_tokens")
def op5_rans_tokens(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = rans.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return back.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
