"""Query of mixture-controlled packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hushframe.llm.packing import pack
from hushframe.llm.registry import query, table


@query("op3_packing")
def op3_packing(spark, folder):
    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
