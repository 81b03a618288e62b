"""Query of cross-tokenizer alignment."""

from __future__ import annotations

import public_tokenizers

from hushframe.llm.alignment import align
from hushframe.llm.registry import query, table


@query("op12_alignment")
def op12_alignment(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).drop("groups")
