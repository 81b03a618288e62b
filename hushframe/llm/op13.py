"""Query of whitened embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.llm.registry import query, table
from hushframe.llm.whitening import whiten


@query("op13_whitening")
def op13_whitening(spark, folder):
    rows = whiten(table(spark, folder, "embeddings"))
    # sums that outgrow 64 bits (beyond some million rows) are null here; the operator has them as decimals
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
