"""Sessions from their start and end records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_join(starts: DataFrame, ends: DataFrame, watermark: str | None = None, max_length: str = "1 day") -> DataFrame:
    """Every started session with its end; an open one keeps nulls, an end without an id is dropped.

    `starts` has session_id and started_at, `ends` has session_id and ended_at. With `watermark` both
    sides are streams and a session counts as open once no end within `max_length` can arrive.
    """
    right = ends.filter(F.coalesce("session_id", F.lit("")) != "")
    if watermark is None:
        joined = starts.join(right, "session_id", "left")
    else:
        late = right.withColumnRenamed("session_id", "_end_id").withWatermark("ended_at", watermark)
        on = (
            (F.col("session_id") == F.col("_end_id"))
            & (F.col("ended_at") >= F.col("started_at"))
            & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {max_length}"))
        )
        joined = starts.withWatermark("started_at", watermark).join(late, on, "left").drop("_end_id")
    seconds = F.col("ended_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    return joined.withColumn("duration_seconds", F.round(seconds, 3))
