"""Ordered work per key that stays split when one key holds most of the rows.

Running totals go block by block: totals per block first, their running sum per key, then the rows
inside each block. Windows that open at an event and last a fixed time are chained in the same way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import request_hash
from hushframe.operators.ordered import BLOCK_ROWS, windows_in_order

SECOND = 1_000_000


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch of a timestamp column, or the column itself when it is a number."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.NumericType):
        return F.col(ts).cast("bigint")
    if isinstance(kind, T.TimestampNTZType):
        return _ntz_micros(F.col(ts))
    return F.unix_micros(F.col(ts))


def _ntz_micros(ts: Column) -> Column:
    # clock readings without a zone count as UTC, so that every day has 24 hours
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    # extract gives the seconds with their fraction as a decimal
    fraction = F.extract(F.lit("SECOND"), ts) * SECOND
    return (days * 86400 + seconds) * SECOND + fraction.cast("bigint")


def bucket(col: Column, size: int) -> Column:
    """Whole-number bucket of a bigint, exact for negative and very large values too."""
    return ((col - F.pmod(col, F.lit(size))) / size).cast("bigint")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, keeping the left side's copy of them.

    Fields of equal structs may be null, so one struct of the keys joins by plain equality.
    """
    a = left.withColumn("_key", F.struct(*keys))
    b = right.select(F.struct(*keys).alias("_key"), *[c for c in right.columns if c not in keys])
    return a.join(b, "_key", how).drop("_key")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    values: Mapping[str, Column],
    block: Column,
    totals: bool = False,
) -> DataFrame:
    """Add one running sum per entry of `values`, in `order_by` order within `keys`.

    `block` cuts each key into consecutive ranges of the order and must grow with it. With `totals`
    the sum over the whole key is added as `{name}_total`. Rows are shuffled once, by key and block: the
    join with the block totals and the window use the same struct.
    """
    cut = df.withColumn("_at", F.struct(*keys, block.alias("_block")))
    parts = cut.groupBy("_at").agg(*[F.sum(v).alias(f"_p_{n}") for n, v in values.items()])
    key = [F.col(f"_at.{k}") for k in keys]
    earlier = Window.partitionBy(*key).orderBy("_at._block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    before = parts.select(
        "_at",
        *[F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values],
        *([F.sum(f"_p_{n}").over(whole).alias(f"{n}_total") for n in values] if totals else []),
    )
    within = (
        Window.partitionBy("_at").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = cut.join(before, "_at")
    out = joined.withColumns({n: F.col(f"_b_{n}") + F.sum(v).over(within) for n, v in values.items()})
    return out.drop("_at", *[f"_b_{n}" for n in values])


def transcript_cap(
    df: DataFrame,
    session: str,
    order_by: str,
    text: str,
    max_bytes: int = 5 << 20,
    block_rows: int = 10_000,
) -> DataFrame:
    """Number the chunks of a session and keep them while their bytes fit.

    Adds `seq` (from 0, null for a dropped or empty chunk), `kept` and `truncated`. `order_by` is a
    number; a block holds the chunks of `block_rows` consecutive numbers.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    out = running_total(
        df,
        [session],
        [F.col(order_by)],
        {"_bytes": size, "_chunks": (size > 0).cast("bigint")},
        bucket(F.col(order_by).cast("bigint"), block_rows),
        totals=True,
    )
    kept = (size > 0) & (F.col("_bytes") <= max_bytes)
    return out.select(
        *df.columns,
        F.when(kept, F.col("_chunks") - 1).alias("seq"),
        kept.alias("kept"),
        (F.col("_bytes_total") > max_bytes).alias("truncated"),
    )


# --- windows that open at an event -----------------------------------------------------------------


def anchored_windows(df: DataFrame, keys: Sequence[str], ts: str, width: int, block_rows: int = BLOCK_ROWS, partitions: int | None = None) -> DataFrame:
    """Add `window_start`: a window opens at the first event of a key, lasts `width`, and the next event
    at or after its end opens the next one. `ts` and `width` are whole numbers of one unit. See `ordered`.
    """
    key = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"})
    placed = windows_in_order(df, key, F.col(ts), width, block_rows=block_rows, partitions=partitions)
    return placed.select(*df.columns, F.col("_start").alias("window_start"))


def rate_flags(
    df: DataFrame,
    key: str,
    ts: str,
    limit: int,
    window_seconds: int = 60,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add `flagged`: true for events of a key beyond `limit` in its current window.

    Flagged events count too. A limit of 0 or less, or an empty key, switches the check off.
    """
    if limit <= 0:
        return df.withColumn("flagged", F.lit(False))
    live = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    placed = windows_in_order(df.filter(live), F.col(key), micros(df, ts), window_seconds * SECOND, tie)
    on = placed.select(*df.columns, (F.col("_rank") > limit).alias("flagged"))
    off = df.filter(~live).withColumn("flagged", F.lit(False))
    return on.unionByName(off)


def idempotent_dedup(
    df: DataFrame,
    key: str,
    parts: Sequence[str],
    ts: str,
    ttl_seconds: int = 600,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add `request_hash` and `status`: new, duplicate (same request) or conflict (another one).

    An accepted request holds its key for the time to live, counted from that request. A request
    without a key is always new.
    """
    live = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    request = request_hash(*[F.col(p).cast("string") for p in parts])
    hashed = df.withColumn("request_hash", request)
    # an entry still holds at the very end of its time
    width = ttl_seconds * SECOND + 1
    # rows travel with the tag, not with the hash as text beside it
    lean = hashed if "request_hash" in (key, *tie) else df
    placed = windows_in_order(lean.filter(live), F.col(key), micros(df, ts), width, tie, tag=F.unhex(request)).withColumn("request_hash", request)
    status = (
        F.when(F.col("_rank") == 1, F.lit("new"))
        .when(F.unhex("request_hash") == F.col("_first_tag"), F.lit("duplicate"))
        .otherwise(F.lit("conflict"))
    )
    columns = [*df.columns, "request_hash"]
    on = placed.select(*columns, status.alias("status"))
    return on.unionByName(hashed.filter(~live).select(*columns, F.lit("new").alias("status")))


def peak_concurrency(
    sessions: DataFrame, key: str, start: str, end: str, cap: int | None = None, block_seconds: int = 3600
) -> DataFrame:
    """Most sessions open at once per key, when that was first so, and at how many instants `cap`
    was exceeded.

    A session without an end stays open. Ends count before starts of the same instant.
    """
    us_start, us_end = micros(sessions, start), micros(sessions, end)
    marks = sessions.filter(F.col(start).isNotNull()).select(
        key,
        F.inline(
            F.array(
                F.struct(us_start.alias("us"), F.lit(1).cast("bigint").alias("step")),
                F.struct(us_end.alias("us"), F.lit(-1).cast("bigint").alias("step")),
            )
        ),
    )
    # one row per key and instant before anything is ordered
    steps = marks.filter(F.col("us").isNotNull()).groupBy(key, "us").agg(F.sum("step").alias("step"))
    block = bucket(F.col("us"), block_seconds * SECOND)
    open_now = running_total(steps, [key], [F.col("us")], {"open": F.col("step")}, block)
    out = open_now.groupBy(key).agg(
        F.max("open").alias("peak"),
        F.min_by("us", F.struct(-F.col("open"), F.col("us"))).alias("peak_us"),
        *([F.count_if(F.col("open") > cap).alias("instants_over_cap")] if cap is not None else []),
    )
    if cap is not None:
        out = out.withColumn("over_cap", F.col("peak") > cap)
    return out
