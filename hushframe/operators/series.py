"""Metric series over an event table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.windows import SECOND, micros, running_total

MAX_MINUTES = 1440
LAG_SECONDS = 120

_STATS = {
    "Sum": F.sum,
    "Average": F.avg,
    "Maximum": F.max,
}
_PERCENTILES = {"p99": 0.99}
#: Parts of a period's value range that are ordered apart when a percentile is selected.
PARTS = 256


@dataclass(frozen=True)
class Series:
    """One series: which events it covers and how a period is summed up."""

    id: str
    stat: str
    label: str
    where: Column | None = None


def period_seconds(span_seconds: int) -> int:
    """Finer periods for shorter spans."""
    if span_seconds <= 3600:
        return 60
    return 300 if span_seconds <= 2 * 86_400 else 900


def time_range(minutes: int, now: dt.datetime) -> tuple[int, int, int]:
    """(start, end, period) in epoch seconds; the freshest two minutes are left out."""
    minutes = min(max(minutes, 1), MAX_MINUTES)
    end = int(now.replace(tzinfo=now.tzinfo or dt.timezone.utc).timestamp())
    start = end - minutes * 60
    period = period_seconds(end - start)
    end -= LAG_SECONDS
    if end <= start:
        end = start + max(period, 60)
    return start, end, period


def grouped_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """The exact percentile of `value` per group, interpolated between its neighbours: keys, v. Nulls do not count.

    Equal values become one row with their number first. The range of a group is cut into `PARTS`; parts are added up,
    then the values inside each part, so the values of a group are never in one task or one buffer.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    at = [F.col(k).alias(f"_g_{k}") for k in keys]
    real = F.when(~F.isnan("_v") & (F.abs("_v") != float("inf")), F.col("_v"))
    bounds = counted.groupBy(*at).agg(F.min(real).alias("_low"), F.max(real).alias("_high"), F.sum("_n").alias("_all"))
    on = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    placed = counted.join(bounds, on)
    share = (F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    part = F.when(F.isnan("_v") | (F.col("_v") == float("inf")), PARTS + 1).when(F.col("_v") == float("-inf"), -1)
    part = F.coalesce(part, F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * PARTS), F.lit(0)).cast("bigint")
    ranked = running_total(placed, list(keys), [F.col("_v")], {"_to": F.col("_n")}, part)
    position = F.lit(p) * (F.col("_all") - 1)
    low, high = F.floor(position), F.ceil(position)
    holds = lambda rank: (F.col("_to") - F.col("_n") <= rank) & (rank < F.col("_to"))
    pair = ranked.groupBy(*keys).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(high), F.col("_v"))).alias("_b"),
        F.max(position).alias("_p"),
    )
    between = (F.ceil("_p") - F.col("_p")) * F.col("_a") + (F.col("_p") - F.floor("_p")) * F.col("_b")
    return pair.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("v"))


def metric_series(
    df: DataFrame, ts: str, value: str, specs: Sequence[Series], now: dt.datetime, minutes: int = 60
) -> DataFrame:
    """series_id, label, t (epoch seconds), v; a series without points has one row with nulls.

    Sums, averages and maxima of all series come from one pass, percentiles from a second one that selects them by
    counted values (`grouped_percentile`).
    """
    start, end, period = time_range(minutes, now)
    us = micros(df, ts)
    recent = df.filter((us >= start * SECOND) & (us < end * SECOND))
    if "timestamp" in df.schema[ts].dataType.simpleString():
        # a plain comparison on the stored column reaches the file scan
        low, high = (dt.datetime.fromtimestamp(s, dt.timezone.utc) for s in (start - 86_400, end + 86_400))
        bound = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast(df.schema[ts].dataType)
        recent = recent.filter((F.col(ts) >= bound(low)) & (F.col(ts) < bound(high)))
    slot = (F.floor(us / (period * SECOND)) * period).cast("double")

    def stat(s: Series) -> Column:
        v = F.col(value) if s.where is None else F.when(s.where, F.col(value))
        return _STATS[s.stat](v).cast("double")

    found = []
    plain = [s for s in specs if s.stat in _STATS]
    if plain:
        per_slot = recent.groupBy(slot.alias("t")).agg(*[stat(s).alias(f"_{i}") for i, s in enumerate(plain)])
        each = [F.struct(F.lit(s.id).alias("series_id"), F.col(f"_{i}").alias("v")) for i, s in enumerate(plain)]
        found.append(per_slot.select("t", F.inline(F.array(*each))))
    for p in sorted({_PERCENTILES[s.stat] for s in specs if s.stat in _PERCENTILES}):
        own = [s for s in specs if _PERCENTILES.get(s.stat) == p]
        # the values of each series that a row belongs to
        value_of = lambda s: F.col(value) if s.where is None else F.when(s.where, F.col(value))
        rows = recent.select(
            slot.alias("t"), F.inline(F.array(*[F.struct(F.lit(s.id).alias("series_id"), value_of(s).cast("double").alias("v")) for s in own]))
        )
        found.append(grouped_percentile(rows, ["t", "series_id"], "v", p).select("t", "series_id", "v"))
    points = reduce(DataFrame.unionByName, found).filter(F.col("v").isNotNull())
    names = df.sparkSession.createDataFrame([(s.id, s.label) for s in specs], "series_id string, label string")
    # one row per asked series against at most 1,440 periods each
    return names.join(points, "series_id", "left").select("series_id", "label", "t", "v")


def series_fallback(series: DataFrame, main: str, alt: str) -> DataFrame:
    """Give `main` the points of `alt` when it has none; `alt` itself is not shown."""
    pair = series.filter(F.col("series_id").isin(main, alt))
    counts = pair.agg(
        F.count(F.when(F.col("series_id") == main, F.col("v"))).alias("main_n"),
        F.count(F.when(F.col("series_id") == alt, F.col("v"))).alias("alt_n"),
    )
    swap = (F.col("main_n") == 0) & (F.col("alt_n") > 0)
    # one row: which of the two series to show under the name of the main one
    chosen = counts.select(F.when(swap, F.lit(alt)).otherwise(F.lit(main)).alias("series_id"))
    label = series.filter(F.col("series_id") == main).select(F.lit(main).alias("_main"), "label").distinct()
    shown = (
        pair.drop("label")
        .join(F.broadcast(chosen), "series_id", "left_semi")
        .withColumn("_main", F.lit(main))
        .join(F.broadcast(label), "_main")
        .select(F.col("_main").alias("series_id"), "label", "t", "v")
    )
    return series.filter(~F.col("series_id").isin(main, alt)).unionByName(shown)


def series_table(series: DataFrame) -> DataFrame:
    """One row per series with its points in order; an empty list when there are none."""
    point = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    return series.groupBy("series_id", "label").agg(F.array_sort(F.collect_list(point)).alias("datapoints"))
