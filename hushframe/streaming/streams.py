"""Masking, counting, sampling and audits over streams.

A stateful operator handles the rows of one bucket of keys in one micro-batch together; bound the batch at the
source (maxFilesPerTrigger, maxOffsetsPerTrigger). Batches are expected in time order; an event that is older than the
window its key has open counts into that window. With `lateness` the state of a key leaves by event time, after the
watermark has passed its window; Spark then also drops events that come later than that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushframe.functions.text import request_hash
from hushframe.operators import metrics as counts
from hushframe.operators.labels import LABEL_SCHEMA, upsert_labels
from hushframe.operators.windows import SECOND, micros
from hushframe.plans.jobs import mask_table
from hushframe.plans.policy import Policy
from hushframe.streaming.rules import RuleSource

# State lies in this many groups of keys. A stream whose batches are small beside the keys it remembers wants more; the
# number cannot change under a checkpoint.
BUCKETS = 1 << 13

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The state operators below need it; a provider the user has chosen already stays."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def write_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to files; without `every` what is there is processed and the query ends."""
    return _start(df.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, every)


def stream_mask(
    stream: DataFrame,
    rules: RuleSource[Policy],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Mask each micro-batch with the rules of the day. `write(batch, batch_id)` stores the result.

    For rules that never change, mask_table works on the stream itself.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        write(mask_table(df, rules.current()), batch_id)

    return _start(stream.writeStream.foreachBatch(batch), checkpoint, every)


def stream_metrics(outcomes: DataFrame, ts: str, flush: str = "60 seconds", lateness: str = "60 seconds") -> DataFrame:
    """Metric sums per flush interval with the day they count for (UTC)."""
    window = F.window(F.col(ts), flush)
    sums = counts.masking_metrics(outcomes.withWatermark(ts, lateness), [window.alias("window")])
    return sums.select(
        F.to_date("window.start").alias("day"),
        F.col("window.start").alias("flushed_from"),
        *counts.KEYS,
        *counts.COUNTS,
    )


def stream_metric_batches(
    outcomes: DataFrame, ts: str, path: str, checkpoint: str, flush: str = "60 seconds", every: str | None = None
) -> StreamingQuery:
    """Metric sums per flush interval without any state: each batch writes the sums of its own rows.

    Nothing is held back for a watermark, so the last intervals come out when the stream stops. A batch that is run
    again replaces its folder. An interval that two batches touch has a row of each: `flushed_metrics` adds them up.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        sums = counts.masking_metrics(df, [F.window(F.col(ts), flush).alias("window")])
        sums = sums.select(F.to_date("window.start").alias("day"), F.col("window.start").alias("flushed_from"), *counts.KEYS, *counts.COUNTS)
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(outcomes.writeStream.foreachBatch(batch), checkpoint, every)


def flushed_metrics(spark: SparkSession, path: str) -> DataFrame:
    """What `stream_metric_batches` has written, one row per interval and bucket."""
    keys = ["day", "flushed_from", *counts.KEYS]
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts.COUNTS])


def _in_buckets(df: DataFrame, buckets: int, *keys: str) -> GroupedData:
    """Many keys as one group: a group of its own for each key costs milliseconds per key."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


def _sample(n: int, ttl_ms: int | None):
    """The first `n` values of each field of one bucket. The state has, per field, times and how many values were kept
    then, in turn (time 0 without a `ttl_ms`)."""

    def sample(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, kept = 0, {}
        if ttl_ms is not None:
            now = state.getCurrentProcessingTimeMs()
        for o, f, pairs in zip(*state.get) if state.exists else ():
            live = [x for t, m in zip(pairs[::2], pairs[1::2]) if ttl_ms is None or now - t < ttl_ms for x in (t, m)]
            if live:
                kept[o, f] = live
        fresh = []
        for pdf in rows:
            for o, f, v in zip(pdf["object_id"], pdf["field_path"], pdf["value"]):
                pairs = kept.get((o, f))
                have = sum(pairs[1::2]) if pairs else 0
                if have >= n:
                    continue
                if not pairs:
                    kept[o, f] = [now, 1]
                elif pairs[-2] == now:
                    pairs[-1] += 1
                else:
                    pairs += [now, 1]
                fresh.append((o, f, have, v))
        if not kept:
            state.remove()
            return
        state.update(([o for o, _ in kept], [f for _, f in kept], list(kept.values())))
        if ttl_ms is not None:
            state.setTimeoutDuration(max(1, max(x[-2] for x in kept.values()) + ttl_ms - now))
        if fresh:
            yield pd.DataFrame(fresh, columns=["object_id", "field_path", "sample_no", "value"])

    return sample


def stream_sampler(values: DataFrame, n: int = 20, ttl_seconds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The first `n` values of each field as they arrive: object_id, field_path, sample_no, value.

    `values` has object_id, field_path and value; blanks are dropped. A field that outlives
    `ttl_seconds` without growing is sampled anew.
    """
    live = values.filter(
        (F.coalesce("value", F.lit("")) != "")
        & (F.coalesce("object_id", F.lit("")) != "")
        & (F.coalesce("field_path", F.lit("")) != "")
    ).select("object_id", "field_path", "value")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # more than `n` values of a field are never needed, so a hot field sends few rows to its state
        for pdf in batches:
            yield pdf.groupby(["object_id", "field_path"], sort=False).head(n)

    return _in_buckets(live.mapInPandas(cut, live.schema), buckets, "object_id", "field_path").applyInPandasWithState(
        _sample(n, None if ttl_seconds is None else ttl_seconds * 1000),
        outputStructType="object_id string, field_path string, sample_no int, value string",
        stateStructType="object_ids array<string>, field_paths array<string>, kept array<array<bigint>>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def _number(df: DataFrame, c: str) -> Column | None:
    """A 64-bit number or a time as a number; None for other columns."""
    kind = df.schema[c].dataType
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.col(c) if isinstance(kind, T.LongType) else None


def _order(places: Sequence[Column], exact: Sequence[bool]) -> dict[str, Column]:
    """Columns to sort by in pandas, missing values last. Beside missing ones pandas would round a 64-bit number."""
    out = {}
    for i, (place, number) in enumerate(zip(places, exact)):
        if number:
            out[f"missing_{i}"] = place.isNull()
        out[f"order_{i}"] = F.coalesce(place, F.lit(0)) if number else place
    return out


def _windowed(
    live: DataFrame,
    by: tuple[str, str, Sequence[str]],
    step: Callable,
    reads: str,
    width: int,
    state: T.StructType,
    result: T.StructField,
    lateness: str | None,
    buckets: int,
) -> DataFrame:
    """Each key's rows of a micro-batch in order through `step(window, time, value of reads) -> window, result`;
    `by` names key, time and tie-breaking columns.

    A window is a tuple that begins with its start; the state of a bucket holds its keys' windows. With `lateness`
    a window leaves once the watermark has passed its end: when its bucket is read again, or when all of it has ended.
    """
    key, ts, tie = by
    numbers = {c: _number(live, c) for c in live.columns}
    places = [micros(live, ts), *(F.col(c) if numbers[c] is None else numbers[c] for c in tie)]
    order = _order(places, [True, *(numbers[c] is not None for c in tie)])
    own = F.col(key) if numbers[key] is None else numbers[key]
    if isinstance(live.schema[key].dataType, T.FractionalType) and not isinstance(live.schema[key].dataType, T.DecimalType):
        own = (own + F.lit(0.0)).cast("string")  # one key for both zeros, one for all that are no number
    # numbers go as text, which no missing value rounds
    payload = {f"column_{i}": F.col(c) if numbers[c] is None else numbers[c].cast("string") for i, c in enumerate(live.columns)}
    timed = {"event_time": F.col(ts)} if lateness else {}
    wanted = {"key": own, "read": F.col(reads), **order, **payload, **timed}
    sorting, carried, name = list(order), list(payload), result.name  # tasks get the names only
    late = live.withWatermark(ts, lateness) if lateness else live
    rows_ = late.select(*[x.alias(c) for c, x in wanted.items()])

    def run(_, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        windows = {k: tuple(w) for k, *w in zip(*held.get)} if held.exists else {}
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(sorting, kind="stable", ignore_index=True)
        found = []
        for k, missing, us, value in zip(*(pdf[c].tolist() for c in ("key", "missing_0", "order_0", "read"))):
            windows[k], x = step(windows.get(k), math.nan if missing else us, value)
            found.append(x)
        if lateness:
            passed = held.getCurrentWatermarkMs()
            windows = {k: w for k, w in windows.items() if (w[0] + width) // 1000 >= passed}
        if windows:
            held.update((list(windows), *map(list, zip(*windows.values()))))
            if lateness:
                held.setTimeoutTimestamp(max(1, *((w[0] + width) // 1000 for w in windows.values())))
        else:
            held.remove()
        out = pdf[carried].copy()
        out[name] = found
        yield out

    made = _in_buckets(rows_, buckets, "key").applyInPandasWithState(
        run,
        outputStructType=T.StructType([*(rows_.schema[c] for c in carried), result]),
        stateStructType=T.StructType(
            [T.StructField("keys", T.ArrayType(rows_.schema["key"].dataType)), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in state)]
        ),
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout if lateness else GroupStateTimeout.NoTimeout,
    )

    def back(i: int, f: T.StructField) -> Column:
        c = F.col(f"column_{i}")
        if numbers[f.name] is not None:
            c = c.cast("bigint")
        return (F.timestamp_micros(c) if isinstance(f.dataType, T.TimestampType) else c).alias(f.name)

    return made.select(*[back(i, f) for i, f in enumerate(live.schema.fields)], result.name)


def stream_rate_flags(
    stream: DataFrame, key: str, ts: str, limit: int, window_seconds: int = 60, tie: Sequence[str] = (), lateness: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """rate_flags on a stream whose batches arrive in time order; rows without a key are never flagged."""
    if limit <= 0:
        return stream.withColumn("flagged", F.lit(False))
    live, free = _with_and_without_key(stream, key)
    width = window_seconds * SECOND

    def step(window, us, _):
        if window is None or us - window[0] >= width:
            window = (int(us), 1)
        else:
            window = (window[0], window[1] + 1)
        return window, window[1] > limit

    state = T.StructType().add("start", "long").add("count", "long")
    result = T.StructField("flagged", T.BooleanType())
    flagged = _windowed(live, (key, ts, tie), step, key, width, state, result, lateness, buckets)
    return flagged.unionByName(free.withColumn("flagged", F.lit(False)))


def _with_and_without_key(stream: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    named = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return stream.filter(named), stream.filter(~named)


def stream_dedup(
    stream: DataFrame,
    key: str,
    parts: Sequence[str],
    ts: str,
    ttl_seconds: int = 600,
    tie: Sequence[str] = (),
    lateness: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """idempotent_dedup on a stream whose batches arrive in time order; rows without a key are new."""
    hashed = stream.withColumn("request_hash", request_hash(*[F.col(p).cast("string") for p in parts]))
    live, free = _with_and_without_key(hashed, key)
    ttl = ttl_seconds * SECOND

    def step(window, us, request):
        if window is None or us - window[0] > ttl:
            return (int(us), request), "new"
        return window, "duplicate" if request == window[1] else "conflict"

    state = T.StructType().add("start", "long").add("hash", "string")
    result = T.StructField("status", T.StringType())
    found = _windowed(live, (key, ts, tie), step, "request_hash", ttl, state, result, lateness, buckets)
    return found.unionByName(free.withColumn("status", F.lit("new")))


def stream_first_of_key(stream: DataFrame, key: str, ts: str, ttl: str = "10 minutes") -> DataFrame:
    """The plain case: repeats of a key within `ttl` are dropped."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def stream_proposals(
    stream: DataFrame, table: str, checkpoint: str, order_by: str = "seq", every: str | None = None
) -> StreamingQuery:
    """Merge arriving proposals and decisions into a label table, one version folder per batch.

    A batch that is run again writes the same version from the one before, so nothing counts twice.
    The current labels are the rows of the highest version.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if batch_id == 0:
            current = spark.createDataFrame([], LABEL_SCHEMA)
        else:
            current = spark.read.schema(LABEL_SCHEMA).parquet(f"{table}/version={batch_id - 1}")
        upsert_labels(current, df, order_by).write.mode("overwrite").parquet(f"{table}/version={batch_id}")

    return _start(stream.writeStream.foreachBatch(batch), checkpoint, every)


def latest_version(spark: SparkSession, table: str) -> DataFrame:
    """The label table as the last batch left it."""
    versions = spark.read.parquet(table)
    top = versions.agg(F.max("version")).first()[0]
    if top is None:
        return versions.drop("version")
    return versions.filter(F.col("version") == top).drop("version")
