"""The same work on streams, run to the end of what is there and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators.sessions import session_join
from hushframe.plans.policy import OverlayRule, Policy
from hushframe.session import shared_folder
from hushframe.streaming import streams
from hushframe.streaming.rules import RuleSource
from queries.base import Tables, partial_sql, query
from queries.derived import EVENT_PROPOSALS, SESSIONS
from queries.labelling import _MERGED
from queries.records import DEDUP_SQL, _anchored


def _events(spark, sf):
    """The event log as a stream of files."""
    schema = Tables(spark, sf).events.schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _read_back(spark, stream):
    """Run a stream to the end and read what it stored."""
    streams.keep_state_in_rocksdb(spark)
    out = shared_folder(spark, "stream")
    streams.write_stream(stream, out, shared_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_MASKED = f"SELECT event_id, {partial_sql('event_type')} AS event_type, '[redacted]' AS props FROM events"
RULES = Policy(overlay={"event_type": OverlayRule(partial=True), "props": "[redacted]"})


@query("X1_stream_mask", _MASKED)
def masked(spark, sf):
    from hushframe.plans.jobs import mask_table

    stream = _events(spark, sf).select("event_id", "event_type", "props")
    return _read_back(spark, mask_table(stream, RULES))


@query("X2_rule_refresh", _MASKED)
def refreshed(spark, sf):
    out = shared_folder(spark, "masked")
    stream = _events(spark, sf).select("event_id", "event_type", "props")
    rules = RuleSource(lambda: RULES)

    def write(df, batch_id):
        # one folder per batch: a repeated batch replaces itself
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    streams.stream_mask(stream, rules, write, shared_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query(
    "X3_stream_sampler",
    """SELECT 'org1:spark:app:' || event_type AS object_id, 'u' || user_id AS field_path, least(count(*), 2)::BIGINT AS n_samples
    FROM events GROUP BY ALL""",
)
def sampled(spark, sf):
    values = _events(spark, sf).select(
        F.concat(F.lit("org1:spark:app:"), F.col("event_type")).alias("object_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("field_path"),
        F.col("props").alias("value"),
    )
    kept = _read_back(spark, streams.stream_sampler(values, 2))
    return kept.groupBy("object_id", "field_path").agg(F.count(F.lit(1)).alias("n_samples"))


@query(
    "X4_stream_metrics",
    """WITH m AS (SELECT time_bucket(INTERVAL 60 SECOND, ts) AS flushed_from, 'app__' || event_type AS connection_key,
      'UNSPECIFIED' AS entity_type, 'recognizer' AS detection_source, count(*) AS count_analyzed,
      count(*) FILTER (value > 50) AS count_masked, sum(CASE WHEN value > 50 THEN strlen(props) ELSE 0 END)::BIGINT AS bytes_masked
      FROM events GROUP BY ALL)
    SELECT flushed_from::DATE AS day, m.* FROM m""",
)
def metered(spark, sf):
    hit = F.col("value") > 50
    outcomes = _events(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("app__"), F.col("event_type")).alias("connection_key"),
        F.lit("").alias("entity_type"),
        F.lit("recognizer").alias("detection_source"),
        F.lit(1).cast("bigint").alias("count_analyzed"),
        hit.cast("bigint").alias("count_masked"),
        F.when(hit, F.octet_length("props")).otherwise(0).cast("bigint").alias("bytes_masked"),
    )
    out = shared_folder(spark, "metrics")
    streams.stream_metric_batches(outcomes, "ts", out, shared_folder(spark, "checkpoint")).awaitTermination()
    stored = streams.flushed_metrics(spark, out)
    return stored.withColumn("flushed_from", F.col("flushed_from").cast("timestamp_ntz"))


@query("X5_idempotent_dedup", DEDUP_SQL)
def deduplicated(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    out = streams.stream_dedup(e, "user_id", ["event_type"], "ts", 6 * 3600, ["event_id"])
    return _read_back(spark, out).select("event_id", "user_id", "status")


@query(
    "X5_first_of_key",
    "SELECT user_id, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY user_id, event_type",
)
def first_of_key(spark, sf):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    e = _events(spark, sf).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), key.alias("key"))
    kept = _read_back(spark, streams.stream_first_of_key(e, "key", "ts", "60 days"))
    return kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "X6_stream_proposals",
    f"""WITH {EVENT_PROPOSALS}, last AS (SELECT *, row_number() OVER (PARTITION BY object_id, field_path ORDER BY seq DESC) AS rn
      FROM props WHERE source <> 'proposed'), human AS (SELECT * FROM last WHERE rn = 1), {_MERGED}
    SELECT object_id, field_path, coalesce(nullif(match_mode, ''), 'path') AS match_mode, category, source, confidence, sample_count
    FROM human UNION ALL SELECT object_id, field_path, match_mode, category, source, confidence, sample_count FROM merged m
    WHERE NOT EXISTS (SELECT 1 FROM human h WHERE h.object_id = m.object_id AND h.field_path = m.field_path)""",
)
def proposals(spark, sf):
    e = _events(spark, sf)
    source = F.when(F.col("value") > 300, "manual").when(F.col("value") > 250, "dismissed").otherwise("proposed")
    props = e.select(
        F.concat(F.lit("org1:spark:app:"), F.col("event_type")).alias("object_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("field_path"),
        F.when(F.col("value") > 50, "key_any_depth").otherwise("").alias("match_mode"),
        F.when(F.col("value") > 20, "email_fields").otherwise("phone_fields").alias("category"),
        F.when(F.col("value") > 10, "full_redact").otherwise("").alias("profile"),
        source.alias("source"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.floor("value").cast("bigint").alias("sample_count"),
        F.col("ts").cast("timestamp").alias("last_observed_at"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        F.col("event_type").alias("updated_by"),
        F.col("event_id").alias("seq"),
    )
    table = shared_folder(spark, "labels")
    streams.stream_proposals(props, table, shared_folder(spark, "checkpoint")).awaitTermination()
    return streams.latest_version(spark, table).select(
        "object_id", "field_path", "match_mode", "category", "source", "confidence", "sample_count"
    )


@query(
    "X7_stream_rate_flags",
    f"""{_anchored("INTERVAL 1 DAY", ">=")} SELECT event_id, user_id,
      row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) > 3 AS flagged FROM placed""",
)
def rate(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts")
    return _read_back(spark, streams.stream_rate_flags(e, "user_id", "ts", 3, 86_400, ["event_id"])).select(
        "event_id", "user_id", "flagged"
    )


@query(
    "X8_stream_sessions",
    f"""WITH {SESSIONS} SELECT s.session_id, s.actor, e.status,
      round((epoch_us(e.ended_at) - epoch_us(s.started_at)) / 1000000.0, 3)::DOUBLE AS duration_seconds
    FROM starts s JOIN ends e ON e.session_id = s.session_id AND e.session_id <> ''""",
)
def live_sessions(spark, sf):
    """Closed sessions; the open ones of the last hours stay in state until later events arrive."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    starts = e.filter(F.col("event_type").isin("signup", "view")).select(
        F.col("event_id").cast("string").alias("session_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor"),
        F.col("ts").alias("started_at"),
    )
    other = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    ended = F.when(F.col("event_type") == "error", "").otherwise((F.col("event_id") - 1).cast("string"))
    ends = other.filter(F.col("event_type").isin("purchase", "click", "error")).select(
        ended.alias("session_id"), F.col("ts").alias("ended_at"), F.col("event_type").alias("status")
    )
    out = _read_back(spark, session_join(starts, ends, watermark="10 minutes"))
    return out.filter(F.col("status").isNotNull()).select("session_id", "actor", "status", "duration_seconds")
