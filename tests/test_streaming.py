import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from hushframe.operators import labels, windows
from hushframe.operators.metrics import masking_metrics
from hushframe.operators.sessions import session_join
from hushframe.plans.policy import Policy
from hushframe.session import shared_folder
from hushframe.streaming import streams
from hushframe.streaming.rules import RuleSource

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def source(spark):
    """Write batches as files in order and read them one file per trigger."""

    def make(schema, *batches):
        path = shared_folder(spark, "in")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return stream, spark.createDataFrame([r for b in batches for r in b], schema)

    return make


def run(spark, df):
    out = shared_folder(spark, "out")
    streams.write_stream(df, out, shared_folder(spark, "cp")).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rate_flags_match_batch(spark, source):
    rng = random.Random(2)
    times = sorted(rng.randrange(3000) for _ in range(400))
    data = [(i, rng.choice("ab"), at(t)) for i, t in enumerate(times)]
    stream, whole = source("i int, k string, ts timestamp", data[:150], data[150:300], data[300:])
    got = run(spark, streams.stream_rate_flags(stream, "k", "ts", 3, 60, ["i"]))
    assert rows(got) == rows(windows.rate_flags(whole, "k", "ts", 3, 60, ["i"]))


def test_dedup_matches_batch(spark, source):
    rng = random.Random(4)
    times = sorted(rng.randrange(9000) for _ in range(300))
    data = [(i, rng.choice("abc"), rng.choice(["q1", "q2"]), at(t)) for i, t in enumerate(times)]
    stream, whole = source("i int, k string, q string, ts timestamp", data[:100], data[100:])
    got = run(spark, streams.stream_dedup(stream, "k", ["q"], "ts", 600, ["i"]))
    assert rows(got) == rows(windows.idempotent_dedup(whole, "k", ["q"], "ts", 600, ["i"]))


def test_sampler(spark, source):
    data = [("o", "f", f"v{i}") for i in range(6)] + [("o", "g", ""), ("o", "g", "x"), ("", "f", "y")]
    stream, _ = source("object_id string, field_path string, value string", data[:4], data[4:])
    got = run(spark, streams.stream_sampler(stream, 5))
    assert got.filter("field_path = 'f'").count() == 5 and got.filter("field_path = 'g'").count() == 1
    assert sorted(r["sample_no"] for r in got.filter("field_path = 'f'").collect()) == list(range(5))


def test_masking_with_refreshed_rules(spark, source):
    stream, _ = source("i int, email string", [(1, "a")], [(2, "b")], [(3, "c")])
    versions = iter([Policy(overlay={"email": "[one]"}), Policy(overlay={"email": "[two]"}), None])
    clock = iter([0, 20, 40])

    def load():
        nxt = next(versions)
        if nxt is None:
            raise RuntimeError("store is down")
        return nxt

    seen = {}

    def write(df, batch_id):
        seen[batch_id] = [r["email"] for r in df.collect()]

    rules = RuleSource(load, 15, clock=lambda: next(clock))
    streams.stream_mask(stream, rules, write, shared_folder(spark, "cp")).awaitTermination()
    assert seen == {0: ["[one]"], 1: ["[two]"], 2: ["[two]"]} and rules.failures == 1


def test_rule_source_limits():
    calls = []
    once = RuleSource(lambda: calls.append(1) or len(calls), -1, clock=lambda: 1e9)
    assert (once.current(), once.current()) == (1, 1)
    now = [0.0]
    often = RuleSource(lambda: calls.append(1) or len(calls), 1, clock=lambda: now[0])
    first = often.current()
    now[0] = 14
    assert often.current() == first
    now[0] = 15
    assert often.current() == first + 1
    with pytest.raises(RuntimeError):
        RuleSource(lambda: (_ for _ in ()).throw(RuntimeError())).current()


def test_metrics_match_batch(spark, source):
    data = [(at(t), "pg__r", "EMAIL_ADDRESS" if t % 3 else "", "recognizer", 0, 1, t) for t in range(0, 300, 7)]
    late = [(at(100_000), "pg__r", "X", "recognizer", 1, 0, 0)]
    schema = "ts timestamp, connection_key string, entity_type string, detection_source string, count_analyzed bigint, count_masked bigint, bytes_masked bigint"
    stream, whole = source(schema, data, late, late)
    got = run(spark, streams.stream_metrics(stream, "ts")).filter(F.col("flushed_from") < at(1000))
    want = masking_metrics(whole.filter(F.col("ts") < at(1000)), [F.window("ts", "60 seconds").alias("w")])
    assert rows(got.drop("day")) == rows(want.select("w.start", *want.columns[1:]))


def test_proposals_are_idempotent(spark, source):
    names = [p.split()[0] for p in labels.LABEL_SCHEMA.split(", ")]
    base = dict(object_id="o", field_path="f", match_mode="path", category="c", profile="", source="proposed",
                confidence=0.5, sample_count=1, last_observed_at=T0, updated_at=T0, updated_by="x")
    make = lambda seq, **kw: (*[{**base, **kw}[n] for n in names], seq)
    schema = labels.LABEL_SCHEMA + ", seq bigint"
    stream, whole = source(schema, [make(1), make(2, field_path="g")], [make(3, sample_count=5), make(4, field_path="g", source="manual")])
    table, cp = shared_folder(spark, "labels"), shared_folder(spark, "cp")
    for _ in range(2):  # the second run finds nothing new
        streams.stream_proposals(stream, table, cp).awaitTermination()
    got = streams.latest_version(spark, table)
    want = labels.upsert_labels(spark.createDataFrame([], labels.LABEL_SCHEMA), whole)
    assert rows(got.select(names)) == rows(want.select(names))


def test_sessions(spark, source):
    starts, s_whole = source("session_id string, started_at timestamp", [("a", at(0)), ("b", at(10)), ("c", at(20))], [("z", at(500_000))], [("z2", at(500_001))])
    ends, e_whole = source("session_id string, ended_at timestamp, status string", [("a", at(65), "ok"), ("", at(70), "lost"), ("b", at(80), "ok")], [("y", at(500_000), "ok")], [("y2", at(500_001), "ok")])
    got = run(spark, session_join(starts, ends, watermark="10 minutes")).filter(F.col("started_at") < at(1000))
    want = session_join(s_whole, e_whole).filter(F.col("started_at") < at(1000)).select(got.columns)
    assert rows(got) == rows(want)
    assert {r["session_id"]: r["duration_seconds"] for r in want.collect()} == {"a": 65.0, "b": 70.0, "c": None}


def test_first_of_key(spark, source):
    stream, _ = source("k string, ts timestamp", [("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(3))])
    assert run(spark, streams.stream_first_of_key(stream, "k", "ts")).count() == 2


def test_rows_without_key_and_expiry(spark, source):
    data = [(i, None if i % 5 == 0 else "" if i % 5 == 1 else f"k{i % 2}", "q", at(7 * i)) for i in range(60)]
    stream, whole = source("i int, k string, q string, ts timestamp", data[:20], data[20:40], data[40:])
    for lateness in (None, "1 minute"):
        got = run(spark, streams.stream_rate_flags(stream, "k", "ts", 3, 60, ["i"], lateness))
        assert rows(got) == rows(windows.rate_flags(whole, "k", "ts", 3, 60, ["i"]))
        got = run(spark, streams.stream_dedup(stream, "k", ["q"], "ts", 60, ["i"], lateness))
        assert rows(got) == rows(windows.idempotent_dedup(whole, "k", ["q"], "ts", 60, ["i"]))


def test_keys_share_groups_of_state(spark, source):
    # a group per key costs milliseconds per key
    data = [(i, f"k{i % 50}", "q", at(i)) for i in range(200)]
    stream, whole = source("i int, k string, q string, ts timestamp", data[:100], data[100:])
    fields = stream.select(F.lit("o").alias("object_id"), F.col("k").alias("field_path"), F.col("i").cast("string").alias("value"))
    made = [streams.stream_dedup(stream, "k", ["q"], "ts", 60, ["i"], buckets=4), streams.stream_rate_flags(stream, "k", "ts", 1, 60, ["i"], buckets=4), streams.stream_sampler(fields, 3, buckets=4)]
    for df in made:
        out = shared_folder(spark, "out")
        query = streams.write_stream(df, out, shared_folder(spark, "cp"))
        query.awaitTermination()
        assert 1 <= query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
        got = spark.read.schema(df.schema).parquet(out)
        if df is made[0]:
            assert rows(got) == rows(windows.idempotent_dedup(whole, "k", ["q"], "ts", 60, ["i"]))
        elif df is made[1]:
            assert rows(got) == rows(windows.rate_flags(whole, "k", "ts", 1, 60, ["i"]))
        else:
            numbers = sorted((r["field_path"], r["sample_no"]) for r in got.collect())
            assert numbers == sorted((f"k{k}", n) for k in range(50) for n in range(3))


def test_long_numbers_beside_missing_ones(spark, source):
    big = (1 << 53) + 1
    data = [(big, 7, "q", at(0)), (None, 7, "q", at(1)), (big + 2, 7, "q", at(1)), (big + 1, 7, "q", at(1))]
    stream, _ = source("i bigint, k bigint, q string, ts timestamp", data)
    got = run(spark, streams.stream_dedup(stream, "k", ["q"], "ts", 60, ["i"], buckets=1))
    assert {r["i"] for r in got.collect()} == {big, big + 1, big + 2, None}
    got = run(spark, streams.stream_rate_flags(stream, "k", "ts", 2, 60, ["i"], buckets=1))
    assert {r["i"] for r in got.collect() if r["flagged"]} == {big + 2, None}


def test_kept_values_leave_after_their_time():
    # run by hand: with a time to live Spark never ends a query that only takes what is there
    sample, value, seen = streams._sample(2, 1000), None, []
    for now in (5, 905, 1005, 1904):
        state = GroupState(value, now, -1, "ProcessingTimeTimeout", False, False, value is not None, False, False, -1, b"", None)
        rows_in = pd.DataFrame({"object_id": ["o"], "field_path": ["f"], "value": [str(now)]})
        for pdf in sample((0,), iter([rows_in]), state):
            seen += [(r.sample_no, r.value) for r in pdf.itertuples()]
        value = state.get
    assert seen == [(0, "5"), (1, "905"), (1, "1005")]
