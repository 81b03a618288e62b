import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import metrics, sessions
from hushframe.operators import series as ser
from hushframe.plans import jobs
from hushframe.plans.policy import Detection, OverlayRule, PathLabel, Policy
from hushframe.session import shared_folder
from hushframe.sources import rules, sinks, tables

OBJ = "o:spark:db:t"
OUTCOME = "connection_key string, entity_type string, detection_source string, count_analyzed bigint, count_masked bigint, bytes_masked bigint"


def sums(df):
    return {(r["entity_type"], r["detection_source"]): (r["count_analyzed"], r["count_masked"], r["bytes_masked"]) for r in df.collect()}


def test_outcomes_of_a_chain(spark):
    df = spark.createDataFrame(
        [("a@x.io and 10.0.0.1", "jane@example.com", 12345), ("abc", None, None)], "note string, mail string, n int"
    )
    policy = Policy(
        object_id=OBJ,
        detection=Detection(),
        overlay={"mail": OverlayRule(partial=True)},
        labels=[PathLabel("mail", "partial_mask", "email_fields"), PathLabel("n", "", ""), PathLabel("note", "do_not_mask", "x")],
    )
    got = sums(metrics.masking_metrics(metrics.outcome_rows(df, policy, F.lit("c"))))
    assert got == {
        # "abc" is too short for detection; spans count their characters
        ("UNSPECIFIED", "recognizer"): (2, 0, 0),
        ("EMAIL_ADDRESS", "recognizer"): (0, 2, 6 + 16),
        ("IP_ADDRESS", "recognizer"): (0, 1, 8),
        # every non-null value is looked up; the number is masked under no category
        ("UNSPECIFIED", "field_rule"): (4, 1, 5),
        # measured after detection and overlay: "[redacted]" partly covered
        ("email_fields", "field_rule"): (0, 1, 10),
    }
    no_object = Policy(detection=Detection(), labels=[PathLabel("mail")])
    assert ("UNSPECIFIED", "field_rule") not in sums(metrics.masking_metrics(metrics.outcome_rows(df, no_object, F.lit("c"))))


def test_metric_sums(spark):
    rows = [("c", "", "recognizer", 1, 0, 0), ("c", None, "recognizer", 1, 1, -5), ("c", " E ", "recognizer", 0, 1, 7), ("c", "E", "recognizer", 0, 2, 1)]
    got = metrics.masking_metrics(spark.createDataFrame(rows, OUTCOME))
    assert sums(got) == {("UNSPECIFIED", "recognizer"): (2, 1, 0), ("E", "recognizer"): (0, 3, 8)}
    assert sums(metrics.merge_metrics(got, got)) == {("UNSPECIFIED", "recognizer"): (4, 2, 0), ("E", "recognizer"): (0, 6, 16)}


def test_overflow(spark):
    rows = [("c", f"E{i:03d}", "recognizer", 0, i, 1) for i in range(1, 511)]
    out = sums(metrics.metrics_overflow(spark.createDataFrame(rows, OUTCOME)))
    assert len(out) == 501 and out[("OTHER", "recognizer")] == (0, sum(range(1, 11)), 10)
    assert ("E010", "recognizer") not in out and ("E011", "recognizer") in out


def test_daily(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 59), "c", "E", "r", 0, 1, 1), (dt.datetime(2024, 1, 2), "c", "E", "r", 0, 1, 1)]
    out = metrics.daily_metrics(spark.createDataFrame(rows, "ts timestamp, " + OUTCOME), "ts")
    assert sorted(str(r["day"]) for r in out.collect()) == ["2024-01-01", "2024-01-02"]
    path = shared_folder(spark, "metrics")
    sinks.write_metrics(out, path)
    assert spark.read.parquet(path).filter("day = '2024-01-02'").count() == 1


def test_series_periods():
    assert [ser.period_seconds(s) for s in (60, 3600, 3601, 2 * 86_400, 2 * 86_400 + 1)] == [60, 60, 300, 300, 900]
    now = dt.datetime(2024, 1, 1)
    end = int(now.replace(tzinfo=dt.timezone.utc).timestamp())
    assert ser.time_range(60, now) == (end - 3600, end - 120, 60)
    assert ser.time_range(1, now) == (end - 60, end, 60)
    assert ser.time_range(99_999, now)[0] == end - 1440 * 60


def test_series(spark):
    now = dt.datetime(2024, 1, 1, 1)
    at = lambda s: now - dt.timedelta(seconds=s)
    rows = [(at(600), "a", 1.0), (at(599), "a", 3.0), (at(300), "a", 5.0), (at(60), "a", 100.0), (at(500), "b", 7.0), (at(9999), "a", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    of = lambda i, stat, k: ser.Series(i, stat, i.upper(), F.col("k") == k)
    specs = [of("s", "Sum", "a"), of("m", "Maximum", "none"), of("m_avg", "Average", "b"), of("p", "p99", "a")]
    out = ser.metric_series(df, "ts", "v", specs, now, 60)
    points = {i: sorted(r["v"] for r in out.filter(F.col("series_id") == i).collect() if r["v"] is not None) for i in ("s", "m", "m_avg", "p")}
    assert points == {"s": [4.0, 5.0], "m": [], "m_avg": [7.0], "p": [pytest.approx(2.98), 5.0]}
    empty = {r["series_id"]: r["datapoints"] for r in ser.series_table(out).collect()}
    assert empty["m"] == [] and len(empty["s"]) == 2
    filled = {(r["series_id"], r["label"], r["v"]) for r in ser.series_fallback(out, "m", "m_avg").collect()}
    assert ("m", "M", 7.0) in filled and not any(s == "m_avg" for s, _, _ in filled)
    kept = {(r["series_id"], r["v"]) for r in ser.series_fallback(out, "s", "m_avg").collect()}
    assert {v for s, v in kept if s == "s"} == {4.0, 5.0} and not any(s == "m_avg" for s, _ in kept)
    both_empty = ser.series_fallback(ser.metric_series(df, "ts", "v", [of("x", "Sum", "no"), of("y", "Sum", "no")], now), "x", "y")
    assert [tuple(r) for r in both_empty.collect()] == [("x", "X", None, None)]


def test_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    starts = spark.createDataFrame([("a", t0), ("b", t0)], "session_id string, started_at timestamp")
    ends = spark.createDataFrame([("a", t0 + dt.timedelta(seconds=5), "ok"), ("", t0, "lost"), (None, t0, "lost")], "session_id string, ended_at timestamp, status string")
    got = {r["session_id"]: (r["duration_seconds"], r["status"]) for r in sessions.session_join(starts, ends).collect()}
    assert got == {"a": (5.0, "ok"), "b": (None, None)}


def test_rule_files(spark):
    overlay = rules.overlay_from_text('{"email": "[x]", "card": {"partial_mask": true}, "n": 5, "l": [1], "off": {"partial_mask": false}}')
    assert overlay == {"email": OverlayRule("[x]"), "card": OverlayRule(partial=True)}
    text = '{"recognizers": [{"name": "R", "supported_entity": "ACME", "patterns": [{"name": "p", "regex": "ACME-[0-9]{9}", "score": 0.8}], "context": ["acme"]}]}'
    (r,) = rules.recognizers_from_text(text, "ignored: [")
    assert (r.entity, r.regex, r.score) == ("ACME", "ACME-[0-9]{9}", 0.8) and rules.recognizers_from_text() == []
    assert rules.entities_from_text(" us_ssn, ,Email_Address") == ["US_SSN", "EMAIL_ADDRESS"]
    assert rules.allow_list_from_text(" A@x.io , b ") == ["A@x.io", "b"]
    assert rules.anonymizers_from_text('{"US_SSN": {"type": "mask", "masking_char": "#", "chars_to_mask": 5, "from_end": false}}')["US_SSN"].masking_char == "#"
    assert rules.anonymizers_from_text("nope") == {}
    assert [tuple(x) for x in rules.load_rules(spark, '{" Email ": "[x]", "card": {"partial_mask": true}}', "overlay").collect()] == [("", "email", "[x]", False), ("", "card", "[redacted]", True)]
    assert rules.load_rules(spark, text, "recognizers").first()["context"] == ["acme"]
    with pytest.raises(ValueError):
        rules.load_rules(spark, "", "other")
    table = spark.createDataFrame([("r1", "email", "[r]", False), ("", "x", "y", False)], rules.OVERLAY_SCHEMA)
    assert rules.role_rules(table) == {"r1": {"email": "[r]"}}


def test_yaml_rules():
    pytest.importorskip("yaml")
    assert rules.overlay_from_text('email: "[x]"\ncard:\n  partial_mask: true\n') == {"email": OverlayRule("[x]"), "card": OverlayRule(partial=True)}


def test_reads_and_sinks(spark):
    df = spark.range(2000)
    assert tables.capped_read(df, None).count() == 2000 and tables.capped_read(df, 5).count() == 5
    with pytest.raises(ValueError):
        tables.capped_read(df, 0)
    assert tables.document_read(df).count() == 2000
    assert tables.document_read(df, F.col("id") > 10, limit=50, max_rows=20).count() == 20
    assert tables.document_read(df, None, limit=7).count() == 7
    one = spark.createDataFrame([(1, None, 2.5, True, (1, "x"), ["a"])], "i int, s string, d double, b boolean, st struct<p:int,q:string>, l array<string>")
    assert tuple(sinks.stringify_rows(one).first()) == ("1", None, "2.5", "true", '{"p":1,"q":"x"}', '["a"]')
    assert tuple(sinks.stringify_documents(one).first()) == (1, None, 2.5, True, '{"p":1,"q":"x"}', '["a"]')
    spark.range(1).createOrReplaceTempView("seen_view")
    assert tables.catalog_inventory(tables.spark_catalog(spark)).filter("object_name = 'seen_view'").first()["kind"] == "v"


def test_inventory_and_coverage(spark):
    df = spark.createDataFrame([(1, ("a", [("b",)]), {"k": "v"})], "id int, d struct<x:string,l:array<struct<y:string>>>, m map<string,string>")
    fields = tables.field_inventory(df, OBJ)
    assert [r["field_path"] for r in fields.collect()] == ["d.l[].y", "d.x", "id", "m.k"]
    report = jobs.coverage_report(fields, {OBJ: Policy(overlay={"x": "t"}, labels=[PathLabel("d.l[].y")])})
    assert {r["field_path"]: r["covered_by"] for r in report.collect()} == {"d.l[].y": "labels", "d.x": "overlay", "id": "none", "m.k": "none"}
    assert jobs.masking_mode(Policy()) == "none" and jobs.masking_mode(Policy(overlay={"a": "b"}, detection=Detection(strict=True))) == "remote+overlay(strict)"


def test_mask_table_keeps_everything_else(spark):
    rows = [(i, f"n{i}" if i % 3 else None, f"u{i}@x.io", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, name string, note string, v double")
    policy = Policy(object_id=OBJ, overlay={"name": "[n]"}, detection=Detection(), labels=[PathLabel("v")])
    out = jobs.mask_table(df, policy)
    assert out.schema == df.schema
    got = out.orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(50)) and {r["note"] for r in got} == {"[redacted]"} and {r["v"] for r in got} == {0.0}
    assert [r["name"] for r in got] == [None if i % 3 == 0 else "[n]" for i in range(50)]
    # full replacement is stable
    assert jobs.mask_table(out, policy).orderBy("id").collect() == got
    assert jobs.mask_table(df, Policy()).collect() == df.collect()
    wide = jobs.mask_table(df.select("id", F.col("note").alias("a"), F.col("note").alias("b"), F.col("note").alias("c")), Policy(detection=Detection()))
    assert tuple(wide.filter("id = 3").first()) == (3, "[redacted]", "[redacted]", "[redacted]")


@pytest.fixture(scope="module")
def shout():
    def found(texts):
        """Every word in capitals."""
        import re

        return [[{"entity_type": "LOUD", "start": m.start(), "end": m.end(), "score": 1.0} for m in re.finditer("[A-Z]{2,}", t)] for t in texts]

    return found


@pytest.fixture(scope="module")
def broken():
    def found(texts):
        raise ConnectionError

    return found


def test_own_detector_is_counted(spark, shout, broken):
    df = spark.createDataFrame([("say HELLO to ABC", "XY"), ("quiet", None), (None, "LONGER")], "a string, b string")
    policy = Policy(detection=Detection(detector=shout))
    got = sums(metrics.masking_metrics(metrics.outcome_rows(df, policy, F.lit("c"))))
    assert got == {("UNSPECIFIED", "recognizer"): (3, 0, 0), ("LOUD", "recognizer"): (0, 3, 5 + 3 + 6)}  # "XY" is too short
    down = Policy(detection=Detection(detector=broken))
    assert sums(metrics.masking_metrics(metrics.outcome_rows(df, down, F.lit("c")))) == {("UNSPECIFIED", "recognizer"): (3, 0, 0)}
    rows = metrics.mask_counted(df, policy).drop(metrics.HIDDEN)
    assert rows.collect() == jobs.mask_table(df, policy).collect()


def test_role_rules_settle_what_labels_measure(spark):
    df = spark.createDataFrame([("admin", "secret text"), ("user", "secret text"), (None, None)], "role string, note string")
    policy = Policy(object_id=OBJ, overlay={"note": "[note]"}, role_col="role", role_rules={"admin": {"other": "x"}}, labels=[PathLabel("note", "", "notes")])
    got = sums(metrics.masking_metrics(metrics.outcome_rows(df, policy, F.lit("c"))))
    assert got == {("UNSPECIFIED", "field_rule"): (4, 0, 0), ("notes", "field_rule"): (0, 2, 11 + 6)}


DOC = '{"mail":"jane@example.com","n":12345,"tags":["ok 10.0.0.1","x"],"deep":{"ok":true,"note":"free text"}}'


@pytest.fixture(scope="module")
def document_policy():
    labels = [PathLabel("mail", "partial_mask", "mails"), PathLabel("n", "", "numbers"), PathLabel("deep.ok", category="flags"), PathLabel("note", "do_not_mask", "notes")]
    return Policy(object_id=OBJ, detection=Detection(), overlay={"mail": "[m]"}, labels=labels)


WANT = {
    ("UNSPECIFIED", "recognizer"): (3, 0, 0),
    ("EMAIL_ADDRESS", "recognizer"): (0, 1, 16),
    ("IP_ADDRESS", "recognizer"): (0, 1, 8),
    ("UNSPECIFIED", "field_rule"): (6, 0, 0),
    ("mails", "field_rule"): (0, 1, 3),
    ("numbers", "field_rule"): (0, 1, 5),
    ("flags", "field_rule"): (0, 1, 4),
}


def test_leaves_are_counted(spark, document_policy):
    typed = "struct<mail:string,n:int,tags:array<string>,deep:struct<ok:boolean,note:string>>"
    text = spark.createDataFrame([(1, DOC), (2, None)], "id int, doc string")
    forms = {"text": text, "variant": text.withColumn("doc", F.parse_json("doc")), "typed": text.withColumn("doc", F.from_json("doc", typed))}
    forms["part"] = text.select("id", F.when(F.col("doc").isNotNull(), F.struct(F.parse_json("doc").alias("v"))).alias("doc"))
    for name, df in forms.items():
        if name == "part":  # paths begin below the field that holds the VARIANT
            labels = [dataclasses.replace(l, field_path=f"v.{l.field_path}" if l.field_path != "note" else "note") for l in document_policy.labels]
            policy = dataclasses.replace(document_policy, labels=labels)
        else:
            policy = document_policy
        got = metrics.masking_metrics(metrics.outcome_rows(df, policy, F.lit("c"), doc_cols=["doc"]))
        assert sums(got) == WANT, name
        both = metrics.mask_documents_counted(df, ["doc"], policy).drop(metrics.HIDDEN)
        shown = F.col("doc") if name == "text" else F.to_json("doc")
        assert both.select("id", shown).collect() == jobs.mask_documents(df, ["doc"], policy).select("id", shown).collect(), name


def test_unread_documents_are_counted_as_texts(spark, document_policy):
    rows = [(1, "plain jane@example.com"), (2, '{"broken": "jane@example.com'), (3, "4111111111111111"), (4, "[" * 150)]
    df = spark.createDataFrame(rows, "id int, doc string")
    got = sums(metrics.masking_metrics(metrics.outcome_rows(df, document_policy, F.lit("c"), doc_cols=["doc"])))
    assert got == {("UNSPECIFIED", "recognizer"): (4, 0, 0), ("EMAIL_ADDRESS", "recognizer"): (0, 2, 32), ("CREDIT_CARD", "recognizer"): (0, 1, 16)}
    both = metrics.mask_documents_counted(df, ["doc"], document_policy).drop(metrics.HIDDEN)
    assert both.collect() == jobs.mask_documents(df, ["doc"], document_policy).collect()
    no_detection = dataclasses.replace(document_policy, detection=None)
    both = metrics.mask_documents_counted(df, ["doc"], no_detection).drop(metrics.HIDDEN)
    assert both.collect() == jobs.mask_documents(df, ["doc"], no_detection).collect()
    with pytest.raises(Exception, match="cannot be read"):
        metrics.mask_documents_counted(df, ["doc"], document_policy, strict=True).collect()


def test_report_of_the_masking_pass(spark, document_policy, shout, tmp_path):
    rows = [(i, DOC, f"note {i} of 10.0.0.{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, doc string, note string").repartition(4)
    out = str(tmp_path / "masked")
    report = jobs.mask_and_report(df, document_policy, "c", lambda d: d.write.parquet(out), doc_cols=["doc"])
    assert sums(report) == {k: tuple(40 * n for n in v) for k, v in WANT.items()}
    back = spark.read.parquet(out)
    assert back.columns == df.columns and back.orderBy("id").collect() == jobs.mask_documents(df, ["doc"], document_policy).orderBy("id").collect()
    # flat columns, with a detector whose answers are only partly named beforehand
    policy = Policy(detection=Detection(detector=shout))
    flat = spark.createDataFrame([("HELLO you",), ("ABC",)], "t string")
    asked = jobs.mask_and_report(flat, policy, "c", lambda d: d.write.format("noop").mode("overwrite").save(), entities=["LOUD"])
    assert sums(asked) == {("UNSPECIFIED", "recognizer"): (1, 0, 0), ("LOUD", "recognizer"): (0, 1, 5)}
    other = jobs.mask_and_report(flat, policy, "c", lambda d: d.write.format("noop").mode("overwrite").save())
    assert sums(other) == {("UNSPECIFIED", "recognizer"): (1, 0, 0), ("OTHER", "recognizer"): (0, 1, 5)}
    nothing = jobs.mask_and_report(flat, Policy(), "c", lambda d: d.write.format("noop").mode("overwrite").save())
    assert nothing.count() == 0
    # one scan, no shuffle
    counted = metrics.mask_documents_counted(df, ["doc"], document_policy)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange") == 1  # the repartition above


@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_percentiles_by_counted_values(spark, p):
    rng = random.Random(3)
    inf = float("inf")
    groups = {"many": [rng.gauss(0, 100) for _ in range(3000)], "same": [7.0] * 50, "one": [-3.5], "two": [1.0, 2.0], "far": [-inf, 1e-300, 1e300, inf], "nan": [1.0, 2.0, float("nan")], "none": [None, None]}
    groups[None] = [float(rng.randrange(20)) for _ in range(500)] + [None]
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r["k"]: r["v"] for r in ser.grouped_percentile(df, ["k"], "x", p).collect()}
    want = {r["k"]: r["v"] for r in df.groupBy("k").agg(F.percentile("x", F.lit(p)).alias("v")).collect() if r["v"] is not None}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    assert ser.grouped_percentile(df.limit(0), ["k"], "x", p).count() == 0


def test_rules_of_roles_cover_their_fields(spark):
    fields = spark.createDataFrame([(OBJ, "note"), (OBJ, "mail"), (OBJ, "other")], "object_id string, field_path string")
    policy = Policy(overlay={"mail": "[m]"}, role_col="role", role_rules={"admin": {"Note": "[n]"}})
    covered = lambda p: {r["field_path"]: r["covered_by"] for r in jobs.coverage_report(fields, {OBJ: p}).collect()}
    assert covered(policy) == {"note": "overlay", "mail": "overlay", "other": "none"}
    assert covered(dataclasses.replace(policy, role_col=None)) == {"note": "none", "mail": "overlay", "other": "none"}
