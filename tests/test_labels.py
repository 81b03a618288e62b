import datetime as dt

from pyspark.sql import functions as F

from hushframe.operators import labels, sampling
from hushframe.plans import jobs
from hushframe.plans.policy import PathLabel, resolve_labels

T0 = dt.datetime(2024, 1, 1)
OBJ = "o:spark:db:t"
NAMES = [p.split()[0] for p in labels.LABEL_SCHEMA.split(", ")]


def table(spark, *rows, seq=True):
    """Rows given as dicts over label defaults."""
    base = dict(object_id=OBJ, field_path="a", match_mode="path", category="c", profile="", source="proposed",
                confidence=0.5, sample_count=1, last_observed_at=T0, updated_at=T0, updated_by="x")
    full = [{**base, **r} for r in rows]
    names = NAMES + (["seq"] if seq else [])
    schema = labels.LABEL_SCHEMA + (", seq bigint" if seq else "")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema)


def by_path(df):
    return {r["field_path"]: r for r in df.collect()}


def test_merge_proposed(spark):
    props = table(
        spark,
        dict(seq=1, sample_count=3, confidence=0.9, category="old", updated_at=T0 + dt.timedelta(1)),
        dict(seq=2, sample_count=4, confidence=0.4, category="new", match_mode="", last_observed_at=T0 + dt.timedelta(2)),
        dict(seq=3, field_path=""),
        dict(seq=3, object_id=None),
    )
    (row,) = labels.merge_proposed(props).collect()
    assert (row["sample_count"], row["confidence"], row["category"], row["match_mode"]) == (7, 0.9, "new", "path")
    assert row["last_observed_at"] == T0 + dt.timedelta(2) and row["updated_at"] == T0 + dt.timedelta(1)


def test_upsert(spark):
    current = table(
        spark,
        dict(field_path="kept", source="manual", category="m"),
        dict(field_path="merged", sample_count=5, confidence=0.8),
        dict(field_path="taken", sample_count=5),
        dict(field_path="gone", source="dismissed"),
        dict(field_path="idle", source="platform"),
        seq=False,
    )
    incoming = table(
        spark,
        dict(field_path="kept", seq=1, category="p", confidence=0.99),
        dict(field_path="merged", seq=1, category="p2", confidence=0.3, sample_count=2),
        dict(field_path="taken", seq=2, source="manual", category="by hand", sample_count=0),
        dict(field_path="taken", seq=3, source="manual", category="by hand 2", sample_count=0),
        dict(field_path="taken", seq=4, category="late proposal"),
        dict(field_path="gone", seq=1),
        dict(field_path="fresh", seq=1),
    )
    out = labels.upsert_labels(current, incoming)
    assert out.columns == NAMES
    rows = by_path(out)
    assert len(rows) == 6
    assert (rows["kept"]["source"], rows["kept"]["category"]) == ("manual", "m")
    merged = rows["merged"]
    assert (merged["sample_count"], merged["confidence"], merged["category"]) == (7, 0.8, "p2")
    assert (rows["taken"]["source"], rows["taken"]["category"], rows["taken"]["sample_count"]) == ("manual", "by hand 2", 0)
    assert rows["gone"]["source"] == "dismissed" and rows["idle"]["source"] == "platform" and rows["fresh"]["source"] == "proposed"


def test_lookup(spark):
    lab = table(
        spark,
        dict(field_path="p.email", source="manual", category="path hit"),
        dict(field_path="email", source="platform", category="key hit", match_mode=""),
        dict(field_path="name", source="proposed"),
        dict(field_path="Phone", source="manual"),
        seq=False,
    )
    leaves = spark.createDataFrame(
        [(1, OBJ, "p.email", "email"), (2, OBJ, "q.email", " EMAIL "), (3, OBJ, "name", "name"), (4, OBJ, "x.phone", "Phone"), (5, "", "p.email", "email"), (6, None, None, None)],
        "id int, object_id string, path string, key string",
    )
    got = {r["id"]: (r["category"], r["matched_by"]) for r in labels.label_lookup(leaves, lab).collect()}
    assert got == {1: ("path hit", "path"), 2: ("key hit", "key"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}
    strict = labels.label_lookup(leaves, lab, strict_match_mode=True)
    assert {r["id"] for r in strict.collect() if r["matched_by"]} == {1}
    assert {r["match_mode"] for r in labels.confirmed_labels(lab, OBJ).collect()} == {"path"}


def test_mask_rows_by_lookup(spark):
    lab = table(
        spark,
        dict(field_path="a", source="manual", profile="partial_mask"),
        dict(field_path="b", source="manual", profile="do_not_mask"),
        dict(field_path="c", source="platform", profile=None),
        dict(field_path="d", source="proposed"),
        seq=False,
    )
    rows = [(OBJ, p, p, "secret") for p in "abcd"] + [("x:y:z:w", "a", "a", "secret"), (OBJ, "q.a", "A", None)]
    df = spark.createDataFrame(rows, "object_id string, path string, key string, value string")
    got = [r["value"] for r in labels.mask_by_lookup(df, lab).collect()]
    assert sorted(got, key=str) == sorted(["**cret", "secret", "[redacted]", "secret", "secret", None], key=str)


def test_lineage(spark):
    cols = spark.createDataFrame([(7, 1, "mail"), (0, 0, "n")], "table_id int, column_no int, name string")
    known = spark.createDataFrame([(7, 1, "users", "email")], "table_id int, column_no int, table_name string, real_name string")
    got = {r["name"]: (r["object_id"], r["path"]) for r in labels.column_lineage_lookup(cols, known, "o", "pg", "db").collect()}
    assert got == {"mail": ("o:pg:db:users", "email"), "n": ("", "n")}


def test_caps_and_queue(spark):
    many = table(spark, *[dict(field_path=f"f{i:04d}", confidence=i / 1000, seq=1) for i in range(501)])
    kept = by_path(labels.pending_cap(many, 500))
    assert len(kept) == 500 and "f0000" not in kept
    queue = [r["field_path"] for r in labels.review_queue(many).limit(2).collect()]
    assert queue == ["f0000", "f0001"]
    seen = spark.createDataFrame([(OBJ, "old", T0), (OBJ, "b", T0 + dt.timedelta(2)), (OBJ, "c", T0 + dt.timedelta(1)), (OBJ, "old", T0 - dt.timedelta(9))], "object_id string, field_path string, last_seen timestamp")
    assert [r["field_path"] for r in labels.field_cap(seen, 2).collect()] == ["b", "c"]
    batches = labels.proposal_batches(many, 3).collect()
    assert [len(b["items"]) for b in batches] == [3] and batches[0]["items"][0]["field_path"] == "f0498"
    # without a cap nothing is lost, however the batches are cut
    dealt = labels.proposal_batches(many, max_items=100).collect()
    assert len(dealt) > 3 and sorted(i["field_path"] for b in dealt for i in b["items"]) == [f"f{i:04d}" for i in range(501)]


def test_labels_of_one_path_do_not_multiply_rows(spark):
    lab = table(
        spark,
        dict(field_path="a", source="platform", profile="full_redact", category="late", updated_at=T0 + dt.timedelta(9), seq=1),
        dict(field_path="a", source="manual", profile="partial_mask", category="old", updated_at=T0, seq=2),
        dict(field_path="a", source="manual", profile="do_not_mask", category="new", updated_at=T0 + dt.timedelta(1), seq=3),
        dict(field_path="a", source="manual", profile="do_not_mask", category="new", updated_at=T0 + dt.timedelta(1), seq=3),
    )
    df = spark.createDataFrame([(OBJ, "a", "a", "secret"), (OBJ, "z.a", "A", "secret")], "object_id string, path string, key string, value string")
    found = labels.label_lookup(df, lab).collect()
    assert [(r["category"], r["matched_by"]) for r in sorted(found, key=lambda r: r["path"])] == [("new", "path"), ("new", "key")]
    assert [r["value"] for r in labels.mask_by_lookup(df, lab).collect()] == ["secret"] * 2
    cols = spark.createDataFrame([(7, 1, "mail")], "table_id int, column_no int, name string")
    known = spark.createDataFrame([(7, 1, "users", "email"), (7, 1, "users", "email"), (7, 1, "users", "mail")], "table_id int, column_no int, table_name string, real_name string")
    assert [r["path"] for r in labels.column_lineage_lookup(cols, known, "o", "pg", "db").collect()] == ["email"]


def test_no_proposal_is_lost(spark):
    wide = spark.range(3).select("id", *[F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.com")).alias(f"f{i}") for i in range(520)])
    current = table(spark, dict(field_path="x", seq=1), seq=False).filter("false")
    history = spark.createDataFrame([], "object string, last_scanned timestamp")
    out = jobs.propose_labels({"wide": wide}, "o", "spark", "db", current, history, F.lit(T0), order_by={"wide": ["id"]})
    assert out.count() == 520


def test_latest_and_dismissed(spark):
    rows = table(spark, dict(seq=1, category="a"), dict(seq=2, category="b"), dict(seq=9, category="old", updated_at=T0 - dt.timedelta(1)))
    (row,) = labels.latest_label(rows).collect()
    assert row["category"] == "b"
    known = table(spark, dict(source="dismissed", category="a"), seq=False)
    assert [r["category"] for r in labels.suppress_dismissed(rows, known).collect()] == ["b", "old"]


def test_rescan_selection(spark):
    objects = spark.createDataFrame([(n,) for n in "abcde"], "object string")
    history = spark.createDataFrame(
        [("a", T0), ("b", T0 - dt.timedelta(3)), ("c", T0 - dt.timedelta(2)), ("c", T0 - dt.timedelta(5))], "object string, last_scanned timestamp"
    )
    now = F.lit(T0 + dt.timedelta(hours=1))
    pick = lambda **kw: [r["object"] for r in labels.rescan_selection(objects, history, now, **kw).collect()]
    assert pick() == ["d", "e", "b", "c"]
    assert pick(max_objects=3) == ["d", "e", "b"]
    assert pick(max_objects=0, rescan_seconds=0) == ["d", "e", "b", "c", "a"]
    assert pick(rescan_seconds=3600) == ["d", "e", "b", "c", "a"]


def test_sampling(spark):
    rows = [(i, f"v{i:02d}" if i % 2 else None, "" if i < 3 else "x", i) for i in range(50)]
    df = spark.createDataFrame(rows, "seq int, a string, b string, n int")
    got = {r["field_path"]: r["samples"] for r in sampling.sample_fields(df, OBJ, 3, ["seq"]).collect()}
    assert got == {"a": ["v01", "v03", "v05"], "b": ["", "", ""]}
    got = {r["field_path"]: r["samples"] for r in sampling.sample_fields(df, OBJ, 3, ["seq"], drop_blank=True).collect()}
    assert got["b"] == ["x", "x", "x"]
    plan = sampling.sample_fields(df, OBJ, 3, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_classify(spark):
    rows = [(OBJ, "user_email", ["x"]), (OBJ, "n", ["my 123-45-6789"]), (OBJ, "m", ["a@x.io"]), (OBJ, "plain", ["x"]), (OBJ, "birth_date", ["1990"]), ("", "email", ["x"])]
    df = spark.createDataFrame(rows, "object_id string, field_path string, samples array<string>")
    got = {r["field_path"]: (r["category"], r["confidence"]) for r in sampling.classify_fields(df).collect()}
    assert got == {"user_email": ("email_fields", 0.6), "n": ("ssn_fields", 0.9), "m": ("email_fields", 0.9), "birth_date": ("dob_fields", 0.6)}
    assert sampling.classify_fields(df, min_samples=2).count() == 0

    def own(object_id, field_path, samples):
        if field_path == "n":
            raise RuntimeError
        return ("email_fields", "", 0.6) if field_path == "m" else ("unknown", "", 0.9) if field_path == "plain" else None

    assert [r["field_path"] for r in sampling.classify_fields(df, own).collect()] == ["m"]
    summary = sampling.classification_summary(df.filter("object_id <> ''"), sampling.classify_fields(df)).collect()
    assert [tuple(r) for r in summary] == [(OBJ, 5, 4)]
    prompt = sampling.classification_prompt(df, ["a", "b"]).first()["prompt"]
    assert "Field path: user_email\nSample values:\n- x\nPick exactly one" in prompt and ": a, b\n" in prompt


def test_propose_jobs(spark):
    now = F.lit(T0)
    values = spark.createDataFrame([(1, "a@x.io", "n"), (2, "10.0.0.1", "n"), (3, None, "n")], "id int, v string, w string")
    (row,) = jobs.propose_from_values(values, OBJ, now, order_by=["id"]).collect()
    assert (row["field_path"], row["category"], row["confidence"], row["sample_count"]) == ("v", "IP_ADDRESS", 1.0, 2)
    people = spark.createDataFrame([(1, "a@x.io", "555-1234")], "id int, email string, phone string")
    current = table(spark, dict(object_id="o:spark:db:people", field_path="phone", source="dismissed", category="phone_fields"), seq=False)
    history = spark.createDataFrame([("fresh", T0)], "object string, last_scanned timestamp")
    out = jobs.propose_labels({"people": people, "fresh": people}, "o", "spark", "db", current, history, now, order_by={"people": ["id"]})
    rows = by_path(out)
    assert set(rows) == {"email", "phone"}
    assert (rows["email"]["source"], rows["email"]["object_id"]) == ("proposed", "o:spark:db:people") and rows["phone"]["source"] == "dismissed"
    own = jobs.propose_labels({"people": people}, "o", "spark", "db", current, history, now,
                              sampler=lambda df, n: df.select(F.lit("dob").alias("field_path"), F.array("email").alias("samples")))
    assert "dob" in by_path(own)


def test_labels_of_one_path_that_disagree(spark):
    found = [("email", "full_redact", "manual", 1), ("email", "do_not_mask", "platform", 9), ("name", "partial_mask", "manual", 1), ("name", "do_not_mask", "manual", 2)]
    given = [PathLabel(f, p, source=s, updated_at=t) for f, p, s, t in found]
    table = spark.createDataFrame([("o", f, p, "c", s, "path", t) for f, p, s, t in found], "object_id string, field_path string, profile string, category string, source string, match_mode string, updated_at int")
    for rows in (given, given[::-1], table, table.orderBy(F.desc("updated_at"))):
        assert {k: v.profile for k, v in resolve_labels(rows, "o").items()} == {"email": "full_redact", "name": "do_not_mask"}
