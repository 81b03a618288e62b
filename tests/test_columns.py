import datetime as dt

from pyspark.sql import types as T

from hushframe.operators import columns
from hushframe.plans.policy import OverlayRule, PathLabel, classify_columns, make_object_id, resolve_labels


def row_of(df):
    return df.first().asDict()


def test_classify_columns():
    schema = T.StructType(
        [
            T.StructField("s", T.StringType()),
            T.StructField("u", T.StringType(), True, {"type_kind": "uuid"}),
            T.StructField("n", T.DecimalType(10, 2)),
            T.StructField("b", T.BooleanType()),
            T.StructField("d", T.DateType()),
            T.StructField("raw", T.BinaryType()),
            T.StructField("oid", T.BinaryType(), True, {"type_kind": "object_id"}),
            T.StructField("v", T.VariantType()),
            T.StructField("a", T.ArrayType(T.StringType())),
        ]
    )
    got = {c.name: (c.text, c.free_text, c.kind) for c in classify_columns(schema)}
    assert got == {
        "s": (True, True, None),
        "u": (True, False, "uuid"),
        "n": (True, False, "numeric"),
        "b": (True, False, "bool"),
        "d": (True, False, "date"),
        "raw": (False, False, None),
        "oid": (True, False, "object_id"),
        "v": (False, False, None),
        "a": (False, False, None),
    }


def test_overlay_names_in_any_case(spark):
    df = spark.createDataFrame(
        [("Ann", "a@x.io", None, bytearray(b"z"), 5)], "Name string, EMAIL string, ssn string, raw binary, n int"
    )
    rules = {" email ": "[mail]", "NAME": OverlayRule(partial=True), "ssn": "[ssn]", "raw": "x", "n": "x", "  ": "y"}
    out = row_of(columns.overlay_mask(df, rules))
    assert out == {"Name": "***", "EMAIL": "[mail]", "ssn": None, "raw": bytearray(b"z"), "n": 5}


def test_overlay_keeps_schema(spark):
    schema = T.StructType([T.StructField("a", T.StringType(), False), T.StructField("b", T.IntegerType(), True)])
    df = spark.createDataFrame([("x", 1)], schema)
    assert columns.overlay_mask(df, {"a": "t"}).schema == schema
    labels = [PathLabel("a"), PathLabel("b")]
    assert columns.path_label_mask(df, "o:d:b:t", labels).schema == schema


def test_role_overlay(spark):
    rows = [("r1", "Ann", "a@x"), ("r2", "Ann", "a@x"), ("other", "Ann", "a@x"), (None, "Ann", None)]
    df = spark.createDataFrame(rows, "role string, name string, email string")
    out = columns.role_overlay(
        df, "role", {"email": "[d]", "name": OverlayRule(partial=True)}, {"r1": {"Email": "[r1]"}, "r2": {"name": "[r2]"}, "": {"name": "z"}}
    )
    got = [tuple(r) for r in out.collect()]
    # a role's rules replace the default set, they do not add to it
    assert got == [("r1", "Ann", "[r1]"), ("r2", "[r2]", "a@x"), ("other", "***", "[d]"), (None, "***", None)]


OBJ = "org:spark:db:t"


def masked(df, *labels, object_id=OBJ, **kw):
    return row_of(columns.path_label_mask(df, object_id, list(labels), **kw))


def test_path_labels(spark):
    df = spark.createDataFrame([("a@x.io", "Ann Lee")], "Email string, name string")
    keep = {"Email": "a@x.io", "name": "Ann Lee"}
    assert masked(df, PathLabel("Email"))["Email"] == "[redacted]"
    # the bare key is looked up in lower case
    assert masked(df, PathLabel("email"))["Email"] == "[redacted]"
    assert masked(df, PathLabel("NAME")) == keep
    assert masked(df, PathLabel("name", "partial_mask"))["name"] == "*** Lee"
    assert masked(df, PathLabel("name", "do_not_mask")) == keep
    assert masked(df, PathLabel("name", "whatever"))["name"] == "[redacted]"
    assert masked(df, PathLabel("name", source="proposed")) == keep
    assert masked(df, PathLabel("name", source="dismissed")) == keep
    assert masked(df, PathLabel("name"), object_id="") == keep
    # a confirmed path label decides alone, also against the bare key
    assert masked(df, PathLabel("Email", "do_not_mask"), PathLabel("email")) == keep
    assert masked(df, PathLabel("email"), strict_match_mode=True) == keep
    assert masked(df, PathLabel("real_mail"), paths={"Email": "real_mail"})["Email"] == "[redacted]"


def test_typed_placeholders(spark):
    schema = T.StructType.fromDDL(
        "i int, l bigint, f float, d double, m decimal(10,2), b boolean, dt date, ts timestamp, "
        "tn timestamp_ntz, dd interval day to second, raw binary, arr array<int>"
    )
    schema = schema.add("u", T.StringType(), True, {"type_kind": "uuid"}).add(
        "o", T.BinaryType(), True, {"type_kind": "object_id"}
    )
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    row = (1, 2, 3.0, 4.0, dt.timedelta(1) and __import__("decimal").Decimal("5.00"), True, now.date(), now, now,
           dt.timedelta(days=1), bytearray(b"x"), [1], "abc", bytearray(b"y" * 12))
    df = spark.createDataFrame([row, tuple([None] * len(row))], schema)
    labels = [PathLabel(f.name, "partial_mask") for f in schema.fields]
    out = columns.path_label_mask(df, OBJ, labels)
    assert out.schema == schema
    first, nulls = out.collect()
    assert first["i"] == 0 and first["l"] == 0 and first["f"] == 0 and first["d"] == 0 and first["m"] == 0
    assert first["b"] is False and first["dt"] == dt.date(1, 1, 1)
    assert first["ts"] == dt.datetime.fromtimestamp(0) and first["tn"] == dt.datetime(1970, 1, 1)
    assert first["dd"] == dt.timedelta(0) and first["u"] == columns.ZERO_UUID and first["o"] == bytearray(12)
    assert first["raw"] == bytearray(b"x") and first["arr"] == [1]
    assert all(v is None for v in nulls)


def test_mask_chain(spark):
    df = spark.createDataFrame([("abcdef",)], "a string")
    assert columns.mask_chain(df) is df
    one = lambda d: columns.overlay_mask(d, {"a": "[redacted]"})
    two = lambda d: columns.path_label_mask(d, OBJ, [PathLabel("a", "partial_mask")])
    assert columns.mask_chain(df, None, one, two).first()[0] == "******ted]"
    assert columns.mask_chain(df, two, one).first()[0] == "[redacted]"


def test_labels_from_a_table(spark):
    rows = [(OBJ, "a", "path", "c", "full_redact", "manual"), (OBJ, "b", None, None, None, "platform"),
            (OBJ, "c", "path", "c", "", "proposed"), ("x:y:z:w", "a", "path", "c", "", "manual")]
    table = spark.createDataFrame(rows, "object_id string, field_path string, match_mode string, category string, profile string, source string")
    got = resolve_labels(table, OBJ)
    assert set(got) == {"a", "b"} and got["b"].match_mode == "path"
    assert make_object_id("o", " MongoDB", "d", "t") == "o:mongo:d:t" and make_object_id("", "x", "d", "t") == ""
