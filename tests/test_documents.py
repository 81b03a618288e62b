import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.operators import documents as docs
from hushframe.operators.json_docs import _yaml_loader, hide_secrets
from hushframe.plans.policy import Detection, OverlayRule, PathLabel, Policy

OBJ = "org:mongo:db:c"


def walk_by_hand(node, path=""):
    """The rules of a walk, spelled out over parsed JSON."""
    if isinstance(node, dict):
        out = []
        for k in sorted(node):
            out.append((path, k, k, True))
            out += walk_by_hand(node[k], f"{path}.{k}" if path else k)
        return out
    if isinstance(node, list):
        return [leaf for item in node for leaf in walk_by_hand(item, path + "[]")]
    if isinstance(node, str):
        return [(path, path.rsplit(".", 1)[-1].removesuffix("[]"), node, False)]
    return []


JSON_DOCS = [
    {"profile": {"contact": {"email": "a@x.io"}}, "n": 1, "ok": True, "gone": None},
    {"tags": [{"name": "x"}, {"name": "y", "more": ["z", 3, ["deep"]]}], "list": ["p", "q"]},
    {"order": {"email": "o@x.io"}, "user": {"email": "u@x.io"}},
    {"user@x.io": {"role": "admin"}},
    ["top", {"k": "v"}],
    "lone",
    7,
    {},
    {"mixed": "text"},
    {"mixed": {"now": "object"}},
]


def test_walk_json_text(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(JSON_DOCS)] + [(98, "not json"), (99, None)]
    df = spark.createDataFrame(rows, "id int, j string")
    got = sorted(tuple(r) for r in docs.doc_walk(df, "id", "j").collect())
    want = sorted((i, *leaf) for i, d in enumerate(JSON_DOCS) for leaf in walk_by_hand(d))
    assert got == want
    as_variant = df.withColumn("j", F.try_parse_json("j"))
    assert sorted(tuple(r) for r in docs.doc_walk(as_variant, "id", "j").collect()) == want


def test_walk_typed(spark):
    schema = T.StructType.fromDDL(
        "id int, d struct<b:string,a:array<struct<n:string,x:int>>,m:map<string,array<string>>,k:int>"
    )
    row = (1, ("v", [("p", 1), ("q", None)], {"u@x": ["r"]}, 3))
    df = spark.createDataFrame([row, (2, None)], schema)
    got = sorted(tuple(r) for r in docs.doc_walk(df, "id", "d").collect())
    doc = {"b": "v", "a": [{"n": "p", "x": 1}, {"n": "q", "x": None}], "m": {"u@x": ["r"]}, "k": 3}
    assert got == sorted((1, *leaf) for leaf in walk_by_hand(doc))


def test_depth(spark):
    nested = lambda n: "[" * n + '"]]{"' + "]" * n
    df = spark.createDataFrame([(1, nested(3)), (2, nested(101)), (3, nested(102))], "id int, j string")
    flags = {r["id"]: r["too_deep"] for r in docs.depth_guard(df, "j").collect()}
    assert flags == {1: False, 2: False, 3: True}
    with pytest.raises(Exception, match="nesting exceeds"):
        docs.depth_guard(df.coalesce(1), "j", strict=True).collect()
    # one deep document does not stop the others; it is flagged, and stops the job only when strict
    states = {r["id"]: r["doc_state"] for r in docs.doc_state(df, "j").collect()}
    assert states == {1: "json", 2: "json", 3: "deep"}
    assert {r["id"] for r in docs.doc_walk(df, "id", "j").collect()} == {1, 2}
    with pytest.raises(Exception, match="nesting exceeds"):
        docs.doc_walk(df.coalesce(1), "id", "j", strict=True).collect()


def test_every_depth_to_the_limit(spark):
    rows = [(n, '{"k":' * n + '["x@y.org", 1.50]' + "}" * n) for n in (*range(1, 100, 7), 99)]
    df = spark.createDataFrame(rows, "id int, j string")
    leaves = {r["id"]: r["path"] for r in docs.doc_walk(df, "id", "j").filter("not is_key").collect()}
    assert leaves == {n: ".".join("k" * n) + "[]" for n, _ in rows}
    out = {r["id"]: r["j"] for r in docs.doc_mask(df, "j", policy(detection=Detection())).collect()}
    assert out == {n: '{"k":' * n + '["[redacted]",1.50]' + "}" * n for n, _ in rows}


def test_nothing_unread_passes(spark):
    texts = [
        '{"email":"first person","email":"second person"}',
        '{"email":"ann@example.org", "note": ',
        "[" * 150 + '"ann@example.org"' + "]" * 150,
        '{"a": NaN, "email": "ann@example.org"}',
        '{"a": "\\ud800", "email": "ann@example.org"}',
        "[[[[[1]]]]]",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, j string")
    shown = lambda p: [r["j"] for r in docs.doc_mask(df, "j", p).orderBy("id").collect()]
    out = shown(policy(overlay={"email": "[mail]"}, detection=Detection()))
    assert json.loads(out[0]) == {"email": "[mail]"}
    assert not any("ann@example.org" in o for o in out[:5]) and "note" in out[1]
    assert out[5:] == texts[5:]
    out = shown(policy(overlay={"email": "[mail]"}))
    assert out[1:5] == ["[redacted]"] * 4 and out[5:] == texts[5:]
    flags = [r["doc_state"] for r in docs.doc_state(df, "j").orderBy("id").collect()]
    assert flags == ["json", "broken", "deep", "broken", "broken", "json", "text", "null"]
    with pytest.raises(Exception, match="cannot be read|nesting exceeds"):
        docs.doc_mask(df.coalesce(1), "j", policy(detection=Detection(strict=True))).collect()


def test_detector_and_roles_on_documents(spark):
    def names(texts):
        return [[{"entity_type": "PERSON", "start": t.index("Ann"), "end": t.index("Ann") + 3, "score": 0.9}] if "Ann" in t else [] for t in texts]

    df = spark.createDataFrame([(1, '{"n":["with Ann here","none"],"email":"e1"}', "auditor"), (2, '{"n":"Ann","email":"e2"}', "guest")], "id int, j string, role string")
    rules = policy(detection=Detection(detector=names, min_len=1), overlay={"email": "[mail]"}, role_col="role", role_rules={"auditor": {"n": "[n]"}})
    out = [json.loads(r["j"]) for r in docs.doc_mask(df, "j", rules).orderBy("id").collect()]
    assert out == [{"n": ["[n]", "[n]"], "email": "e1"}, {"n": "[redacted]", "email": "[mail]"}]
    typed = df.select("id", F.struct(F.lit("with Ann here").alias("a"), F.array(F.lit("Ann")).alias("b")).alias("d"))
    found = docs.doc_mask(typed, "d", policy(detection=Detection(detector=names, min_len=1))).first()["d"]
    assert found == ("with [redacted] here", ["[redacted]"])

    def broken(texts):
        raise RuntimeError("down")

    assert json.loads(docs.doc_mask(df, "j", policy(detection=Detection(detector=broken))).orderBy("id").first()["j"])["email"] == "e1"
    with pytest.raises(Exception, match="detector unavailable"):
        docs.doc_mask(df.coalesce(1), "j", policy(detection=Detection(detector=broken, strict=True))).collect()


def test_wide_documents_plan_fast(spark):
    import time

    wide = F.struct(*[F.concat(F.lit("mail a"), F.col("id").cast("string"), F.lit("@example.org")).alias(f"f{i}") for i in range(60)])
    df = spark.range(3).select("id", wide.alias("d"))
    start = time.time()
    out = docs.doc_mask(df, "d", policy(detection=Detection())).collect()
    assert all(v == "mail [redacted]" for r in out for v in r["d"])
    assert time.time() - start < 30


def test_replace_without_schema(spark):
    df = spark.createDataFrame([(1, '{"a":[{"k":"x"},{"k":"y"}],"m":{"u@x":1,"w":"x"}}'), (2, "no json"), (3, None)], "id int, j string")
    out = docs.doc_replace(df, "j", "a[].k", lambda c: F.upper(c), where=lambda c: c == "x").orderBy("id").collect()
    assert json.loads(out[0]["j"])["a"] == [{"k": "X"}, {"k": "y"}] and [r["replaced"] for r in out] == [1, 0, 0]
    assert out[1]["j"] == "no json" and out[2]["j"] is None
    out = docs.doc_replace(df, "j", "m", lambda c: F.lit("w"), where=lambda c: F.contains(c, F.lit("@")), keys=True).orderBy("id").first()
    assert json.loads(out["j"])["m"] == {"w": 1} and out["replaced"] == 1
    variant = df.filter("id = 1").select("id", F.parse_json("j").alias("v"))
    out = docs.doc_replace(variant, "v", "m.w", lambda c: F.lit("z")).select(F.to_json("v").alias("v"), "replaced").first()
    assert json.loads(out["v"])["m"] == {"u@x": 1, "w": "z"} and out["replaced"] == 1
    schema = T.StructType.fromDDL("id int, d map<string,struct<n:string,l:array<string>>>")
    typed = spark.createDataFrame([(1, {"a": ("x", ["x", "y"]), "b": ("x", None)})], schema)
    out = docs.doc_replace(typed, "d", "a.l[]", lambda c: F.lit("*"), where=lambda c: c == "x").first()
    assert out["d"]["a"] == ("x", ["*", "y"]) and out["d"]["b"] == ("x", None) and out["replaced"] == 1


def policy(**kw):
    return Policy(object_id=OBJ, **kw)


def test_mask_typed(spark):
    schema = T.StructType.fromDDL(
        "id int, d struct<email:string,dob:timestamp_ntz,profile:struct<email:string,name:string>,"
        "tags:array<struct<name:string>>,total:int,extra:map<string,string>>"
    )
    row = (1, ("a@x.io", dt.datetime(1990, 1, 1), ("p@x.io", "Ann Lee"), [("t1",), (None,)], 42, {"email": "m@x.io", "z": "10.0.0.1"}))
    df = spark.createDataFrame([row, (2, None)], schema)
    out = docs.doc_mask(df, "d", policy(labels=[PathLabel("profile.email"), PathLabel("dob"), PathLabel("tags[].name", "partial_mask")]))
    first = out.orderBy("id").first()["d"].asDict(True)
    assert first["profile"] == {"email": "[redacted]", "name": "Ann Lee"} and first["email"] == "a@x.io"
    assert first["dob"] == dt.datetime(1970, 1, 1) and first["total"] == 42
    assert first["tags"] == [{"name": "**"}, {"name": None}] and first["extra"]["email"] == "m@x.io"
    assert out.orderBy("id").collect()[1]["d"] is None
    # a bare key reaches every depth, also inside a map
    out = docs.doc_mask(df, "d", policy(overlay={"EMAIL": "[mail]"}, detection=Detection())).orderBy("id").first()["d"]
    assert (out["email"], out["profile"]["email"], out["extra"]) == ("[mail]", "[mail]", {"email": "[mail]", "z": "[redacted]"})
    loose = docs.doc_mask(df, "d", policy(labels=[PathLabel("email")])).orderBy("id").first()["d"]
    assert (loose["email"], loose["profile"]["email"], loose["extra"]["email"]) == ("[redacted]",) * 3
    strict = docs.doc_mask(df, "d", policy(labels=[PathLabel("email")], strict_match_mode=True)).orderBy("id").first()["d"]
    assert (strict["email"], strict["profile"]["email"]) == ("[redacted]", "p@x.io")


def test_mask_json_text(spark):
    rows = [
        '{"profile":{"email":"a@x.io","name":"Jane"},"order":{"total":42},"n":null}',
        '{"profile":["a@x.io",{"email":"b@x.io","age":5}],"mixed":true}',
        "plain a@x.io",
        None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, j string")
    labels = [PathLabel("profile.email"), PathLabel("profile[].age"), PathLabel("mixed")]
    out = [r["j"] for r in docs.doc_mask(df, "j", policy(labels=labels)).orderBy("id").collect()]
    assert json.loads(out[0]) == {"profile": {"email": "[redacted]", "name": "Jane"}, "order": {"total": 42}, "n": None}
    assert json.loads(out[1]) == {"profile": ["a@x.io", {"email": "b@x.io", "age": 0}], "mixed": False}
    assert out[2:] == rows[2:]
    found = docs.doc_mask(df, "j", policy(detection=Detection(), overlay={"name": OverlayRule(partial=True)})).orderBy("id")
    first = json.loads(found.first()["j"])
    assert first == {"profile": {"email": "[redacted]", "name": "****"}, "order": {"total": 42}, "n": None}


def test_replace(spark):
    schema = T.StructType.fromDDL("id int, d struct<a:string,l:array<string>,m:map<string,string>,s:struct<a:string>>")
    df = spark.createDataFrame([(1, ("x", ["x", "y", None], {"u@x": "1", "w": "x"}, ("x",))), (2, None)], schema)
    star = lambda c: F.lit("*")
    got = lambda **kw: docs.doc_replace(df, "d", replace=star, **kw).orderBy("id").collect()
    rows = got(path="l[]", where=lambda c: c == "x")
    assert rows[0]["d"]["l"] == ["*", "y", None] and rows[0]["replaced"] == 1 and rows[0]["d"]["a"] == "x"
    assert rows[1]["replaced"] == 0 and rows[1]["d"] is None
    assert got(path="s.a")[0]["d"]["s"]["a"] == "*"
    assert got(path="m.w")[0]["d"]["m"] == {"u@x": "1", "w": "*"}
    keys = got(path="m", where=lambda c: F.contains(c, F.lit("@")), keys=True)[0]
    assert keys["d"]["m"] == {"*": "1", "w": "x"} and keys["replaced"] == 1
    # a renamed key takes the place of an equal one
    clash = docs.doc_replace(df, "d", "m", lambda c: F.lit("w"), where=lambda c: c == "u@x", keys=True).orderBy("id").first()
    assert clash["d"]["m"] == {"w": "1"}


def test_secret_manifests(spark):
    secret = {"kind": "Secret", "data": {"p": "abc", "n": 1}, "stringData": {"q": "z"}, "meta": {"data": {"k": "keep"}}}
    config = {"kind": "ConfigMap", "data": {"p": "abc"}}
    cases = [secret, config, {"kind": "List", "items": [secret, config]}, [secret, [{"kind": "sECRET", "data": {"x": None}}]], {"kind": "Secret", "data": "text"}]
    hidden = {**secret, "data": {"p": docs.SECRET, "n": docs.SECRET}, "stringData": {"q": docs.SECRET}}
    want = [hidden, config, {"kind": "List", "items": [hidden, config]}, [hidden, [{"kind": "sECRET", "data": {"x": docs.SECRET}}]], cases[4]]
    texts = [json.dumps(c) for c in cases] + ["NAME READY\nkind: Secret", '{"kind": "Secret", "data": {', "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, j string")
    out = [r["j"] for r in docs.secret_manifest_mask(df, "j").orderBy("id").collect()]
    assert [json.loads(o) for o in out[:5]] == want
    assert out[5] == texts[5] and out[6] == docs.SECRET and out[7:] == texts[7:]


def test_secrets_in_any_form(spark):
    texts = [
        '{"kind":"Secret","kind":"Secret","data":{"a":"hunter2"}}',
        "[" * 9 + '{"kind":"secret","stringData":{"a":"hunter2"}}' + "]" * 9,
        "apiVersion: v1\nkind: Secret\ndata:\n  a: hunter2\n---\nkind: ConfigMap\ndata:\n  b: open\n",
        "kind: List\nitems:\n- kind: Secret\n  stringData:\n    a: hunter2\n",
        "kind: Secret\ndata:\n  a: [hunter2\n",
        '{"k\\u0069nd":"Secret","data":{"a":"hunter2"}}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, j string")
    out = [r["j"] for r in docs.secret_manifest_mask(df, "j").orderBy("id").collect()]
    assert not any("hunter2" in o for o in out) and "open" in out[2]


def test_walk_of_stored_documents(spark, tmp_path):
    # read from files the optimizer prunes nested fields; every leaf must still be there
    schema = T.StructType.fromDDL("id int, s struct<a:string,b:struct<c:string>>, l array<struct<x:string,y:int>>")
    rows = [(i, (f"a{i}", (f"c{i}",)), [(f"x{i}", i)]) for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d")).select("id", F.struct("s", "l").alias("doc"))
    leaves = docs.doc_walk(df, "id", "doc")
    assert len(leaves.collect()) == leaves.count() == 20 * (2 + 2 + 1 + 2 + 3)
    assert len(leaves.filter("path = 's.b.c'").collect()) == 20


def test_variant_inside_typed_document(spark):
    schema = "id int, s struct<name:string,raw:string>"
    df = spark.createDataFrame([(1, ("n", '{"email": "a@x.io", "l": [{"k": "v"}]}')), (2, ("n", None))], schema)
    df = df.select("id", F.struct(F.col("s.name"), F.try_parse_json("s.raw").alias("raw")).alias("d"))
    leaves = {(r["path"], r["value"]) for r in docs.doc_walk(df, "id", "d").filter("id = 1 and not is_key").collect()}
    assert leaves == {("name", "n"), ("raw.email", "a@x.io"), ("raw.l[].k", "v")}
    out = docs.doc_mask(df, "d", policy(labels=[PathLabel("raw.l[].k")], detection=Detection()))
    shown = [r[0] for r in out.orderBy("id").select(F.to_json("d.raw")).collect()]
    assert json.loads(shown[0]) == {"email": "[redacted]", "l": [{"k": "[redacted]"}]} and shown[1] is None


def test_documents_without_a_hit_stay(spark):
    card = "4111111111111111"
    rows = [' {"z":1,"a":[ 1 , 2]}', card, f'"{card}"', "true", '{"a":"x", "a":"y"}', f'{{"n": 1,"c":"{card}"}}', "[]", f"  {card} ", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, j string")
    policy = Policy(object_id="o", detection=Detection())
    got = [r["j"] for r in docs.doc_mask(df, "j", policy).orderBy("id").collect()]
    assert got == [rows[0], "[redacted]", '"[redacted]"', "true", '{"a":"y"}', '{"c":"[redacted]","n":1}', "[]", "  [redacted] ", None]
    assert [r["doc_state"] for r in docs.doc_state(df, "j").orderBy("id").collect()] == ["json", "text", "text", "text", "json", "json", "json", "text", "null"]
    bare = df.where("id in (1, 2)").withColumn("j", F.try_parse_json("j"))  # a VARIANT may be a bare value
    assert [r["j"].toJson() for r in docs.doc_mask(bare, "j", policy).orderBy("id").collect()] == [card, '"[redacted]"']


@pytest.mark.parametrize(
    "kind, hidden",
    [("Secret", 1), ("&k Secret", 1), (">-\n  Secret", 1), ("!!str sEcret", 1), ('"\\x53ecret"', 1), ('"Sec\\\n  ret"', 1), ("Secret\nkind: Pod", 2), ("[Secret", 2), ("Pod # secret", 0)],
)
def test_spellings_of_secrets(kind, hidden):
    text = f"kind: {kind}\ndata:\n  k: value\n"
    shown = hide_secrets(text, _yaml_loader())
    assert ("value" in shown) == (not hidden) and (shown == docs.SECRET) == (hidden == 2) and (shown == text) == (not hidden)
    assert "value" not in hide_secrets(f"? kind\n: {kind}\ndata: {{k: value}}", _yaml_loader()) or hidden == 0 or kind.count("\n")
    assert hide_secrets("my secret data is here", _yaml_loader()) == "my secret data is here"
