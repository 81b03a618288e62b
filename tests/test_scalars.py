import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions import checks, statements, text


def test_partial_mask(values):
    cases = {
        "123-45-6789": "*******6789",
        "555-1234": "****1234",
        "abcd": "****",
        "abc": "***",
        "": "",
        None: None,
        "é日本語xy": "**本語xy",
    }
    assert values(cases, text.partial_mask) == list(cases.values())


def test_eligible_counts_bytes(values):
    assert values(["abcd", "abc", "日本", "", None], text.eligible) == [True, False, True, False, False]


def test_clip_bytes(values):
    assert values(["abcdef", "é日本語", "", None], lambda c: text.clip_bytes(c, 4)) == ["abcd", "é", "", None]


def test_object_id(values):
    build = lambda org: text.object_id(org, F.lit(" PostgreSQL "), F.lit("app"), F.lit("users"))
    assert values(["acme", "", None], build) == ["acme:postgres:app:users", "", ""]
    parsed = values(["a:b:mongo:db:c", "x:y:z", ""], text.parse_object_id)
    assert [tuple(p) if p else None for p in parsed] == [("mongo", "db", "c"), None, None]


def test_connection_key(values):
    keys = values([" Postgres "], lambda c: text.connection_key(c, F.lit(" ReadOnly ")))
    assert keys == ["postgres__ReadOnly"]
    assert values(keys, text.connection_driver) == ["postgres"]


def test_query_path_and_hash(values):
    assert values(["tags[].name", "tags[]", "a.b"], text.query_path) == ["tags.name", "tags", "a.b"]
    want = hashlib.sha256(b"postgres\0app\0select 1").hexdigest()
    got = values(["select 1"], lambda c: text.request_hash(F.lit("postgres"), F.lit("app"), c))
    assert got == [want]


def test_render_row_and_doc(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert df.select(text.render_row(df)).first()[0] == "a=1, b=NULL, c=x"
    doc_type = T.StructType.fromDDL("name string, age int, tags array<string>, gone string, at timestamp")
    docs = spark.createDataFrame([(("Ann", 3, ["x"], None, None),)], T.StructType().add("d", doc_type))
    shown = docs.select(text.render_doc(F.col("d"), doc_type)).first()[0]
    assert shown == "name=Ann, age=<4 bytes>, tags=<nested>, gone=NULL, at=NULL"


@pytest.mark.parametrize(
    "check,good,bad",
    [
        (checks.luhn_ok, ["4111 1111 1111 1111", "378282246310005"], ["4111111111111112"]),
        (checks.ipv4_ok, ["1.2.3.4", "255.255.255.255"], ["256.1.1.1"]),
        (checks.ssn_ok, ["123-45-6789"], ["000-45-6789", "666-45-6789", "923-45-6789", "123-00-6789", "123-45-0000"]),
        (checks.iban_ok, ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], ["DE88370400440532013000"]),
        (
            checks.crypto_ok,
            [
                "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa",
                "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy",
                "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4",
                "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0",
            ],
            ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5"],
        ),
    ],
)
def test_checks(values, check, good, bad):
    assert values(good, check) == [True] * len(good)
    assert values(bad, check) == [False] * len(bad)


def test_write_flags_sql(values):
    reads = [
        "SELECT count(*) FROM invoices",
        "\tshow tables",
        "WITH recent AS (SELECT id FROM invoices) SELECT id FROM recent",
        "SELECT id FROM invoices WHERE memo = 'Bob''s order: merge into one, then drop it'",
        "SELECT id FROM invoices WHERE memo LIKE '%truncate%'",
        "-- insert comes later\nSELECT id FROM invoices",
        "/* grant; revoke */ SELECT created_by, deleted_at FROM invoices",
        "SELECT 'never closed UPDATE",
    ]
    writes = [
        "INSERT INTO invoices (id) VALUES (7)",
        "upDate invoices SET paid = true",
        "REVOKE ALL ON invoices FROM bob",
        "-- nothing to see\nTRUNCATE invoices",
        "/* one */ /* two */ DROP TABLE invoices",
        "WITH gone AS (DELETE FROM invoices WHERE id = 7 RETURNING id) SELECT id FROM gone",
        "TRUN/*hidden*/CATE invoices",
        "SELECT id INTO copy_of_invoices FROM invoices",
        "exec nightly_job",
    ]
    assert values(reads, statements.writes_sql) == [False] * len(reads)
    assert values(writes, statements.writes_sql) == [True] * len(writes)


def test_write_flags_other_dialects(values):
    doc = ["db.users.find({})", "db.users.insert({})", "db.createCollection('x')", '[{"$merge":{}}]', "db.u.find({updatedAt:1})"]
    assert values(doc, statements.writes_doc) == [False, True, True, True, False]
    graph = ["MATCH (n) RETURN n", "CALL db.labels()", "call  apoc.x()", "LOAD   CSV FROM 'x'", "MATCH (n) SET n.a=1", "RETURN 'SET'"]
    assert values(graph, statements.writes_graph) == [False, False, True, True, True, False]


def test_write_flags_null(spark):
    df = spark.createDataFrame([(None,)], "q string")
    assert statements.write_flags(df, "q").first()["is_write"] is False


def test_cloud_audit(values):
    cases = {
        "aws ec2 describe-instances --region us-east-1": "ok",
        "aws --region us-east-1 s3 ls": "ok",
        "aws --region=us-east-1 ec2 list": "ok",
        "aws ec2 'describe'-instances": "ok",
        "aws s3 cp a b": "'aws s3 cp' is not read-only (use 'aws s3 ls' or 's3api' read calls)",
        "aws ec2 terminate-instances": "operation 'terminate-instances' is not on the read-only allowlist",
        "aws ec2 describex": "operation 'describex' is not on the read-only allowlist",
        "aws secretsmanager get-secret-value": "operation 'get-secret-value' is not on the read-only allowlist",
        "aws ec2 describe; ls": 'shell metacharacter not allowed: ";"',
        "aws ec2 describe \\": 'shell metacharacter not allowed: "\\\\"',
        "aws ec2 describe\nls": "shell metacharacter not allowed: newline",
        "aws 'unb": "could not parse command: unbalanced quote",
        "": "empty command",
        None: "empty command",
        "ls -l": "only 'aws' commands are permitted",
        "aws --PROFILE=x ec2 describe-x": "flag not allowed: --PROFILE",
        "aws ssm get-parameter --with-decryption": "argument not allowed: --with-decryption",
        "aws": "missing AWS service (e.g. ec2, rds, s3)",
        "aws ec2": "missing AWS operation",
        "aws " + "x" * 1300: "command exceeds 1200 characters",
    }
    got = values(cases, statements.cloud_verdict)
    assert [v["reason"] for v in got] == list(cases.values())
    assert [v["allowed"] for v in got] == [r == "ok" for r in cases.values()]


def test_cluster_audit(values):
    cases = {
        "kubectl get pods -n x": ("ok", "get", "pods"),
        "kubectl get -A Pods": ("ok", "get", "pods"),
        "kubectl version": ("ok", "version", ""),
        "kubectl exec -it p": ("interactive verb not brokered: exec", "", ""),
        "kubectl delete pod x": ("verb not on read-only allowlist: delete", "", ""),
        "helm ls": ("only 'kubectl' commands are permitted", "", ""),
        "kubectl": ("only 'kubectl' commands are permitted", "", ""),
        "kubectl logs | x": ("shell metacharacter not allowed: |", "", ""),
    }
    got = values(cases, statements.cluster_verdict)
    assert [(v["reason"], v["verb"], v["resource"]) for v in got] == list(cases.values())


def test_long_inputs_do_not_overflow(values):
    long_literal = "SELECT '" + "a" * 200_000 + "''b" * 20_000 + "' DELETE"
    assert values([long_literal, "/*" + "x" * 200_000 + "*/ SELECT 1"], statements.writes_sql) == [True, False]
    long_command = "aws " + "'a b' " * 50_000
    assert values([long_command], statements.cloud_verdict)[0]["reason"] == "command exceeds 1200 characters"
