"""Nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions.text import query_path
from hushframe.operators import documents as docs
from hushframe.operators import labels as labelling
from hushframe.plans import jobs
from hushframe.plans.policy import Detection, OverlayRule, PathLabel, Policy, Recognizer
from hushframe.session import shared_folder
from queries.base import Tables, partial_sql, query
from queries.derived import ORDER_LEAVES, ORDERS_JOINED, order_documents

OBJ = "org1:mongo:shop:orders"


def _summary(leaves):
    """Equal leaves are counted first, by hash: smallest and largest texts are found by sorting, then of distinct ones."""
    distinct = leaves.groupBy("path", "key", "is_key", "value").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("path", "key", "is_key").agg(
        F.sum("n").alias("n"),
        F.count("value").alias("n_values"),
        F.min("value").alias("first_value"),
        F.max("value").alias("last_value"),
        F.sum(F.length("value") * F.col("n")).alias("chars"),
    )


_SUMMARY = """SELECT path, key, is_key, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS first_value,
  max(value) AS last_value, sum(length(value))::BIGINT AS chars FROM leaves GROUP BY path, key, is_key"""


@query("N1_doc_walk", f"WITH {ORDER_LEAVES} {_SUMMARY}")
def walk(spark, sf):
    return _summary(docs.doc_walk(order_documents(spark, sf), "doc_id", "doc"))


@query("N1_doc_walk_leaves", f"WITH {ORDER_LEAVES} SELECT * FROM leaves WHERE path = 'lines[].flag' OR path = 'customer'")
def walk_rows(spark, sf):
    leaves = docs.doc_walk(order_documents(spark, sf), "doc_id", "doc")
    return leaves.filter(F.col("path").isin("lines[].flag", "customer"))


# the placed date is text in JSON
_JSON_LEAVES = ORDER_LEAVES.removesuffix(")") + """
  UNION ALL SELECT o_orderkey, 'placed', 'placed', strftime(o_orderdate, '%Y-%m-%d'), false FROM o)"""


def _json_documents(spark, sf):
    dated = F.col("doc").withField("placed", F.date_format("doc.placed", "yyyy-MM-dd"))
    return order_documents(spark, sf).select("doc_id", F.to_json(dated).alias("doc"))


@query("N1_doc_walk_json", f"WITH {_JSON_LEAVES} {_SUMMARY}")
def walk_json(spark, sf):
    return _summary(docs.doc_walk(_json_documents(spark, sf), "doc_id", "doc"))


@query(
    "N1_doc_walk_props",
    """SELECT '' AS path, t.key AS key, true AS is_key, count(*) AS n FROM events, json_tree(props) t WHERE t.key IS NOT NULL
    GROUP BY t.key""",
)
def walk_props(spark, sf):
    leaves = docs.doc_walk(Tables(spark, sf).events, "event_id", "props")
    return leaves.groupBy("path", "key", "is_key").agg(F.count(F.lit(1)).alias("n"))


MASKED = Policy(
    object_id=OBJ,
    overlay={"SEGMENT": OverlayRule(partial=True)},
    labels=[PathLabel("customer.name"), PathLabel("lines[].flag", "partial_mask"), PathLabel("priority", "do_not_mask")],
)


def _flat(df):
    joined = lambda name: F.array_join(F.transform("doc.lines", lambda l: l[name].cast("string")), ",")
    return df.select(
        "doc_id",
        F.col("doc.customer.name").alias("name"),
        F.col("doc.customer.segment").alias("segment"),
        F.col("doc.customer.balance").alias("balance"),
        F.col("doc.priority").alias("priority"),
        F.col("doc.status").alias("status"),
        F.col("doc.placed").alias("placed"),
        F.col("doc.total").alias("total"),
        joined("flag").alias("flags"),
        joined("status").alias("line_status"),
        joined("no").alias("nos"),
    )


def _flat_sql(**changed: str) -> str:
    values = {
        "name": "c_name",
        "segment": "c_mktsegment",
        "balance": "c_acctbal",
        "priority": "o_orderpriority",
        "status": "o_orderstatus",
        "placed": "o_orderdate",
        "total": "o_totalprice",
        "flags": "string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus)",
        "line_status": "string_agg(l_linestatus, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus)",
        "nos": "string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus)",
    }
    values.update(changed)
    shown = ", ".join(
        f"{'coalesce(' + v + ', ' + chr(39) * 2 + ')' if 'string_agg' in v else 'any_value(' + v + ')'} AS {k}"
        for k, v in values.items()
    )
    return f"WITH {ORDERS_JOINED} SELECT o_orderkey AS doc_id, {shown} FROM o LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY o_orderkey"


_FLAGS = "string_agg('*', ',' ORDER BY l_linenumber) FILTER (l_orderkey IS NOT NULL)"


@query("N2_doc_mask", _flat_sql(name="'[redacted]'", segment=partial_sql("c_mktsegment"), flags=_FLAGS))
@query("C2_mask_documents", _flat_sql(name="'[redacted]'", segment=partial_sql("c_mktsegment"), flags=_FLAGS))
def mask(spark, sf):
    return _flat(jobs.mask_documents(order_documents(spark, sf), ["doc"], MASKED))


@query(
    "N3_doc_typed_mask",
    _flat_sql(
        balance="0.0::DOUBLE",
        placed="TIMESTAMP '1970-01-01'",
        nos="string_agg('0', ',') FILTER (l_orderkey IS NOT NULL)",
    ),
)
def mask_typed(spark, sf):
    found = [PathLabel("customer.balance"), PathLabel("placed", "partial_mask"), PathLabel("lines[].no"), PathLabel("total", "do_not_mask")]
    return _flat(docs.doc_mask(order_documents(spark, sf), "doc", Policy(object_id=OBJ, labels=found)))


@query(
    "N2_doc_mask_json",
    f"""SELECT o_orderkey AS doc_id, '[redacted]' AS name, {partial_sql('c_mktsegment')} AS segment, 0::BIGINT AS total,
      o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def mask_json(spark, sf):
    policy = Policy(object_id=OBJ, overlay={"segment": OverlayRule(partial=True)}, labels=[PathLabel("customer.name"), PathLabel("total")])
    masked = docs.doc_mask(_json_documents(spark, sf), "doc", policy)
    got = lambda path: F.get_json_object("doc", f"$.{path}")
    return masked.select(
        "doc_id",
        got("customer.name").alias("name"),
        got("customer.segment").alias("segment"),
        got("total").cast("bigint").alias("total"),
        got("priority").alias("priority"),
    )


@query(
    "N4_doc_replace",
    f"""WITH {ORDERS_JOINED} SELECT o_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'R') AS replaced,
      coalesce(string_agg(CASE l_returnflag WHEN 'R' THEN 'back' ELSE l_returnflag END, ','
        ORDER BY l_linenumber, l_returnflag, l_linestatus), '') AS flags
    FROM o LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def replace(spark, sf):
    out = docs.doc_replace(
        order_documents(spark, sf), "doc", "lines[].flag", lambda c: F.lit("back"), where=lambda c: c == "R"
    )
    return out.select("doc_id", "replaced", F.array_join("doc.lines.flag", ",").alias("flags"))


@query(
    "N4_rename_keys",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END::BIGINT AS replaced,
      CASE WHEN event_type = 'error' THEN 'error' ELSE '***' END AS first_key, user_id::VARCHAR AS first_value FROM events""",
)
def rename(spark, sf):
    doc = F.create_map(F.col("event_type"), F.col("user_id").cast("string"))
    df = Tables(spark, sf).events.select("event_id", doc.alias("doc"))
    out = docs.doc_replace(df, "doc", "", lambda k: F.lit("***"), where=lambda k: k != "error", keys=True)
    return out.select(
        "event_id", "replaced", F.map_keys("doc")[0].alias("first_key"), F.map_values("doc")[0].alias("first_value")
    )


@query(
    "N5_query_path",
    f"""WITH {ORDER_LEAVES} SELECT path, replace(path, '[]', '') AS plain_path, count(*) AS n FROM leaves GROUP BY path""",
)
def plain(spark, sf):
    leaves = docs.doc_walk(order_documents(spark, sf), "doc_id", "doc")
    counted = leaves.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("plain_path", query_path(F.col("path")))


@query(
    "N6_secret_manifest_mask",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'text c_name' WHEN c_mktsegment = 'MACHINERY' THEN c_name
      ELSE '***redacted***' END AS shown, c_mktsegment AS label FROM customer""",
)
def secrets(spark, sf):
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "ConfigMap").otherwise("sEcret")
    manifest = F.struct(
        kind.alias("kind"), F.struct(F.col("c_name").alias("k")).alias("data"), F.col("c_mktsegment").alias("label")
    )
    listed = F.struct(F.lit("List").alias("kind"), F.array(manifest).alias("items"))
    text = (
        F.when(F.col("c_mktsegment") == "BUILDING", "text c_name")
        .when(F.col("c_mktsegment") == "FURNITURE", F.to_json(listed))
        .otherwise(F.to_json(manifest))
    )
    df = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment", text.alias("body"))
    got = lambda path: F.get_json_object("body", path)
    return docs.secret_manifest_mask(df, "body").select(
        "c_custkey",
        F.coalesce(got("$.data.k"), got("$.items[0].data.k"), F.col("body")).alias("shown"),
        F.coalesce(got("$.label"), got("$.items[0].label"), F.col("c_mktsegment")).alias("label"),
    )


@query(
    "N7_depth_guard",
    """SELECT doc_id, CASE WHEN n_chars % 120 + 1 > 101 THEN true ELSE false END AS too_deep FROM documents""",
)
def depth(spark, sf):
    n = (F.pmod(F.col("n_chars"), F.lit(120)) + 1).cast("int")
    body = F.concat(F.repeat(F.lit("["), n), F.lit('"]]{{"'), F.repeat(F.lit("]"), n))
    df = Tables(spark, sf).documents.select("doc_id", body.alias("body"))
    return docs.depth_guard(df, "body").select("doc_id", "too_deep")


def _order_labels(t):
    """Labels of the order documents, written from the statuses that occur."""
    rows = (
        ("customer.name", "name_fields", "manual", "full_redact"),
        ("flag", "flag_fields", "platform", "partial_mask"),
        ("priority", "priority_fields", "manual", "do_not_mask"),
        ("segment", "segment_fields", "proposed", ""),
        ("lines[].status", "status_fields", "dismissed", ""),
    )
    names = ("field_path", "category", "source", "profile")
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])
    found = t.orders.select("o_orderstatus").distinct().select(F.inline(each)).distinct()
    return found.withColumns({"object_id": F.lit(OBJ), "match_mode": F.lit("")})


@query(
    "J1_label_lookup",
    f"""WITH {ORDER_LEAVES} SELECT path, CASE path WHEN 'customer.name' THEN 'name_fields' WHEN 'lines[].flag' THEN 'flag_fields'
        WHEN 'priority' THEN 'priority_fields' END AS category,
      CASE path WHEN 'customer.name' THEN 'path' WHEN 'lines[].flag' THEN 'key' WHEN 'priority' THEN 'path' END AS matched_by,
      count(*) AS n FROM leaves WHERE NOT is_key GROUP BY path""",
)
def lookup(spark, sf):
    t = Tables(spark, sf)
    leaves = docs.doc_walk(order_documents(spark, sf), "doc_id", "doc").filter(~F.col("is_key"))
    table = _order_labels(t)
    hit = labelling.label_lookup(leaves.withColumn("object_id", F.lit(OBJ)), table)
    return hit.groupBy("path", "category", "matched_by").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P6_mask_by_lookup",
    f"""WITH {ORDER_LEAVES} SELECT path, CASE path WHEN 'customer.name' THEN '[redacted]' WHEN 'lines[].flag' THEN '*' ELSE value END
      AS value, count(*) AS n FROM leaves WHERE NOT is_key GROUP BY ALL""",
)
def mask_rows(spark, sf):
    t = Tables(spark, sf)
    leaves = docs.doc_walk(order_documents(spark, sf), "doc_id", "doc").filter(~F.col("is_key"))
    masked = labelling.mask_by_lookup(leaves.withColumn("object_id", F.lit(OBJ)), _order_labels(t))
    return masked.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))


def _deep(spark, sf):
    """Documents of every depth up to the limit."""
    n = (F.pmod(F.col("n_chars"), F.lit(100)) + 1).cast("int")
    body = F.concat(F.repeat(F.lit('{"k":'), n), F.lit('"'), F.col("lang"), F.lit('"'), F.repeat(F.lit("}"), n))
    return Tables(spark, sf).documents.select("doc_id", body.alias("body"))


@query(
    "N1_doc_walk_depths",
    """SELECT doc_id, repeat('k.', (n_chars % 100)::INTEGER) || 'k' AS path, lang AS value, (n_chars % 100 + 1) AS n_keys FROM documents""",
)
def walk_depths(spark, sf):
    leaves = docs.doc_walk(_deep(spark, sf), "doc_id", "body")
    return leaves.groupBy("doc_id").agg(
        F.max(F.when(~F.col("is_key"), F.col("path"))).alias("path"),
        F.max(F.when(~F.col("is_key"), F.col("value"))).alias("value"),
        F.count_if("is_key").alias("n_keys"),
    )


@query(
    "N2_doc_mask_depths",
    """SELECT doc_id, repeat('{"k":', (n_chars % 100 + 1)::INTEGER) || '"[k]"' || repeat('}', (n_chars % 100 + 1)::INTEGER) AS body FROM documents""",
)
def mask_depths(spark, sf):
    return docs.doc_mask(_deep(spark, sf), "body", Policy(object_id=OBJ, overlay={"K": "[k]"}))


@query(
    "N2_doc_mask_unread",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"email":"[mail]","n":1.50}' WHEN 1 THEN '{"email":"[redacted]", '
      WHEN 2 THEN '[[[[[1]]]]]' WHEN 3 THEN lang || ' [redacted]' ELSE repeat('[', 150) || '"[redacted]"' END AS body,
      CASE doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'broken' WHEN 2 THEN 'json' WHEN 3 THEN 'text' ELSE 'broken' END AS state
    FROM documents""",
)
def mask_unread(spark, sf):
    """Repeated keys, broken and too deep documents, plain text: none passes with what it hides."""
    kind, address = F.col("doc_id") % 5, F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("@example.org"))
    body = (
        F.when(kind == 0, F.concat(F.lit('{"email":"first","n":1.50,"email":"'), F.col("lang"), F.lit('"}')))
        .when(kind == 1, F.concat(F.lit('{"email":"'), address, F.lit('", ')))
        .when(kind == 2, F.lit("[[[[[1]]]]]"))
        .when(kind == 3, F.concat_ws(" ", "lang", address))
        .otherwise(F.concat(F.repeat(F.lit("["), F.lit(150)), F.lit('"'), address, F.lit('"')))
    )
    df = docs.doc_state(Tables(spark, sf).documents.select("doc_id", body.alias("body")), "body")
    masked = docs.doc_mask(df, "body", Policy(object_id=OBJ, overlay={"email": "[mail]"}, detection=Detection()))
    return masked.select("doc_id", "body", F.col("doc_state").alias("state"))


@query(
    "N2_doc_mask_untouched",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' {"z": "' || lang || '", "a": [1 , 2.50]} ' WHEN 1 THEN '[redacted]' WHEN 2 THEN '"[redacted]"'
      WHEN 3 THEN '{"a":"[redacted]","b":"' || lang || '"}' ELSE '12' END AS body FROM documents""",
)
def mask_untouched(spark, sf):
    """Documents without a hit come back as they were written; bare numbers and strings are texts like any other."""
    kind = F.col("doc_id") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit(' {"z": "'), "lang", F.lit('", "a": [1 , 2.50]} ')))
        .when(kind == 1, F.lit("4111111111111111"))
        .when(kind == 2, F.lit('"4111111111111111"'))
        .when(kind == 3, F.concat(F.lit('{"b" : "'), "lang", F.lit('", "a":"x@example.org"}')))
        .otherwise(F.lit("12"))
    )
    df = Tables(spark, sf).documents.select("doc_id", body.alias("body"))
    return docs.doc_mask(df, "body", Policy(object_id=OBJ, detection=Detection()))


@query(
    "N6_secret_manifest_yaml",
    """SELECT c_custkey, c_custkey % 8 < 6 AS hidden, c_custkey % 8 IN (4, 5) AS hidden_whole FROM customer""",
)
def yaml_secrets(spark, sf):
    """YAML spellings of a secret, one that cannot be read, one with repeated keys, and a map that is none."""
    kinds = ["Secret", "&k sEcret", ">-\n  Secret", '"\\x53ecret"', "Secret\nkind: ConfigMap", "[Secret", "ConfigMap # no secret", "ConfigMap"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % 8).cast("int"))
    body = F.concat(F.lit("metadata: {name: x}\nkind: "), kind, F.lit("\ndata:\n  k: "), "c_name", F.lit("\n"))
    df = Tables(spark, sf).customer.select("c_custkey", "c_name", body.alias("body"))
    shown = docs.secret_manifest_mask(df, "body")
    return shown.select("c_custkey", (~F.contains("body", F.col("c_name"))).alias("hidden"), (F.col("body") == docs.SECRET).alias("hidden_whole"))


COUNTED = Policy(
    object_id=OBJ,
    overlay={"SEGMENT": OverlayRule(partial=True)},
    labels=[
        PathLabel("customer.name", category="name_fields"),
        PathLabel("lines[].flag", "partial_mask", "flag_fields"),
        PathLabel("customer.balance", category="balance_fields"),
        PathLabel("segment", "partial_mask", " "),
        PathLabel("priority", "do_not_mask", "priority_fields"),
    ],
    detection=Detection(recognizers=[Recognizer("CUSTOMER_NO", "#[0-9]+", 0.8)]),
)


def _counts_sql(connection: str, looked: str, dated: bool) -> str:
    """Counts over the order documents. Names are masked by content before their label measures them."""
    name = "regexp_replace(c_name, '#[0-9]+', '[redacted]')"
    return f"""WITH {ORDERS_JOINED}, parts AS (
      SELECT 'UNSPECIFIED' AS entity_type, 'recognizer' AS detection_source,
        count(*) FILTER (strlen(c_name) >= 4) + count(*) FILTER (strlen(c_mktsegment) >= 4) + count(*) FILTER (strlen(o_orderpriority) >= 4)
          + {'count(o_orderdate)' if dated else '0'} AS count_analyzed, 0 AS count_masked, 0 AS bytes_masked FROM o
      UNION ALL SELECT 'CUSTOMER_NO', 'recognizer', 0, count(*), sum(length(regexp_extract(c_name, '#[0-9]+'))) FROM o WHERE c_name LIKE '%#%'
      UNION ALL SELECT 'UNSPECIFIED', 'field_rule', {looked}, count(c_mktsegment), sum(strlen(c_mktsegment)) FROM o
      UNION ALL SELECT 'UNSPECIFIED', 'field_rule', 3 * count(*), 0, 0 FROM li
      UNION ALL SELECT 'name_fields', 'field_rule', 0, count(c_name), sum(strlen({name})) FROM o
      UNION ALL SELECT 'balance_fields', 'field_rule', 0, count(c_acctbal), sum(strlen(c_acctbal::VARCHAR)) FROM o
      UNION ALL SELECT 'flag_fields', 'field_rule', 0, count(l_returnflag), sum(strlen(l_returnflag)) FROM li)
    SELECT '{connection}' AS connection_key, entity_type, detection_source, sum(count_analyzed)::BIGINT AS count_analyzed,
      sum(count_masked)::BIGINT AS count_masked, sum(bytes_masked)::BIGINT AS bytes_masked FROM parts GROUP BY entity_type, detection_source"""


_LOOKED = "count(c_name) + count(c_mktsegment) + count(c_acctbal) + count(o_orderdate) + count(o_orderpriority) + count(o_orderstatus) + count(o_totalprice)"


@query("C5_report_of_documents", _counts_sql("mongo__reader", _LOOKED, dated=False))
def count_documents(spark, sf):
    """Leaves of documents with a schema, counted by all layers."""
    return jobs.masking_report(order_documents(spark, sf), COUNTED, F.lit("mongo__reader"), doc_cols=["doc"])


@query("C5_mask_and_report", _counts_sql("mongo__writer", _LOOKED, dated=True))
def mask_and_count(spark, sf):
    """JSON documents are masked and written; the counts come from that very pass, as observed metrics."""
    path = shared_folder(spark, "masked")
    return jobs.mask_and_report(_json_documents(spark, sf), COUNTED, "mongo__writer", lambda rows: rows.write.parquet(path), doc_cols=["doc"])


@query(
    "C2_documents_of_the_pass",
    f"""SELECT o_orderkey AS doc_id, '[redacted]' AS name, {partial_sql(partial_sql('c_mktsegment'))} AS segment, 0::BIGINT AS balance,
      o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def mask_counted(spark, sf):
    """The documents that the counting pass writes."""
    path = shared_folder(spark, "masked")
    jobs.mask_and_report(_json_documents(spark, sf), COUNTED, "mongo__writer", lambda rows: rows.write.parquet(path), doc_cols=["doc"])
    got = lambda path: F.get_json_object("doc", f"$.{path}")
    return spark.read.parquet(path).select(
        "doc_id",
        got("customer.name").alias("name"),
        got("customer.segment").alias("segment"),
        got("customer.balance").cast("bigint").alias("balance"),
        got("priority").alias("priority"),
    )
