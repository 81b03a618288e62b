"""Tables the jobs keep, derived from the given ones so that they grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import Tables


def path_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A label table with one field per document: who decided follows the quality marks."""
    t = Tables(spark, sf)
    joined = t.documents.join(t.labels, "doc_id", "left")
    source = (
        F.when(F.col("toxic") == 1, "dismissed")
        .when(F.col("quality") == 1, "manual")
        .when(F.col("quality") == 0, "platform")
        .otherwise("proposed")
    )
    profile = F.when(F.col("lang") == "en", "full_redact").when(F.col("lang") == "de", "partial_mask").otherwise("do_not_mask")
    day = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(days=F.pmod(F.col("n_chars"), F.lit(365)).cast("int"))
    return joined.select(
        F.concat(F.lit("org1:spark:lake:"), F.col("source")).alias("object_id"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("field_path"),
        F.when(F.col("lang") == "fr", "").otherwise("path").alias("match_mode"),
        F.concat(F.col("lang"), F.lit("_fields")).alias("category"),
        profile.alias("profile"),
        source.alias("source"),
        (F.pmod(F.col("n_chars"), F.lit(1000)) / 1000.0).alias("confidence"),
        F.col("n_chars").alias("sample_count"),
        day.alias("last_observed_at"),
        day.alias("updated_at"),
        F.col("source").alias("updated_by"),
        F.col("doc_id").alias("seq"),
    )


PATH_LABELS = """path_labels AS (
  SELECT 'org1:spark:lake:' || d.source AS object_id, 'f' || d.doc_id AS field_path,
    CASE WHEN d.lang = 'fr' THEN '' ELSE 'path' END AS match_mode, d.lang || '_fields' AS category,
    CASE d.lang WHEN 'en' THEN 'full_redact' WHEN 'de' THEN 'partial_mask' ELSE 'do_not_mask' END AS profile,
    CASE WHEN l.toxic = 1 THEN 'dismissed' WHEN l.quality = 1 THEN 'manual' WHEN l.quality = 0 THEN 'platform'
      ELSE 'proposed' END AS source,
    (d.n_chars % 1000) / 1000.0::DOUBLE AS confidence, d.n_chars AS sample_count,
    TIMESTAMP '2024-01-01' + to_days((d.n_chars % 365)::INTEGER) AS last_observed_at,
    TIMESTAMP '2024-01-01' + to_days((d.n_chars % 365)::INTEGER) AS updated_at,
    d.source AS updated_by, d.doc_id AS seq
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def event_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """One proposal per event, many for the same field."""
    e = Tables(spark, sf).events
    return e.select(
        F.concat(F.lit("org1:spark:app:"), F.col("event_type")).alias("object_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("field_path"),
        F.when(F.col("value") > 50, "key_any_depth").otherwise("").alias("match_mode"),
        F.when(F.col("value") > 20, "email_fields").otherwise("phone_fields").alias("category"),
        F.when(F.col("value") > 10, "full_redact").otherwise("").alias("profile"),
        F.when(F.col("value") > 300, "manual").when(F.col("value") > 250, "dismissed").otherwise("proposed").alias("source"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.floor(F.col("value")).cast("bigint").alias("sample_count"),
        F.col("ts").alias("last_observed_at"),
        F.col("ts").alias("updated_at"),
        F.col("event_type").alias("updated_by"),
        F.col("event_id").alias("seq"),
    )


EVENT_PROPOSALS = """props AS (
  SELECT 'org1:spark:app:' || event_type AS object_id, 'u' || user_id AS field_path,
    CASE WHEN value > 50 THEN 'key_any_depth' ELSE '' END AS match_mode,
    CASE WHEN value > 20 THEN 'email_fields' ELSE 'phone_fields' END AS category,
    CASE WHEN value > 10 THEN 'full_redact' ELSE '' END AS profile,
    CASE WHEN value > 300 THEN 'manual' WHEN value > 250 THEN 'dismissed' ELSE 'proposed' END AS source,
    least(value / 500, 1.0::DOUBLE) AS confidence, floor(value)::BIGINT AS sample_count,
    ts AS last_observed_at, ts AS updated_at, event_type AS updated_by, event_id AS seq
  FROM events)"""


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One nested document per order with its customer and lines: doc_id, doc."""
    t = Tables(spark, sf)
    line = F.struct(
        F.col("l_linenumber").alias("no"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")
    )
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    # What is done with a document costs far more than its bytes: it lies over all partitions, which adaptive execution
    # would merge by size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).repartition(parts, "o_orderkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    doc = F.struct(
        F.struct(
            F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
        ).alias("customer"),
        F.coalesce("lines", F.array().cast("array<struct<no:int,flag:string,status:string>>")).alias("lines"),
        F.col("o_orderdate").alias("placed"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
    )
    return joined.select(F.col("o_orderkey").alias("doc_id"), doc.alias("doc"))


ORDERS_JOINED = """o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
li AS (SELECT l.* FROM lineitem l JOIN o ON l_orderkey = o_orderkey)"""

ORDER_LEAVES = ORDERS_JOINED + """,
leaves AS (
  SELECT o_orderkey AS doc_id, '' AS path, k AS key, k AS value, true AS is_key
    FROM o, unnest(['customer', 'lines', 'placed', 'priority', 'status', 'total']) AS x(k)
  UNION ALL SELECT o_orderkey, 'customer', k, k, true FROM o, unnest(['name', 'segment', 'balance']) AS x(k)
  UNION ALL SELECT l_orderkey, 'lines[]', k, k, true FROM li, unnest(['no', 'flag', 'status']) AS x(k)
  UNION ALL SELECT o_orderkey, 'customer.name', 'name', c_name, false FROM o
  UNION ALL SELECT o_orderkey, 'customer.segment', 'segment', c_mktsegment, false FROM o
  UNION ALL SELECT o_orderkey, 'priority', 'priority', o_orderpriority, false FROM o
  UNION ALL SELECT o_orderkey, 'status', 'status', o_orderstatus, false FROM o
  UNION ALL SELECT l_orderkey, 'lines[].flag', 'flag', l_returnflag, false FROM li
  UNION ALL SELECT l_orderkey, 'lines[].status', 'status', l_linestatus, false FROM li)"""


def sessions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Start and end records read out of the event log."""
    e = Tables(spark, sf).events
    starts = e.filter(F.col("event_type").isin("signup", "view")).select(
        F.col("event_id").cast("string").alias("session_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor"),
        F.col("ts").alias("started_at"),
    )
    ended = F.when(F.col("event_type") == "error", "").otherwise((F.col("event_id") - 1).cast("string"))
    ends = e.filter(F.col("event_type").isin("purchase", "click", "error")).select(
        ended.alias("session_id"), F.col("ts").alias("ended_at"), F.col("event_type").alias("status")
    )
    return starts, ends


SESSIONS = """starts AS (SELECT event_id::VARCHAR AS session_id, 'user' || user_id AS actor, ts AS started_at
  FROM events WHERE event_type IN ('signup', 'view')),
ends AS (SELECT CASE WHEN event_type = 'error' THEN '' ELSE (event_id - 1)::VARCHAR END AS session_id,
  ts AS ended_at, event_type AS status FROM events WHERE event_type IN ('purchase', 'click', 'error'))"""


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """A query log written from the events: id, sql, doc, graph, cloud, cluster."""
    e = Tables(spark, sf).events
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return e.select(
        F.col("event_id").alias("id"),
        F.when(kind == "purchase", c("/* pay */ INSERT INTO buys VALUES (", user, ")"))
        .when(kind == "signup", c("WITH n AS (UPDATE users SET seen = 1 WHERE id = ", user, ") SELECT * FROM n"))
        .when(kind == "error", c("SELECT 'it''s no DELETE', ", user, " -- drop table"))
        .otherwise(c("SELECT updated_at FROM ", kind, " WHERE id = ", user))
        .alias("sql"),
        F.when(kind == "purchase", c("db.buys.insertOne({u:", user, "})"))
        .when(kind == "signup", c('db.u.aggregate([{"$MERGE":{into:"', user, '"}}])'))
        .otherwise(c("db.", kind, ".find({updatedAt:", user, "})"))
        .alias("doc"),
        F.when(kind == "purchase", c("MATCH (n {id:", user, "}) SET n.paid = true"))
        .when(kind == "signup", c("call  apoc.create.node(", user, ")"))
        .when(kind == "error", c("MATCH (n) WHERE n.x = 'MERGE' RETURN ", user))
        .otherwise(c("CALL db.labels() YIELD label RETURN label, ", user))
        .alias("graph"),
        F.when(kind == "purchase", c("aws ec2 describe-instances --region r", user))
        .when(kind == "signup", c("aws --region 'r ", user, "' secretsmanager get-secret-value --secret-id x"))
        .when(kind == "error", c("aws s3 cp s3://a/", user, " ."))
        .when(kind == "view", c("aws --profile p", user, " ec2 list-x"))
        .otherwise(c("aws s3 ls | grep ", user))
        .alias("cloud"),
        F.when(kind == "purchase", c("kubectl get -o wide Pods p", user))
        .when(kind == "signup", c("kubectl exec p", user, " -- sh"))
        .when(kind == "error", c("kubectl delete pod p", user))
        .when(kind == "view", c("kubectl logs 'pod ", user, "' --tail 5"))
        .otherwise(c("helm ls ", user))
        .alias("cluster"),
    )


STATEMENTS = """log AS (SELECT event_id AS id,
  CASE event_type WHEN 'purchase' THEN '/* pay */ INSERT INTO buys VALUES (' || user_id || ')'
    WHEN 'signup' THEN 'WITH n AS (UPDATE users SET seen = 1 WHERE id = ' || user_id || ') SELECT * FROM n'
    WHEN 'error' THEN 'SELECT ''it''''s no DELETE'', ' || user_id || ' -- drop table'
    ELSE 'SELECT updated_at FROM ' || event_type || ' WHERE id = ' || user_id END AS sql,
  CASE event_type WHEN 'purchase' THEN 'db.buys.insertOne({u:' || user_id || '})'
    WHEN 'signup' THEN 'db.u.aggregate([{"$MERGE":{into:"' || user_id || '"}}])'
    ELSE 'db.' || event_type || '.find({updatedAt:' || user_id || '})' END AS doc,
  CASE event_type WHEN 'purchase' THEN 'MATCH (n {id:' || user_id || '}) SET n.paid = true'
    WHEN 'signup' THEN 'call  apoc.create.node(' || user_id || ')'
    WHEN 'error' THEN 'MATCH (n) WHERE n.x = ''MERGE'' RETURN ' || user_id
    ELSE 'CALL db.labels() YIELD label RETURN label, ' || user_id END AS graph,
  CASE event_type WHEN 'purchase' THEN 'aws ec2 describe-instances --region r' || user_id
    WHEN 'signup' THEN 'aws --region ''r ' || user_id || ''' secretsmanager get-secret-value --secret-id x'
    WHEN 'error' THEN 'aws s3 cp s3://a/' || user_id || ' .'
    WHEN 'view' THEN 'aws --profile p' || user_id || ' ec2 list-x'
    ELSE 'aws s3 ls | grep ' || user_id END AS cloud,
  CASE event_type WHEN 'purchase' THEN 'kubectl get -o wide Pods p' || user_id
    WHEN 'signup' THEN 'kubectl exec p' || user_id || ' -- sh'
    WHEN 'error' THEN 'kubectl delete pod p' || user_id
    WHEN 'view' THEN 'kubectl logs ''pod ' || user_id || ''' --tail 5'
    ELSE 'helm ls ' || user_id END AS cluster
  FROM events)"""
