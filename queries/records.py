"""Audits over logs, sessions and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hushframe.functions import statements as stm
from hushframe.functions.text import render_doc, render_row
from hushframe.operators import series as ser
from hushframe.operators import windows as win
from hushframe.operators.labels import column_lineage_lookup
from hushframe.operators.sessions import session_join
from queries.base import Tables, query
from queries.derived import SESSIONS, STATEMENTS, order_documents, sessions, statements

_NOISE = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|('')(?:[^'']|'''')*(?:''|\z)"
_WORDS = "|".join(stm.SQL_WRITE_WORDS)
_GRAPH = "|".join(stm.GRAPH_WRITE_WORDS)
_DOC = stm.DOC_WRITE.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_NOISE}', '\\1', 'g')"


@query("F3_write_flags_sql", f"WITH {STATEMENTS} SELECT id, sql, regexp_matches({_strip('sql')}, '(?i)\\b(?:{_WORDS})\\b') AS is_write FROM log")
def sql_writes(spark, sf):
    return stm.write_flags(statements(spark, sf).select("id", "sql"), "sql", "sql")


@query(
    "F3_write_flags_text",
    f"SELECT doc_id, regexp_matches({_strip('text')}, '(?i)\\b(?:{_WORDS})\\b') AS is_write FROM documents",
)
def text_writes(spark, sf):
    return stm.write_flags(Tables(spark, sf).documents.select("doc_id", "text"), "text").select("doc_id", "is_write")


@query("F4_write_flags_doc", f"WITH {STATEMENTS} SELECT id, doc, regexp_matches(lower(doc), '{_DOC}') AS is_write FROM log")
def doc_writes(spark, sf):
    return stm.write_flags(statements(spark, sf).select("id", "doc"), "doc", "doc")


@query(
    "F5_write_flags_graph",
    f"""WITH {STATEMENTS} SELECT id, graph, regexp_matches({_strip('graph')}, '(?i)\\b(?:{_GRAPH})\\b')
      OR regexp_matches({_strip('graph')}, '(?i)\\bCALL\\s+(?:dbms|apoc)\\.') AS is_write FROM log""",
)
def graph_writes(spark, sf):
    return stm.write_flags(statements(spark, sf).select("id", "graph"), "graph", "graph")


# the log holds these five kinds of commands; every other reason is pinned by literal tests
@query(
    "F6_cli_audit_cloud",
    f"""WITH {STATEMENTS} SELECT id, cloud, NOT contains(cloud, '|') AND NOT contains(cloud, '--profile')
        AND NOT contains(cloud, ' cp ') AND NOT contains(cloud, 'get-secret-value') AS allowed,
      CASE WHEN contains(cloud, '|') THEN 'shell metacharacter not allowed: "|"'
        WHEN contains(cloud, '--profile') THEN 'flag not allowed: --profile'
        WHEN contains(cloud, ' cp ') THEN '''aws s3 cp'' is not read-only (use ''aws s3 ls'' or ''s3api'' read calls)'
        WHEN contains(cloud, 'get-secret-value') THEN 'operation ''get-secret-value'' is not on the read-only allowlist'
        ELSE 'ok' END AS reason,
      CASE WHEN contains(cloud, ' ec2 ') THEN 'ec2' WHEN contains(cloud, ' s3 ') THEN 's3' ELSE 'secretsmanager' END AS service,
      regexp_extract(cloud, '(describe-instances|get-secret-value|cp|list-x|ls)', 1) AS operation FROM log""",
)
def cloud(spark, sf):
    return stm.cli_audit(statements(spark, sf).select("id", "cloud"), "cloud", "cloud")


@query(
    "F6_cli_audit_cluster",
    f"""WITH {STATEMENTS}, v AS (SELECT *, split_part(cluster, ' ', 2) AS verb_ FROM log)
    SELECT id, cluster, verb_ IN ('get', 'logs') AND starts_with(cluster, 'kubectl') AS allowed,
      CASE WHEN NOT starts_with(cluster, 'kubectl') THEN 'only ''kubectl'' commands are permitted'
        WHEN verb_ = 'exec' THEN 'interactive verb not brokered: exec'
        WHEN verb_ = 'delete' THEN 'verb not on read-only allowlist: delete' ELSE 'ok' END AS reason,
      CASE WHEN verb_ IN ('get', 'logs') THEN verb_ ELSE '' END AS verb,
      CASE verb_ WHEN 'get' THEN 'wide' WHEN 'logs' THEN regexp_extract(cluster, '''([^'']*)''', 1) ELSE '' END AS resource FROM v""",
)
def cluster(spark, sf):
    return stm.cli_audit(statements(spark, sf).select("id", "cluster"), "cluster", "cluster")


@query(
    "F1_render_row",
    """SELECT c_custkey, 'c_custkey=' || c_custkey || ', c_name=' || coalesce(c_name, 'NULL') || ', c_mktsegment='
      || coalesce(nullif(c_mktsegment, 'BUILDING'), 'NULL') AS line FROM customer""",
)
def rows(spark, sf):
    df = Tables(spark, sf).customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return df.select("c_custkey", render_row(df, ["c_custkey", "c_name", "c_mktsegment"]).alias("line"))


@query(
    "F2_render_doc",
    """SELECT o_orderkey AS doc_id, 'customer=<nested>, lines=<nested>, placed=<8 bytes>, priority=' || o_orderpriority || ', status='
      || o_orderstatus || ', total=<8 bytes>' AS line FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def doc_lines(spark, sf):
    df = order_documents(spark, sf)
    return df.select("doc_id", render_doc(F.col("doc"), df.schema["doc"].dataType).alias("line"))


@query(
    "W2_transcript_cap",
    """WITH t AS (SELECT conv_id, turn, strlen(text) AS size FROM conversations),
    run AS (SELECT *, sum(size) OVER w AS total, count(*) FILTER (size > 0) OVER w AS n,
      sum(size) OVER (PARTITION BY conv_id) AS whole FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn
        ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, CASE WHEN size > 0 AND total <= 1500 THEN n - 1 END AS seq, size > 0 AND total <= 1500 AS kept,
      whole > 1500 AS truncated FROM run""",
)
def transcripts(spark, sf):
    out = win.transcript_cap(Tables(spark, sf).conversations, "conv_id", "turn", "text", max_bytes=1500, block_rows=3)
    return out.select("conv_id", "turn", "seq", "kept", "truncated")


def _anchored(width: str, after: str) -> str:
    """Window starts per user by walking from one to the next."""
    return f"""WITH RECURSIVE win AS (SELECT user_id, min(ts) AS s FROM events GROUP BY user_id
    UNION ALL SELECT w.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = w.user_id AND e.ts {after} w.s + {width})
    FROM win w WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.user_id AND e.ts {after} w.s + {width})),
placed AS (SELECT e.*, max(w.s) AS s FROM events e JOIN win w ON w.user_id = e.user_id AND w.s <= e.ts GROUP BY ALL)"""


@query(
    "W3_rate_flags",
    f"""{_anchored("INTERVAL 1 DAY", ">=")} SELECT event_id, user_id,
      row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) > 3 AS flagged FROM placed""",
)
def rate(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    return win.rate_flags(e, "user_id", "ts", 3, 86_400, ["event_id"]).select("event_id", "user_id", "flagged")


DEDUP_SQL = f"""{_anchored("INTERVAL 6 HOUR", ">")},
firsts AS (SELECT user_id, s, arg_min(event_type, (ts, event_id)) AS accepted, min(event_id) AS first_id FROM placed GROUP BY ALL)
SELECT event_id, user_id, CASE WHEN p.event_id = first_id THEN 'new' WHEN event_type = accepted THEN 'duplicate'
  ELSE 'conflict' END AS status FROM placed p JOIN firsts USING (user_id, s)"""


@query("X5_idempotent_dedup_batch", DEDUP_SQL)
def dedup(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "user_id", "ts", "event_type")
    out = win.idempotent_dedup(e, "user_id", ["event_type"], "ts", 6 * 3600, ["event_id"])
    return out.select("event_id", "user_id", "status")


@query(
    "F_request_hash",
    """SELECT event_id, sha256(event_type || chr(0) || user_id || chr(0) || coalesce(props, '')) AS request_hash FROM events""",
)
def hashes(spark, sf):
    from hushframe.functions.text import request_hash

    user = F.col("user_id").cast("string")
    return Tables(spark, sf).events.select("event_id", request_hash(F.col("event_type"), user, F.col("props")).alias("request_hash"))


@query(
    "W4_peak_concurrency",
    """WITH marks AS (SELECT event_type AS org, epoch_us(ts) AS us, 1 AS step FROM events
      UNION ALL SELECT event_type, epoch_us(ts) + round(value * 100)::BIGINT * 1000000, -1 FROM events),
    steps AS (SELECT org, us, sum(step) AS step FROM marks GROUP BY ALL),
    run AS (SELECT org, us, sum(step) OVER (PARTITION BY org ORDER BY us) AS open FROM steps)
    SELECT org, max(open)::BIGINT AS peak, arg_min(us, (-open, us)) AS peak_us, count(*) FILTER (open > 8) AS instants_over_cap,
      max(open) > 8 AS over_cap FROM run GROUP BY org""",
)
def peak(spark, sf):
    seconds = F.round(F.col("value") * 100).cast("bigint")
    e = Tables(spark, sf).events.select(
        F.col("event_type").alias("org"), F.col("ts").alias("opened"), (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("closed")
    )
    return win.peak_concurrency(e, "org", "opened", "closed", cap=8)


@query(
    "J5_session_join",
    f"""WITH {SESSIONS} SELECT s.session_id, s.actor, s.started_at, e.ended_at, e.status,
      round((epoch_us(e.ended_at) - epoch_us(s.started_at)) / 1000000.0, 3)::DOUBLE AS duration_seconds
    FROM starts s LEFT JOIN ends e ON e.session_id = s.session_id AND e.session_id <> ''""",
)
def joined(spark, sf):
    return session_join(*sessions(spark, sf)).select("session_id", "actor", "started_at", "ended_at", "status", "duration_seconds")


@query(
    "J4_column_lineage_lookup",
    """SELECT event_id, CASE WHEN c.s_suppkey IS NULL THEN '' ELSE 'org1:spark:db:' || c.s_name END AS object_id,
      coalesce('col' || c.s_nationkey, e.event_type) AS path
    FROM events e LEFT JOIN supplier c ON e.user_id = c.s_suppkey AND e.user_id % 25 = c.s_nationkey""",
)
def lineage(spark, sf):
    t = Tables(spark, sf)
    shown = t.events.select(
        "event_id", F.col("user_id").alias("table_id"), (F.col("user_id") % 25).cast("int").alias("column_no"), F.col("event_type").alias("name")
    )
    known = t.supplier.select(
        F.col("s_suppkey").alias("table_id"),
        F.col("s_nationkey").alias("column_no"),
        F.col("s_name").alias("table_name"),
        F.concat(F.lit("col"), F.col("s_nationkey").cast("string")).alias("real_name"),
    )
    return column_lineage_lookup(shown, known, "org1", "spark", "db").select("event_id", "object_id", "path")


NOW = dt.datetime(2024, 1, 20)
_WANTED = (
    ("views", "Sum", "views", "view"),
    ("clicks", "Average", "clicks (avg)", "click"),
    ("errors", "Maximum", "errors (max)", "error"),
    ("slow", "p99", "purchases p99", "purchase"),
    ("tasks", "Maximum", "tasks", "none"),
    ("tasks_avg", "Average", "tasks (avg)", "signup"),
)
_AGGS = {"Sum": "sum(value)", "Average": "avg(value)", "Maximum": "max(value)", "p99": "quantile_cont(value, 0.99)"}
_SERIES_SQL = " UNION ALL ".join(
    f"""SELECT '{i}' AS series_id, '{label}' AS label, t, round(v, 6) AS v FROM (SELECT 1) LEFT JOIN (
      SELECT (epoch_us(ts) // 300000000 * 300)::DOUBLE AS t, {_AGGS[stat]}::DOUBLE AS v FROM recent
      WHERE event_type = '{kind}' GROUP BY 1) ON true"""
    for i, stat, label, kind in _WANTED
)
SERIES_SQL = f"""recent AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-19 00:00:00' AND ts < TIMESTAMP '2024-01-19 23:58:00'),
series AS ({_SERIES_SQL})"""


def _series(spark, sf):
    specs = [ser.Series(i, stat, label, F.col("event_type") == kind) for i, stat, label, kind in _WANTED]
    out = ser.metric_series(Tables(spark, sf).events, "ts", "value", specs, NOW, minutes=5000)
    return out.withColumn("v", F.round("v", 6))


@query("A7_metric_series", f"WITH {SERIES_SQL} SELECT series_id, label, t, v FROM series")
def series(spark, sf):
    return _series(spark, sf)


@query(
    "A8_series_fallback",
    f"""WITH {SERIES_SQL} SELECT series_id, label, t, v FROM series WHERE series_id NOT IN ('tasks', 'tasks_avg')
    UNION ALL SELECT 'tasks', 'tasks', t, v FROM series WHERE series_id = 'tasks_avg'""",
)
def fallback(spark, sf):
    return ser.series_fallback(_series(spark, sf), "tasks", "tasks_avg")
