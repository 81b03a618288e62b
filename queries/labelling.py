"""The label table, samples and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import labels as lab
from hushframe.operators import sampling
from hushframe.plans import jobs
from queries.detection import EMAIL
from queries.base import Tables, query
from queries.derived import EVENT_PROPOSALS, PATH_LABELS, event_proposals, path_labels

_OUT = ["object_id", "field_path", "match_mode", "category", "profile", "source", "confidence", "sample_count",
        "last_observed_at", "updated_at", "updated_by"]
_COLS = ", ".join(_OUT)

_MERGED = """merged AS (SELECT object_id, field_path, coalesce(nullif(arg_max(match_mode, seq), ''), 'path') AS match_mode,
  arg_max(category, seq) AS category, arg_max(profile, seq) AS profile, 'proposed' AS source, max(confidence) AS confidence,
  sum(sample_count)::BIGINT AS sample_count, max(last_observed_at) AS last_observed_at, max(updated_at) AS updated_at,
  arg_max(updated_by, seq) AS updated_by FROM props WHERE source = 'proposed' GROUP BY object_id, field_path)"""


def _proposed(spark, sf):
    return event_proposals(spark, sf).filter(F.col("source") == "proposed")


@query("A4_merge_proposed", f"WITH {EVENT_PROPOSALS}, {_MERGED} SELECT {_COLS} FROM merged")
def merged(spark, sf):
    return lab.merge_proposed(_proposed(spark, sf)).select(*_OUT)


@query(
    "A5_upsert_labels",
    f"""WITH {EVENT_PROPOSALS},
    first_human AS (SELECT *, row_number() OVER (PARTITION BY object_id, field_path ORDER BY seq DESC) AS rn
      FROM props WHERE source <> 'proposed'),
    human AS (SELECT * FROM first_human WHERE rn = 1), {_MERGED}
    SELECT object_id, field_path, coalesce(nullif(match_mode, ''), 'path') AS match_mode, category, profile, source, confidence,
      sample_count, last_observed_at, updated_at, updated_by FROM human
    UNION ALL SELECT {_COLS} FROM merged m WHERE NOT EXISTS (SELECT 1 FROM human h
      WHERE h.object_id = m.object_id AND h.field_path = m.field_path)""",
)
def upserted(spark, sf):
    props = event_proposals(spark, sf)
    at = F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    empty = props.filter(F.lit(False)).drop("seq")
    # the log in two batches gives the same table as in one
    current = lab.upsert_labels(empty, props.filter(F.col("updated_at") < at))
    return lab.upsert_labels(current, props.filter(F.col("updated_at") >= at)).select(*_OUT)


@query(
    "O1_union_proposals",
    f"""WITH {EVENT_PROPOSALS}, {PATH_LABELS}, two AS (
      SELECT object_id, field_path, category, confidence, seq FROM props WHERE source = 'proposed'
      UNION ALL SELECT object_id, field_path, category, confidence, seq FROM path_labels WHERE source = 'proposed')
    SELECT object_id, field_path, arg_max(category, seq) AS category, max(confidence) AS confidence FROM two GROUP BY object_id, field_path""",
)
def unioned(spark, sf):
    other = path_labels(spark, sf).filter(F.col("source") == "proposed")
    both = lab.union_proposals(_proposed(spark, sf), other)
    return lab.merge_proposed(both).select("object_id", "field_path", "category", "confidence")


@query(
    "O2_suppress_dismissed",
    f"""WITH {EVENT_PROPOSALS} SELECT seq, object_id, field_path, category FROM props p WHERE source = 'proposed'
    AND NOT EXISTS (SELECT 1 FROM props d WHERE d.source = 'dismissed' AND d.object_id = p.object_id
      AND d.field_path = p.field_path AND d.category = p.category)""",
)
def suppressed(spark, sf):
    left = lab.suppress_dismissed(_proposed(spark, sf), event_proposals(spark, sf))
    return left.select("seq", "object_id", "field_path", "category")


@query(
    "W5_latest_label",
    f"""WITH {EVENT_PROPOSALS}, r AS (SELECT *, row_number() OVER (PARTITION BY object_id, field_path
      ORDER BY updated_at DESC, seq DESC) AS rn FROM props)
    SELECT object_id, field_path, category, source, confidence, seq FROM r WHERE rn = 1""",
)
def latest(spark, sf):
    return lab.latest_label(event_proposals(spark, sf)).select("object_id", "field_path", "category", "source", "confidence", "seq")


@query(
    "S9_proposal_batches",
    f"""WITH {EVENT_PROPOSALS}, {_MERGED}
    SELECT object_id, count(*) AS n_items, string_agg(field_path, ',' ORDER BY field_path) AS fields FROM merged GROUP BY object_id""",
)
def batches(spark, sf):
    out = lab.proposal_batches(lab.merge_proposed(_proposed(spark, sf)))
    whole = out.groupBy("object_id").agg(F.sort_array(F.flatten(F.collect_list("items.field_path"))).alias("paths"))
    return whole.select(
        "object_id",
        F.size("paths").cast("bigint").alias("n_items"),
        F.array_join("paths", ",").alias("fields"),
    )


@query(
    "T2_pending_cap",
    f"""WITH {EVENT_PROPOSALS}, {_MERGED} SELECT object_id, field_path, confidence FROM merged
    ORDER BY confidence DESC, object_id, field_path LIMIT 500""",
)
def pending(spark, sf):
    return lab.pending_cap(lab.merge_proposed(_proposed(spark, sf)), 500).select("object_id", "field_path", "confidence")


@query(
    "T3_field_cap",
    f"""WITH {EVENT_PROPOSALS} SELECT object_id, field_path, max(last_observed_at) AS last_seen FROM props
    GROUP BY object_id, field_path ORDER BY last_seen DESC, object_id, field_path LIMIT 300""",
)
def field_cap(spark, sf):
    seen = event_proposals(spark, sf).withColumnRenamed("last_observed_at", "last_seen")
    return lab.field_cap(seen, 300)


@query(
    "T4_review_queue",
    f"""WITH {PATH_LABELS} SELECT object_id, field_path, confidence FROM path_labels WHERE source = 'proposed'""",
)
def queue(spark, sf):
    return lab.review_queue(path_labels(spark, sf)).select("object_id", "field_path", "confidence")


@query(
    "T1_rescan_selection",
    """WITH history AS (SELECT 'user' || user_id AS object, max(ts) AS last_scanned FROM events
      WHERE event_type = 'purchase' AND value > 100 GROUP BY user_id),
    objects AS (SELECT DISTINCT 'user' || user_id AS object FROM events)
    SELECT object, last_scanned FROM objects LEFT JOIN history USING (object)
    WHERE last_scanned IS NULL OR last_scanned <= TIMESTAMP '2024-01-30' - INTERVAL 86400 SECOND
    ORDER BY last_scanned NULLS FIRST, object LIMIT 50""",
)
def rescan(spark, sf):
    e = Tables(spark, sf).events.withColumn("object", F.concat(F.lit("user"), F.col("user_id").cast("string")))
    scanned = e.filter((F.col("event_type") == "purchase") & (F.col("value") > 100))
    history = scanned.select("object", F.col("ts").alias("last_scanned"))
    return lab.rescan_selection(e.select("object"), history, F.expr("TIMESTAMP_NTZ'2024-01-30 00:00:00'"), max_objects=50)


_VALUES = """vals AS (SELECT 'text' AS field_path, text AS value, conv_id, turn FROM conversations
  UNION ALL SELECT 'role', role, conv_id, turn FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field_path ORDER BY conv_id, turn, value) AS rn FROM vals
  WHERE value IS NOT NULL AND value <> ''),
samples AS (SELECT 'org1:spark:lake:conversations' AS object_id, field_path, list(value ORDER BY rn) AS samples
  FROM ranked WHERE rn <= 20 GROUP BY field_path)"""


def _samples(spark, sf):
    df = Tables(spark, sf).conversations
    return sampling.sample_fields(df, "org1:spark:lake:conversations", 20, ["conv_id", "turn"], drop_blank=True)


@query(
    "W1_sample_fields",
    f"""WITH {_VALUES} SELECT object_id, field_path, len(samples) AS n, list_aggregate(samples, 'string_agg', '|') AS samples
    FROM samples""",
)
def sampled(spark, sf):
    return _samples(spark, sf).select(
        "object_id", "field_path", F.size("samples").cast("bigint").alias("n"), F.array_join("samples", "|").alias("samples")
    )


@query(
    "U4_custom_sampler",
    f"""WITH {_VALUES} SELECT object_id, 'role' AS field_path, 'role_fields' AS category, len(samples) AS sample_count FROM samples
    WHERE field_path = 'role'""",
)
def own_sampler(spark, sf):
    def longest(df, n):
        return sampling.sample_fields(df.select("conv_id", "turn", "role"), "x", n, ["conv_id", "turn"])

    def own(object_id, field_path, samples):
        return ("role_fields", "", 0.9) if field_path == "role" else None

    t = Tables(spark, sf)
    empty = path_labels(spark, sf).filter(F.lit(False)).drop("seq")
    history = t.events.filter(F.lit(False)).select(F.lit("x").alias("object"), F.col("ts").alias("last_scanned"))
    now = F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")
    out = jobs.propose_labels(
        {"conversations": t.conversations}, "org1", "spark", "lake", empty, history, now,
        classifier=own, sampler=longest, taxonomy=["role_fields"],
    )
    return out.select("object_id", "field_path", "category", "sample_count")


@query(
    "F7_classification_prompt",
    f"""WITH {_VALUES} SELECT field_path, 'You are classifying a database field for personally identifiable information (PII).'
      || chr(10) || 'Table/collection: ' || object_id || chr(10) || 'Field path: ' || field_path || chr(10) || 'Sample values:'
      || chr(10) || list_aggregate(list_transform(samples, lambda s: '- ' || s || chr(10)), 'string_agg', '')
      || 'Pick exactly one category from this list, or "none" if none apply: a_fields, b_fields' || chr(10)
      || 'Respond with a single JSON object: {{"category": "...", "profile": "...", "confidence": 0.0-1.0, "rationale": "..."}}'
      || chr(10) AS prompt FROM samples""",
)
def prompts(spark, sf):
    return sampling.classification_prompt(_samples(spark, sf), ["a_fields", "b_fields"]).select("field_path", "prompt")


# fields of the documents: one per source and language, sampled by document number
_DOC_VALUES = """dv AS (SELECT 'org1:spark:lake:' || source AS object_id, lang AS field_path, text AS value, doc_id FROM documents),
dr AS (SELECT *, row_number() OVER (PARTITION BY object_id, field_path ORDER BY doc_id, value) AS rn FROM dv WHERE value IS NOT NULL),
ds AS (SELECT object_id, field_path, list(value ORDER BY rn) AS samples FROM dr WHERE rn <= 20 GROUP BY object_id, field_path),
shares AS (SELECT object_id, field_path, samples, """ + ", ".join(
    f"len(list_filter(samples, lambda s: regexp_matches(s, '{pattern}'))) / len(samples) AS {c}"
    for c, pattern in {**sampling.VALUE_PATTERNS, "email_fields": EMAIL}.items()
) + """ FROM ds),
accepted AS (SELECT object_id, field_path, len(samples) AS sample_count,
  CASE WHEN email_fields >= greatest(ssn_fields, phone_fields) THEN 'email_fields' WHEN ssn_fields >= phone_fields THEN 'ssn_fields'
    ELSE 'phone_fields' END AS category,
  round(greatest(email_fields, ssn_fields, phone_fields) * 0.9::DOUBLE, 6) AS confidence FROM shares
  WHERE greatest(email_fields, ssn_fields, phone_fields) > 0)"""


def _doc_samples(spark, sf):
    values = Tables(spark, sf).documents.select(
        F.concat(F.lit("org1:spark:lake:"), F.col("source")).alias("object_id"),
        F.col("lang").alias("field_path"),
        F.col("text").alias("value"),
        "doc_id",
    )
    return sampling.first_values(values.filter(F.col("value").isNotNull()), ["doc_id"], 20)


@query(
    "F8_accept_classification",
    f"""WITH {_DOC_VALUES} SELECT object_id, field_path, category, confidence, sample_count FROM accepted
    WHERE category <> 'phone_fields' AND confidence >= 0.05 AND sample_count >= 2""",
)
def accepted(spark, sf):
    out = sampling.classify_fields(_doc_samples(spark, sf), None, ["email_fields", "ssn_fields"], 2, 0.05)
    return out.select("object_id", "field_path", "category", "confidence", "sample_count")


@query(
    "U3_custom_classifier",
    f"""WITH {_DOC_VALUES} SELECT object_id, field_path, 'long_fields' AS category, 0.75::DOUBLE AS confidence,
      len(samples) AS sample_count FROM ds WHERE length(samples[1]) > 500""",
)
def own_classifier(spark, sf):
    def long_first(object_id, field_path, samples):
        return ("long_fields", "", 0.75) if len(samples[0]) > 500 else None

    out = sampling.classify_fields(_doc_samples(spark, sf), long_first, ["long_fields"])
    return out.select("object_id", "field_path", "category", "confidence", "sample_count")


@query(
    "A9_classification_summary",
    f"""WITH {_DOC_VALUES} SELECT ds.object_id, count(*) AS fields_scanned, count(a.field_path) AS labels_proposed
    FROM ds LEFT JOIN accepted a USING (object_id, field_path) GROUP BY ds.object_id""",
)
def summary(spark, sf):
    fields = _doc_samples(spark, sf)
    return sampling.classification_summary(fields, sampling.classify_fields(fields, min_confidence=0.0))


@query(
    "U5_label_store",
    f"""WITH {PATH_LABELS} SELECT source, count(*) AS n_labels, count(DISTINCT object_id) AS n_objects FROM path_labels
    WHERE object_id IN ('org1:spark:lake:src1', 'org1:spark:lake:src2') GROUP BY source""",
)
def store(spark, sf):
    own = path_labels(spark, sf).filter(F.col("object_id").isin("org1:spark:lake:src1", "org1:spark:lake:src2"))
    return lab.latest_label(own).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_distinct("object_id").alias("n_objects")
    )


@query(
    "C3_propose_labels",
    f"""WITH emails AS (SELECT event_id, 'user' || user_id || '@example.com' AS contact, event_type AS kind FROM events),
    first_rows AS (SELECT * FROM emails ORDER BY event_id LIMIT 20)
    SELECT 'org1:spark:app:people' AS object_id, 'contact' AS field_path, 'email_fields' AS category, 'full_redact' AS profile,
      'proposed' AS source, 0.9::DOUBLE AS confidence, count(*) AS sample_count FROM first_rows""",
)
def proposals(spark, sf):
    t = Tables(spark, sf)
    contact = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
    people = t.events.select("event_id", contact.alias("contact"), F.col("event_type").alias("kind"))
    current = path_labels(spark, sf).filter(F.lit(False)).drop("seq")
    history = t.events.select(F.lit("scanned").alias("object"), F.col("ts").alias("last_scanned"))
    now = F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")
    out = jobs.propose_labels(
        {"people": people, "scanned": t.events}, "org1", "spark", "app", current, history, now,
        order_by={"people": ["event_id"]}, rescan_seconds=30 * 86_400,
    )
    return out.select("object_id", "field_path", "category", "profile", "source", "confidence", "sample_count")
