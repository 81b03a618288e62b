"""Content detection on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import checks
from hushframe.functions.text import connection_key
from hushframe.operators import detect, metrics
from hushframe.plans import jobs
from hushframe.plans.policy import Anonymizer, Detection, PathLabel, Policy, Recognizer
from hushframe.session import shared_folder
from hushframe.sources import rules, sinks
from queries.base import Tables, query

# --- the same rules in SQL -------------------------------------------------------------------------
# Crypto addresses need a base-58 checksum, which has no short SQL form; the tables hold no candidate.

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_PHONE_DIGITS = "regexp_replace(replace(m, '(0)', ''), '[^0-9]', '', 'g')"
_CODE = f"""CASE WHEN {_PHONE_DIGITS}[1] IN ('1', '7') THEN 1 WHEN {_PHONE_DIGITS}[1:2] IN ({", ".join(f"'{c}'" for c in checks.TWO_DIGIT_CODES)}) THEN 2 ELSE 3 END"""
_PLANS = "MAP {" + ", ".join(f"'{c}': [{a}, {b}]" for c, (a, b) in checks.NATIONAL_DIGITS.items()) + "}"
_CHECKS = {
    "PHONE_ABROAD": f"""length({_PHONE_DIGITS}) BETWEEN 8 AND 15 AND length({_PHONE_DIGITS}) - {_CODE} BETWEEN
        coalesce({_PLANS}[{_PHONE_DIGITS}[1:{_CODE}]][1], 4) AND coalesce({_PLANS}[{_PHONE_DIGITS}[1:{_CODE}]][2], 15 - {_CODE})""",
    "IPV6_SHORT": f"""regexp_matches(m, '{checks.IPV6_FORM}') AND len(list_filter(string_split(m, ':'), lambda g: g <> '')) + (CASE WHEN m LIKE '%.%' THEN 1 ELSE 0 END)
        BETWEEN 1 AND 7 AND (m NOT LIKE '%.%' OR list_max(list_transform(string_split(regexp_extract(m, '[0-9.]*$'), '.'), lambda c: TRY_CAST(c AS INT))) <= 255)""",
    "CREDIT_CARD": f"""list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i:
        CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0""",
    "US_SSN": "NOT regexp_matches(m, '^(?:000|666|9[0-9]{2})|-00-|-0000$')",
    "IPV4": "list_max(list_transform(string_split(m, '.'), lambda c: c::INT)) <= 255",
    "IBAN_CODE": """list_reduce(string_split(
        substr(regexp_replace(m, '[^A-Z0-9]', '', 'g'), 5) || left(m, 4), ''), lambda a, c:
        CASE WHEN ascii(c) < 65 THEN a * 10 + ascii(c) - 48 ELSE a * 100 + ascii(c) - 55 END % 97, 0) = 1""",
}
# The same addresses for a matcher that never goes back.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}"
IPV6_SHORT = r"[0-9A-Za-z.]*:(?:[0-9A-Za-z.]*:)+(?:[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*)?"
_RULES = [
    ("EMAIL_ADDRESS", EMAIL, 1.0, None),
    ("PHONE_NUMBER", detect.PHONE, 0.4, None),
    ("CREDIT_CARD", detect.CARD, 1.0, "CREDIT_CARD"),
    ("US_SSN", detect.SSN, 0.5, "US_SSN"),
    ("IP_ADDRESS", detect.IPV4, 0.6, "IPV4"),
    ("IP_ADDRESS", detect.IPV6, 0.6, None),
    ("IP_ADDRESS", IPV6_SHORT, 0.6, "IPV6_SHORT"),
    ("PHONE_NUMBER", detect.PHONE_ABROAD, 0.4, "PHONE_ABROAD"),
    ("IBAN_CODE", detect.IBAN, 1.0, "IBAN_CODE"),
]


def spans_sql(source: str, keys: str, text: str, rules=None, min_len: int = 4) -> str:
    """A WITH list that ends in `spans`: the keys, span_no, entity_type, start, end, score, text."""
    parts = []
    for entity, regex, score, check in rules or _RULES:
        pattern = regex.replace("'", "''")
        parts.append(
            f"""SELECT {keys}, '{entity}' AS entity_type, score, start, (start + length(m))::INTEGER AS "end", m AS text FROM (
      SELECT {keys}, {score}::DOUBLE AS score, ms[k] AS m,
        (list_sum(list_transform(gs[1:k], lambda x: length(x)))
          + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::INTEGER AS start
      FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs
        FROM {source} WHERE strlen({text}) >= {min_len}), generate_series(1, len(ms)) AS g(k))
      WHERE {_CHECKS.get(check, 'true')}"""
        )
    union = "\n UNION ".join(parts)
    return f"""found AS ({union}),
spans AS (SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY start, "end" DESC, score DESC, entity_type) - 1)::INTEGER
  AS span_no FROM found)"""


def masked_sql(source: str, keys: str, text: str, replace: str = "'[redacted]'", join: str | None = None) -> str:
    """A WITH list after `spans` that ends in `masked`: the keys and masked_text."""
    on = join or f"s.{keys} = t.{keys}"
    return f"""kept AS (SELECT {keys}, list_reduce(list({{'s': start, 'e': "end", 'r': {replace}}} ORDER BY span_no),
      lambda acc, x: CASE WHEN x.s >= acc.e THEN {{'e': x.e, 'k': list_append(acc.k, x)}} ELSE acc END,
      {{'e': 0, 'k': []::STRUCT(s INTEGER, e INTEGER, r VARCHAR)[]}}).k AS k FROM spans GROUP BY {keys}),
masked AS (SELECT t.* EXCLUDE ({text}), CASE WHEN k IS NULL THEN {text} ELSE
    list_aggregate(list_transform(k, lambda x, i: {text}[(CASE WHEN i = 1 THEN 0 ELSE k[i - 1].e END) + 1 : x.s] || x.r),
      'string_agg', '') || {text}[k[-1].e + 1 :] END AS masked_text
  FROM {source} t LEFT JOIN kept s ON {on})"""


DOC_SPANS = spans_sql("documents", "doc_id", "text")
SPAN_COLUMNS = 'doc_id, span_no, entity_type, start, "end", score, text'


@query("D1_detect_spans", f"WITH {DOC_SPANS} SELECT {SPAN_COLUMNS} FROM spans")
def spans(spark, sf):
    return detect.detect_spans(Tables(spark, sf).documents, "doc_id", "text")


@query(
    "D1_detect_in_pages",
    f"""WITH {spans_sql('pages', 'page_id', 'html')} SELECT page_id, span_no, entity_type, start, "end", score, text FROM spans""",
)
def page_spans(spark, sf):
    return detect.detect_spans(Tables(spark, sf).pages, "page_id", "html")


# One of these stands in each document of the two queries below; half of them are no numbers or addresses.
_WRITTEN = (
    "+49 30 901820", "+44 (0)20 7946 0958", "+33 1 42 68 53 00", "+1 5551234567", "+999 12", "+48 12 345", "+351 912 345 678", "+971501234567",
    "2001:db8::1", "::1", "fe80::1ff:fe23:4567:890a", "::ffff:192.0.2.128", "1::2::3", "12:30:45", "::", "::ffff:192.0.2.999", "std::vector", "a:b:c:d:e:f:0::1",
)
_WRITTEN_SQL = f"""src AS (SELECT doc_id, lang || ' (' || [{", ".join(f"'{w}'" for w in _WRITTEN)}][1 + doc_id % {len(_WRITTEN)}] || '), ' || source AS text FROM documents)"""


def _written(spark, sf):
    literal = F.get(F.array(*map(F.lit, _WRITTEN)), (F.col("doc_id") % len(_WRITTEN)).cast("int"))
    return Tables(spark, sf).documents.select("doc_id", F.concat("lang", F.lit(" ("), literal, F.lit("), "), "source").alias("text"))


@query("D1_abroad_and_short_ipv6", f"WITH {_WRITTEN_SQL}, {spans_sql('src', 'doc_id', 'text')} SELECT {SPAN_COLUMNS} FROM spans")
def abroad(spark, sf):
    """International numbers by their numbering plan, shortened addresses by their grammar."""
    return detect.detect_spans(_written(spark, sf), "doc_id", "text")


@query("D5_abroad_and_short_ipv6", f"WITH {_WRITTEN_SQL}, {spans_sql('src', 'doc_id', 'text')}, {masked_sql('src', 'doc_id', 'text')} SELECT doc_id, masked_text FROM masked")
def abroad_masked(spark, sf):
    return _written(spark, sf).select("doc_id", detect.mask_text(F.col("text")).alias("masked_text"))


OWN = Recognizer("MAIL_HOST", r"mail[0-9]\.example\.(?:com|org)", 0.7)


@query(
    "D2_custom_recognizers",
    f"""WITH {spans_sql('documents', 'doc_id', 'text', [*_RULES, ('MAIL_HOST', OWN.regex, 0.7, None)])}
    SELECT {SPAN_COLUMNS} FROM spans""",
)
def own_spans(spark, sf):
    return detect.detect_spans(Tables(spark, sf).documents, "doc_id", "text", Detection(recognizers=[OWN]))


_CONTEXT_RULES = """{"recognizers": [
  {"supported_entity": "LONG_WORD", "supported_language": "en", "patterns": [{"name": "long", "regex": "[a-z]{11,}", "score": 0.3}], "context": ["The", "de", "der"]},
  {"supported_entity": "PLAIN_WORD", "patterns": [{"name": "plain", "regex": "[A-Z][a-z]{8,}", "score": 0.6}]},
  {"supported_entity": "WORD_OF_OTHERS", "supported_language": "fr", "patterns": [{"name": "other", "regex": "[a-z]+", "score": 1.0}]}]}"""
_CONTEXT_SPANS = spans_sql("documents", "doc_id", "text", [("LONG_WORD", "[a-z]{11,}", 0.3, None), ("PLAIN_WORD", "[A-Z][a-z]{8,}", 0.6, None)])


@query(
    "D2_context_words",
    f"""WITH {_CONTEXT_SPANS}, raised AS (SELECT s.*, list_has_any(regexp_extract_all(lower(d.text[:s.start]), '[\\p{{L}}\\p{{N}}]+')[-5:], ['the', 'de', 'der']) AS near
      FROM spans s JOIN documents d USING (doc_id)),
    scored AS (SELECT doc_id, entity_type, start, "end", text, CASE WHEN entity_type = 'LONG_WORD' AND near THEN least(1, greatest(score + 0.35::DOUBLE, 0.4::DOUBLE))
      ELSE score END AS score FROM raised)
    SELECT * FROM scored WHERE score >= 0.5""",
)
def context_spans(spark, sf):
    """Recognizers of a rule file: words near a match lift it over the threshold, other languages' rules are off."""
    d = Detection(
        entities=["LONG_WORD", "PLAIN_WORD", "WORD_OF_OTHERS"], recognizers=rules.recognizers_from_text(_CONTEXT_RULES), threshold=0.5, language="en"
    )
    return detect.detect_spans(Tables(spark, sf).documents, "doc_id", "text", d).drop("span_no")


# One rule per word of the benchmark's items, as a person might list product names: the word and what it begins.
_RULE_TABLE = r"""rules AS (SELECT DISTINCT 'TERM' || (length(w) % 3) AS entity, CASE length(w) % 2 WHEN 0 THEN w ELSE w || '[a-z]*' END AS regex
  FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{9,}')) AS w FROM benchmark))"""


def _rule_table(spark, sf):
    words = Tables(spark, sf).benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0))).alias("w")).distinct()
    regex = F.when(F.length("w") % 2 == 0, F.col("w")).otherwise(F.concat("w", F.lit("[a-z]*")))
    return words.select(F.concat(F.lit("TERM"), (F.length("w") % 3).cast("string")).alias("entity"), regex.alias("regex"), F.lit(0.5).alias("score"))


@query(
    "D2_rules_as_data",
    f"""WITH {_RULE_TABLE}, {DOC_SPANS}, found_terms AS (SELECT doc_id, entity, unnest(regexp_extract_all(text, regex)) AS t FROM documents, rules
      WHERE contains(text, replace(regex, '[a-z]*', '')))
    SELECT doc_id, entity AS entity_type, t AS text, count(*) AS n FROM found_terms GROUP BY ALL
    UNION ALL SELECT doc_id, entity_type, text, count(*) FROM spans GROUP BY ALL""",
)
def rules_as_data(spark, sf):
    """A table of recognizers beside the patterns of the plan. Two rules may find the same place: it counts once."""
    found = detect.detect_spans(Tables(spark, sf).documents, "doc_id", "text", recognizers=_rule_table(spark, sf))
    return found.groupBy("doc_id", "entity_type", "text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D4_patterns_as_data",
    f"""WITH {DOC_SPANS}, allowed AS (SELECT DISTINCT '^' || split_part(text, '@', 1) || '@' AS p FROM spans WHERE entity_type = 'EMAIL_ADDRESS' AND doc_id % 2 = 0)
    SELECT doc_id, entity_type, start, text FROM spans WHERE NOT EXISTS (SELECT 1 FROM allowed WHERE starts_with(spans.text, p[2:]))""",
)
def patterns_as_data(spark, sf):
    """Finds that a table of patterns allows: here all addresses of mailboxes named in even documents."""
    docs = Tables(spark, sf).documents
    mails = detect.detect_spans(docs, "doc_id", "text").filter("entity_type = 'EMAIL_ADDRESS' AND doc_id % 2 = 0")
    box = F.regexp_replace(F.substring_index("text", "@", 1), r"([.+])", r"\\$1")
    patterns = mails.select(F.concat(F.lit("^"), box, F.lit("@")).alias("text")).distinct()
    return detect.detect_spans(docs, "doc_id", "text", allow_patterns=patterns).select("doc_id", "entity_type", "start", "text")


@query(
    "D3_span_filters",
    f"""WITH {spans_sql('documents', 'doc_id', 'text', [r for r in _RULES if r[0] in ('EMAIL_ADDRESS', 'IP_ADDRESS')])}
    SELECT {SPAN_COLUMNS} FROM spans""",
)
def filtered_spans(spark, sf):
    d = Detection(entities=["EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER"], threshold=0.5)
    return detect.detect_spans(Tables(spark, sf).documents, "doc_id", "text", d)


@query(
    "D4_allow_list",
    f"""WITH {DOC_SPANS} SELECT doc_id, entity_type, start, text FROM spans
    WHERE NOT regexp_matches(text, 'mail[1-4]\\.example') AND NOT regexp_matches(text, '^\\+1')""",
)
def allowed(spark, sf):
    d = Detection(allow_list=[r"mail[1-4]\.example", r"^\+1"], allow_match="regex")
    return detect.detect_spans(Tables(spark, sf).documents, "doc_id", "text", d).select("doc_id", "entity_type", "start", "text")


@query(
    "J3_allow_list_anti_join",
    f"""WITH {DOC_SPANS}, known AS (SELECT text, count(DISTINCT doc_id) AS n FROM spans GROUP BY text)
    SELECT {SPAN_COLUMNS} FROM spans WHERE text NOT IN (SELECT text FROM known WHERE n > 1)""",
)
def allowed_by_table(spark, sf):
    docs = Tables(spark, sf).documents
    found = detect.detect_spans(docs, "doc_id", "text")
    # values that several documents share count as known and harmless
    known = found.groupBy("text").agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") > 1)
    return detect.detect_spans(docs, "doc_id", "text", allow_list=known)


@query(
    "D5_anonymize",
    f"WITH {DOC_SPANS}, {masked_sql('documents', 'doc_id', 'text')} SELECT doc_id, masked_text FROM masked",
)
def anonymized(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", detect.mask_text(F.col("text")).alias("masked_text"))


STRATEGIES = {
    "EMAIL_ADDRESS": Anonymizer("hash"),
    "PHONE_NUMBER": Anonymizer("mask", masking_char="#", chars_to_mask=8, from_end=True),
    "CREDIT_CARD": Anonymizer("mask", chars_to_mask=12),
    "IP_ADDRESS": Anonymizer("redact"),
}
_REPLACE = """CASE entity_type WHEN 'EMAIL_ADDRESS' THEN sha256(text)
  WHEN 'PHONE_NUMBER' THEN left(text, length(text) - 8) || repeat('#', 8)
  WHEN 'CREDIT_CARD' THEN repeat('*', 12) || substr(text, 13) WHEN 'IP_ADDRESS' THEN '' ELSE '[redacted]' END"""


@query(
    "D5_anonymize_strategies",
    f"WITH {DOC_SPANS}, {masked_sql('documents', 'doc_id', 'text', _REPLACE)} SELECT doc_id, masked_text FROM masked",
)
def anonymized_by_entity(spark, sf):
    masked = detect.mask_text(F.col("text"), Detection(anonymizers=STRATEGIES))
    return Tables(spark, sf).documents.select("doc_id", masked.alias("masked_text"))


@query(
    "D5_anonymize_span_table",
    f"WITH {DOC_SPANS}, {masked_sql('documents', 'doc_id', 'text')} SELECT doc_id, masked_text AS text FROM masked",
)
def anonymized_by_table(spark, sf):
    docs = Tables(spark, sf).documents.select("doc_id", "text")
    return detect.anonymize(docs, "doc_id", "text", detect.detect_spans(docs, "doc_id", "text"))


@query(
    "D6_best_detection",
    f"""WITH {DOC_SPANS} SELECT doc_id, arg_max(entity_type, score * 1000000 - span_no) AS category, max(score) AS confidence
    FROM spans GROUP BY doc_id""",
)
def best(spark, sf):
    return detect.best_detection(detect.detect_spans(Tables(spark, sf).documents, "doc_id", "text"), "doc_id")


def _words(texts):
    """A detector of one's own: the first mail address of a text, found by splitting on blanks."""
    out = []
    for t in texts:
        at = t.find("@mail")
        if at < 0:
            out.append([])
            continue
        start = max(t.rfind(c, 0, at) for c in " \n\t") + 1
        ends = [i for i in (t.find(c, at) for c in " \n\t") if i >= 0]
        out.append([{"entity_type": "EMAIL_ADDRESS", "start": start, "end": min(ends, default=len(t)), "score": 0.9}])
    return out


_FIRST_MAIL = r"regexp_replace({0}, '[^ \n\t]*@mail[^ \n\t]*', '[redacted]')"


@query(
    "U2_custom_detector",
    f"SELECT doc_id, {_FIRST_MAIL.format('text')} AS text, lang FROM documents",
)
@query(
    "D8_batching",
    f"SELECT doc_id, {_FIRST_MAIL.format('text')} AS text, lang FROM documents",
)
def plugged_in(spark, sf):
    df = Tables(spark, sf).documents.select("doc_id", "text", "lang")
    return jobs.mask_table(df, Policy(detection=Detection(detector=_words)))


def _down(texts):
    raise ConnectionError("analyzer is down")


@query("D7_failure_mode", "SELECT conv_id, turn, role, text FROM conversations")
def best_effort(spark, sf):
    df = Tables(spark, sf).conversations.select("conv_id", "turn", "role", "text")
    return jobs.mask_table(df, Policy(detection=Detection(detector=_down)))


# --- counts ----------------------------------------------------------------------------------------

LAKE = Policy(
    object_id="org1:spark:lake:documents",
    detection=Detection(),
    labels=[PathLabel("lang", "partial_mask", "lang_fields"), PathLabel("n_chars", "", " "), PathLabel("source", "do_not_mask")],
)
METRICS_SQL = f"""{DOC_SPANS},
metrics AS (
  SELECT 'spark__' || source AS connection_key, 'UNSPECIFIED' AS entity_type, 'recognizer' AS detection_source,
    (count(*) FILTER (strlen(text) >= 4) + count(*) FILTER (strlen(lang) >= 4) + count(*) FILTER (strlen(source) >= 4))::BIGINT
      AS count_analyzed, 0::BIGINT AS count_masked, 0::BIGINT AS bytes_masked FROM documents GROUP BY source
  UNION ALL SELECT 'spark__' || d.source, s.entity_type, 'recognizer', 0, count(*), sum(s."end" - s.start)::BIGINT
    FROM spans s JOIN documents d USING (doc_id) GROUP BY d.source, s.entity_type
  UNION ALL SELECT 'spark__' || source, 'UNSPECIFIED', 'field_rule', 5 * count(*), count(*),
    sum(length(n_chars::VARCHAR))::BIGINT FROM documents GROUP BY source
  UNION ALL SELECT 'spark__' || source, 'lang_fields', 'field_rule', 0, count(*), sum(strlen(lang))::BIGINT
    FROM documents GROUP BY source),
sums AS (SELECT connection_key, entity_type, detection_source, sum(count_analyzed)::BIGINT AS count_analyzed,
  sum(count_masked)::BIGINT AS count_masked, sum(bytes_masked)::BIGINT AS bytes_masked FROM metrics GROUP BY ALL)"""


def lake_outcomes(spark, sf):
    docs = Tables(spark, sf).documents
    return metrics.outcome_rows(docs, LAKE, connection_key(F.lit(" Spark"), F.col("source")))


@query("A1_masking_metrics", f"WITH {METRICS_SQL} SELECT * FROM sums")
def counted(spark, sf):
    return metrics.masking_metrics(lake_outcomes(spark, sf))


OVERFLOW_SQL = f"""{METRICS_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY count_analyzed + count_masked DESC, connection_key, entity_type,
  detection_source) AS rn FROM sums),
folded AS (SELECT connection_key, CASE WHEN rn > 30 THEN 'OTHER' ELSE entity_type END AS entity_type, detection_source,
  sum(count_analyzed)::BIGINT AS count_analyzed, sum(count_masked)::BIGINT AS count_masked,
  sum(bytes_masked)::BIGINT AS bytes_masked FROM ranked GROUP BY ALL)"""


@query("A2_metrics_overflow", f"WITH {OVERFLOW_SQL} SELECT * FROM folded")
@query("C5_masking_report", f"WITH {OVERFLOW_SQL} SELECT * FROM folded")
def folded(spark, sf):
    docs = Tables(spark, sf).documents
    return jobs.masking_report(docs, LAKE, connection_key(F.lit(" Spark"), F.col("source")), max_buckets=30)


@query(
    "A3_metrics_merge",
    f"""WITH {METRICS_SQL} SELECT connection_key, entity_type, detection_source, 2 * count_analyzed AS count_analyzed,
      2 * count_masked AS count_masked, 2 * bytes_masked AS bytes_masked FROM sums""",
)
def merged(spark, sf):
    once = metrics.masking_metrics(lake_outcomes(spark, sf))
    return metrics.merge_metrics(once, once)


@query("S7_metrics_sink", f"WITH {METRICS_SQL} SELECT DATE '2024-01-31' AS day, * FROM sums")
def stored_metrics(spark, sf):
    path = shared_folder(spark, "metrics")
    sinks.write_metrics(metrics.masking_metrics(lake_outcomes(spark, sf)), path, day="2024-01-31")
    return spark.read.parquet(path)


@query(
    "A6_connection_key",
    """SELECT 'spark__' || source AS connection_key, 'spark' AS driver, count(*) AS n FROM documents GROUP BY source""",
)
def keys(spark, sf):
    from hushframe.functions.text import connection_driver

    key = connection_key(F.lit(" SPARK "), F.concat(F.lit(" "), F.col("source")))
    keyed = Tables(spark, sf).documents.select(key.alias("connection_key"))
    counted_ = keyed.groupBy("connection_key").agg(F.count(F.lit(1)).alias("n"))
    return counted_.withColumn("driver", connection_driver(F.col("connection_key")))


@query(
    "C1_mask_table_content",
    f"""WITH {spans_sql('conversations', 'conv_id, turn', 'text')},
    {masked_sql('conversations', 'conv_id, turn', 'text', join='s.conv_id = t.conv_id AND s.turn = t.turn')}
    SELECT conv_id, turn, '[role]' AS role, masked_text AS text FROM masked""",
)
def mask_conversations(spark, sf):
    df = Tables(spark, sf).conversations.select("conv_id", "turn", "role", "text")
    return jobs.mask_table(df, Policy(detection=Detection(), overlay={"role": "[role]"}))


@query(
    "C4_propose_from_values",
    f"""WITH {DOC_SPANS}, best AS (SELECT doc_id, arg_max(entity_type, score * 1000000 - span_no) AS category,
        max(score) AS confidence FROM spans GROUP BY doc_id)
    SELECT 'org1:spark:lake:documents' AS object_id, 'text' AS field_path, arg_max(category, doc_id) AS category,
      max(confidence) AS confidence, count(*) AS sample_count, 'proposed' AS source FROM best HAVING count(*) > 0""",
)
def proposed(spark, sf):
    df = Tables(spark, sf).documents
    now = F.timestamp_seconds(F.lit(0))
    found = jobs.propose_from_values(df, "org1:spark:lake:documents", now, order_by=["doc_id"])
    return found.select("object_id", "field_path", "category", "confidence", "sample_count", "source")


@query(
    "A1_own_detector",
    f"""WITH m AS (SELECT source, regexp_extract_all(text, '[^ \n\t]*@mail[^ \n\t]*')[1] AS w FROM documents WHERE strlen(text) >= 4),
    l AS (SELECT source FROM documents WHERE strlen(lang) >= 4 UNION ALL SELECT source FROM documents WHERE strlen(source) >= 4 UNION ALL SELECT source FROM m)
    SELECT 'spark__' || source AS connection_key, 'UNSPECIFIED' AS entity_type, 'recognizer' AS detection_source, count(*) AS count_analyzed,
      0::BIGINT AS count_masked, 0::BIGINT AS bytes_masked FROM l GROUP BY source
    UNION ALL SELECT 'spark__' || source, 'EMAIL_ADDRESS', 'recognizer', 0, count(*), sum(length(w))::BIGINT FROM m WHERE w IS NOT NULL GROUP BY source""",
)
def own_detector_counts(spark, sf):
    """What a plugged-in detector found is counted like what the patterns find."""
    df = Tables(spark, sf).documents.select("source", "text", "lang")
    policy = Policy(detection=Detection(detector=_words))
    return metrics.masking_metrics(metrics.outcome_rows(df, policy, connection_key(F.lit("spark"), F.col("source"))))


@query(
    "A1_role_rules",
    """WITH t AS (SELECT role, CASE role WHEN 'user' THEN '[user text]' WHEN 'assistant' THEN text ELSE '[default]' END AS text FROM conversations)
    SELECT 'spark__' || role AS connection_key, 'UNSPECIFIED' AS entity_type, 'field_rule' AS detection_source, count(text)::BIGINT + 3 * count(*) AS count_analyzed,
      0::BIGINT AS count_masked, 0::BIGINT AS bytes_masked FROM t GROUP BY role
    UNION ALL SELECT 'spark__' || role, 'text_fields', 'field_rule', 0, count(text), sum(strlen(text))::BIGINT FROM t GROUP BY role""",
)
def role_counts(spark, sf):
    """Labels are measured on what the rules of the row's role left."""
    df = Tables(spark, sf).conversations.select("conv_id", "turn", "role", "text")
    policy = Policy(
        object_id="org1:spark:lake:conversations",
        overlay={"text": "[default]"},
        role_col="role",
        role_rules={"user": {"TEXT": "[user text]"}, "assistant": {"other": "x"}},
        labels=[PathLabel("text", "partial_mask", "text_fields")],
    )
    return metrics.masking_metrics(metrics.outcome_rows(df, policy, connection_key(F.lit("spark"), F.col("role"))))
