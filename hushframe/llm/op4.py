"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.llm.decontaminate import WINDOW, verbatim_matches
from hushframe.llm.registry import query, table

WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS m, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS s
       FROM b, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM d, sizes, unnest(generate_series(1, len(w) - m + 1)) AS g(i) WHERE len(w) >= m),
hits AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, i, m FROM hits), unnest(generate_series(i, i + m - 1)) AS g(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_decontaminate", SQL)
def op4_decontaminate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = verbatim_matches(docs, table(spark, folder, "benchmark")).select("doc_id", "matches")
    items = F.sort_array(F.array_distinct(F.col("matches.spans.item_id")))
    return found.select(
        "doc_id",
        F.col("matches.n_words").alias("n_words"),
        F.col("matches.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        (F.col("matches.n_hit") > 0).alias("contaminated"),
    )
