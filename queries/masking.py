"""Flat columns: sources, rules, overlays, labels, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import text
from hushframe.operators import columns as cols
from hushframe.operators import labels as labelling
from hushframe.plans import jobs
from hushframe.plans.policy import OverlayRule, PathLabel, Policy, classify_columns
from hushframe.sources import rules, sinks, tables
from hushframe.operators.documents import doc_walk
from hushframe.session import shared_folder
from queries.base import Tables, partial_sql, query
from queries.derived import ORDER_LEAVES, PATH_LABELS, order_documents, path_labels

CUSTOMER_ID = "org1:spark:tpch:customer"
FLAGSHIP = Policy(
    object_id=CUSTOMER_ID,
    overlay={"C_Name ": "[redacted]"},
    labels=[PathLabel("c_acctbal"), PathLabel("c_mktsegment", "partial_mask")],
)
FLAGSHIP_SQL = f"""SELECT c_custkey, CASE WHEN c_name IS NULL THEN NULL ELSE '[redacted]' END AS c_name, c_nationkey,
  CASE WHEN c_acctbal IS NULL THEN NULL ELSE 0.0::DOUBLE END AS c_acctbal,
  {partial_sql('c_mktsegment')} AS c_mktsegment FROM customer"""


@query("C1_mask_table", FLAGSHIP_SQL)
def mask_customer(spark, sf):
    return jobs.mask_table(Tables(spark, sf).customer, FLAGSHIP)


@query(
    "S1_capped_read",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000",
)
def capped(spark, sf):
    df = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return tables.capped_read(df, 1000, [F.col("o_totalprice").desc(), "o_orderkey"])


@query(
    "T5_row_cap",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 250",
)
def row_cap(spark, sf):
    """A cap over a filtered read."""
    df = Tables(spark, sf).events.filter("event_type = 'view'").select("event_id", "user_id", "value")
    return tables.capped_read(df, 250, [F.col("value").desc(), "event_id"])


@query(
    "S2_document_read",
    "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 100 ORDER BY doc_id LIMIT 500",
)
def documents_capped(spark, sf):
    df = Tables(spark, sf).documents.select("doc_id", "lang", "n_chars")
    wanted = (F.col("lang") == "en") & (F.col("n_chars") > 100)
    return tables.document_read(df, wanted, limit=500, max_rows=1000, order_by=["doc_id"])


@query(
    "S3_catalog_inventory",
    """SELECT lower(p_brand) AS schema_name, p_name || ' ' || p_partkey AS object_name,
      CASE p_type WHEN 'ECONOMY' THEN 'r' WHEN 'SMALL' THEN 'v' WHEN 'LARGE' THEN 'm' WHEN 'MEDIUM' THEN 'f'
        WHEN 'PROMO' THEN 'S' ELSE 'collection' END AS kind
      FROM part WHERE p_brand <> 'Brand#1' AND p_brand <> 'Brand#2'""",
)
def catalog(spark, sf):
    kind = (
        F.when(F.col("p_type") == "ECONOMY", "BASE TABLE")
        .when(F.col("p_type") == "SMALL", "VIEW")
        .when(F.col("p_type") == "LARGE", "MATERIALIZED VIEW")
        .when(F.col("p_type") == "MEDIUM", "FOREIGN TABLE")
        .when(F.col("p_type") == "PROMO", "SEQUENCE")
        .otherwise("COLLECTION")
    )
    schema = (
        F.when(F.col("p_brand") == "Brand#1", "pg_catalog")
        .when(F.col("p_brand") == "Brand#2", "pg_toast_9")
        .otherwise(F.lower("p_brand"))
    )
    info = Tables(spark, sf).part.select(
        schema.alias("table_schema"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("table_name"),
        kind.alias("table_type"),
    )
    return tables.catalog_inventory(info)


@query(
    "S4_field_inventory",
    f"""WITH {ORDER_LEAVES}
    SELECT 'org1:spark:tpch:order_docs' AS object_id, f AS field_path FROM (SELECT 'doc_id' AS f
      UNION SELECT DISTINCT 'doc.' || path FROM leaves WHERE NOT is_key)""",
)
def fields(spark, sf):
    return tables.field_inventory(order_documents(spark, sf), "org1:spark:tpch:order_docs")


OVERLAY_TEXT = '{"S_NAME": {"partial_mask": true}, "s_phone": 7, "s_nationkey": "x", " ": "y"}'


@query(
    "S5_load_rules",
    f"SELECT s_suppkey, {partial_sql('s_name')} AS s_name, s_nationkey, s_acctbal FROM supplier",
)
def rule_text(spark, sf):
    return cols.overlay_mask(Tables(spark, sf).supplier, rules.overlay_from_text(OVERLAY_TEXT))


@query(
    "S6_confirmed_labels",
    f"""WITH {PATH_LABELS} SELECT object_id, field_path, coalesce(nullif(match_mode, ''), 'path') AS match_mode, category,
      profile, source FROM path_labels WHERE source IN ('manual', 'platform')""",
)
def confirmed(spark, sf):
    out = labelling.confirmed_labels(path_labels(spark, sf))
    return out.select("object_id", "field_path", "match_mode", "category", "profile", "source")


@query(
    "S8_stringify_rows",
    """SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
      o_totalprice::VARCHAR AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate, o_orderpriority FROM orders""",
)
def stringified(spark, sf):
    return sinks.stringify_rows(Tables(spark, sf).orders)


@query(
    "S8_masked_sink",
    f"SELECT c_custkey, {partial_sql('c_name')} AS c_name FROM customer",
)
def stored(spark, sf):
    masked = cols.overlay_mask(Tables(spark, sf).customer.select("c_custkey", "c_name"), {"c_name": OverlayRule(partial=True)})
    path = shared_folder(spark, "masked")
    sinks.write_rows(masked, path)
    return spark.read.parquet(path)


@query(
    "P1_classify_columns",
    """SELECT 'o_orderkey' AS column_name, false AS free_text, 'numeric' AS kind, count(o_orderkey) AS n_values FROM orders
    UNION ALL SELECT 'o_custkey', false, 'numeric', count(o_custkey) FROM orders
    UNION ALL SELECT 'o_orderstatus', true, 'none', count(o_orderstatus) FROM orders
    UNION ALL SELECT 'o_totalprice', false, 'numeric', count(o_totalprice) FROM orders
    UNION ALL SELECT 'o_orderdate', false, 'date', count(o_orderdate) FROM orders
    UNION ALL SELECT 'o_orderpriority', true, 'none', count(o_orderpriority) FROM orders""",
)
def classified(spark, sf):
    df = Tables(spark, sf).orders
    plan = classify_columns(df.schema)
    counted = df.agg(*[F.count(c.name).alias(c.name) for c in plan])
    rows = [
        F.struct(
            F.lit(c.name).alias("column_name"),
            F.lit(c.free_text).alias("free_text"),
            F.lit(c.kind or "none").alias("kind"),
            F.col(c.name).alias("n_values"),
        )
        for c in plan
    ]
    return counted.select(F.inline(F.array(*rows)))


@query(
    "P2_eligible",
    "SELECT doc_id, (text IS NOT NULL AND strlen(text) >= 200) AS is_eligible FROM documents",
)
def eligible(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", text.eligible(F.col("text"), 200).alias("is_eligible"))


@query(
    "P3_overlay_mask",
    "SELECT c_custkey, '[name]' AS c_name, c_nationkey, c_acctbal, '[segment]' AS c_mktsegment FROM customer",
)
def overlay(spark, sf):
    names = {" C_NAME": "[name]", "c_MktSegment": "[segment]", "c_acctbal": "[no text]", "": "x"}
    return cols.overlay_mask(Tables(spark, sf).customer, names)


@query(
    "P4_partial_mask",
    f"SELECT conv_id, turn, {partial_sql('text')} AS text, {partial_sql('role')} AS role FROM conversations",
)
def partial(spark, sf):
    df = Tables(spark, sf).conversations
    rules_ = {"text": OverlayRule(partial=True), "role": OverlayRule(partial=True)}
    return cols.overlay_mask(df, rules_).select("conv_id", "turn", "text", "role")


@query(
    "P5_role_overlay",
    """SELECT conv_id, turn, role, CASE role WHEN 'user' THEN '[user text]' WHEN 'assistant' THEN text
      ELSE '[default]' END AS text FROM conversations""",
)
def by_role(spark, sf):
    df = Tables(spark, sf).conversations.select("conv_id", "turn", "role", "text")
    by = {"user": {"TEXT": "[user text]"}, "assistant": {"other": "x"}}
    return cols.role_overlay(df, "role", {"text": "[default]"}, by)


@query(
    "P6_path_label_mask",
    f"""SELECT p_partkey, '[redacted]' AS p_name, {partial_sql('p_brand')} AS p_brand, p_type, p_size,
      0.0::DOUBLE AS p_retailprice FROM part""",
)
def labelled(spark, sf):
    found = [
        PathLabel("p_name"),
        PathLabel("p_brand", "partial_mask", source="platform"),
        PathLabel("p_type", source="proposed"),
        PathLabel("P_SIZE"),
        PathLabel("p_retailprice", "partial_mask"),
    ]
    return cols.path_label_mask(Tables(spark, sf).part, "org1:spark:tpch:part", found)


@query(
    "P6_labels_from_table",
    f"""WITH {PATH_LABELS}, own AS (SELECT field_path, arg_max(profile, (source = 'manual', updated_at, profile)) AS profile
        FROM path_labels WHERE object_id = 'org1:spark:lake:src1' AND source IN ('manual', 'platform') GROUP BY field_path),
      d AS (SELECT d.doc_id, d.lang, own.profile FROM documents d LEFT JOIN own ON own.field_path = 'f' || (d.doc_id % 40))
    SELECT doc_id, CASE WHEN profile IS NULL OR profile = 'do_not_mask' THEN lang WHEN profile = 'partial_mask'
      THEN {partial_sql('lang')} ELSE '[redacted]' END AS value FROM d""",
)
def labels_from_table(spark, sf):
    """Values of many fields, each masked by the label that the table has for it."""
    t = Tables(spark, sf)
    path = F.concat(F.lit("f"), (F.col("doc_id") % 40).cast("string"))
    rows = t.documents.select("doc_id", F.lit("org1:spark:lake:src1").alias("object_id"), path.alias("path"), path.alias("key"), F.col("lang").alias("value"))
    return labelling.mask_by_lookup(rows, path_labels(spark, sf), strict_match_mode=True).select("doc_id", "value")


@query(
    "P7_profile_action",
    f"""SELECT doc_id, source AS a_full, source AS b_keep, {partial_sql('source')} AS c_partial,
      '[redacted]' AS d_unknown FROM documents""",
)
def profiles(spark, sf):
    df = Tables(spark, sf).documents.select(
        "doc_id", *[F.col("source").alias(n) for n in ("a_full", "b_keep", "c_partial", "d_unknown")]
    )
    found = [
        PathLabel("a_full", "do_not_mask"),
        PathLabel("b_keep", "do_not_mask"),
        PathLabel("c_partial", "partial_mask"),
        PathLabel("d_unknown", "something else"),
    ]
    return cols.path_label_mask(df, "org1:spark:lake:documents", found)


@query(
    "P8_typed_placeholder",
    """SELECT 0::BIGINT AS o_orderkey, o_custkey, '00000000-0000-0000-0000-000000000000' AS o_orderstatus,
      0.0::DOUBLE AS o_totalprice, TIMESTAMP '1970-01-01' AS o_orderdate, o_orderpriority FROM orders""",
)
def typed(spark, sf):
    df = Tables(spark, sf).orders.withMetadata("o_orderstatus", {"type_kind": "uuid"})
    found = [PathLabel(n) for n in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")]
    return cols.path_label_mask(df, "org1:spark:tpch:orders", found)


@query(
    "P9_object_id",
    """SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN '' ELSE 'org' || s_nationkey || ':' ||
        CASE WHEN s_nationkey % 2 = 0 THEN 'postgres' ELSE 'mongo' END || ':db:' || s_name END AS object_id,
      CASE WHEN s_nationkey = 0 THEN NULL ELSE s_name END AS object_name FROM supplier""",
)
def ids(spark, sf):
    nation = F.col("s_nationkey").cast("string")
    org = F.when(F.col("s_nationkey") == 0, "").otherwise(F.concat(F.lit("org"), nation))
    driver = F.when(F.col("s_nationkey") % 2 == 0, " PostgreSQL").otherwise("MongoDB ")
    built = Tables(spark, sf).supplier.select(
        "s_suppkey", text.object_id(org, driver, F.lit("db"), F.col("s_name")).alias("object_id")
    )
    return built.withColumn("object_name", text.parse_object_id(F.col("object_id"))["object"])


CHAIN = Policy(
    object_id=CUSTOMER_ID,
    overlay={"c_name": "[redacted]", "c_mktsegment": OverlayRule(partial=True)},
    labels=[PathLabel("c_name", "partial_mask")],
)


@query(
    "P10_mask_chain",
    f"""SELECT c_custkey, '******ted]' AS c_name, c_nationkey, c_acctbal, {partial_sql('c_mktsegment')} AS c_mktsegment
    FROM customer""",
)
def chain(spark, sf):
    return jobs.mask_table(Tables(spark, sf).customer, CHAIN)


@query(
    "P11_fallthrough",
    "SELECT count(*) AS n_rows, 0::BIGINT AS changed_elsewhere, count(*) AS changed_names FROM customer",
)
def untouched(spark, sf):
    df = Tables(spark, sf).customer
    kept = [c for c in df.columns if c != "c_name"]
    both = jobs.mask_table(df.withColumns({f"was_{c}": F.col(c) for c in df.columns}), Policy(overlay={"c_name": "[x]"}))
    changed = F.lit(False)
    for c in kept:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(changed).alias("changed_elsewhere"),
        F.count_if(F.col("c_name") != F.col("was_c_name")).alias("changed_names"),
    )


@query(
    "P12_coverage_report",
    f"""WITH {ORDER_LEAVES} SELECT 'org1:spark:tpch:order_docs' AS object_id, path AS field_path,
      CASE path WHEN 'customer.name' THEN 'overlay+labels' WHEN 'lines[].flag' THEN 'labels' ELSE 'none' END AS covered_by,
      count(*) AS n_values FROM leaves WHERE NOT is_key GROUP BY path""",
)
def coverage(spark, sf):
    object_id = "org1:spark:tpch:order_docs"
    leaves = doc_walk(order_documents(spark, sf), "doc_id", "doc").filter(~F.col("is_key"))
    fields_ = leaves.groupBy(F.col("path").alias("field_path")).agg(F.count(F.lit(1)).alias("n_values"))
    policy = Policy(overlay={"name": "x"}, labels=[PathLabel("customer.name"), PathLabel("lines[].flag")])
    report = jobs.coverage_report(fields_.withColumn("object_id", F.lit(object_id)), {object_id: policy})
    return report.join(fields_, "field_path").select("object_id", "field_path", "covered_by", "n_values")


@query(
    "J2_role_lookup",
    """SELECT role, CASE role WHEN 'user' THEN '[u]' ELSE '[default]' END AS token, count(*) AS n
    FROM conversations GROUP BY role""",
)
def role_lookup(spark, sf):
    masked = cols.role_overlay(
        Tables(spark, sf).conversations.select("role", F.col("text").alias("token")),
        "role",
        {"token": "[default]"},
        {"user": {"token": "[u]"}},
    )
    return masked.groupBy("role", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "U1_custom_masker",
    "SELECT c_custkey, '[redacted]' AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer",
)
def own_masker(spark, sf):
    def lowered(df, policy):
        return df.withColumn("c_mktsegment", F.lower("c_mktsegment"))

    df = Tables(spark, sf).customer.select("c_custkey", "c_name", "c_mktsegment")
    return jobs.mask_table(df, Policy(overlay={"c_name": "[redacted]"}), extra=[lowered])


@query(
    "C1_mask_aliased",
    f"""SELECT c_custkey AS k, '[redacted]' AS shown, {partial_sql('c_mktsegment')} AS part, c_acctbal AS balance FROM customer""",
)
def mask_aliased(spark, sf):
    """A result whose columns have other names is masked by the labels of the columns behind them."""
    t = Tables(spark, sf)
    df = t.customer.selectExpr("c_custkey AS k", "c_name AS shown", "c_mktsegment AS part", "c_acctbal AS balance")
    # which column of the table each result column shows
    shown = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(a).alias("name"), F.lit(b).alias("real")) for i, (a, b) in enumerate((("shown", "c_name"), ("part", "c_mktsegment")), 1)])
    each = t.region.filter("r_regionkey = 0").select(F.inline(shown))
    columns = each.select(F.lit(1).alias("table_id"), F.col("no").alias("column_no"), "name")
    known = each.select(F.lit(1).alias("table_id"), F.col("no").alias("column_no"), F.lit("customer").alias("table_name"), F.col("real").alias("real_name"))
    resolved = labelling.column_lineage_lookup(columns, known, "org1", "spark", "tpch")
    policy = Policy(
        object_id="org1:spark:tpch:customer",
        labels=[PathLabel("c_name"), PathLabel("c_mktsegment", "partial_mask")],
        paths=jobs.real_names(resolved, "org1:spark:tpch:customer"),
    )
    return jobs.mask_table(df, policy)


_DISAGREEING = """
  SELECT CASE n_regionkey WHEN 0 THEN 'c_name' WHEN 1 THEN 'c_mktsegment' WHEN 2 THEN 'c_acctbal' ELSE 'other' END AS field_path,
    CASE n_nationkey % 3 WHEN 0 THEN 'do_not_mask' WHEN 1 THEN 'partial_mask' ELSE 'full_redact' END AS profile,
    CASE WHEN n_nationkey % 4 = 1 AND n_regionkey <> 2 THEN 'manual' ELSE 'platform' END AS source, n_nationkey AS seen FROM nation"""


@query(
    "C1_labels_disagree",
    f"""WITH l AS ({_DISAGREEING}), own AS (SELECT field_path, arg_max(profile, (source = 'manual', seen)) AS profile FROM l GROUP BY field_path),
      p AS (SELECT max(profile) FILTER (field_path = 'c_name') AS a, max(profile) FILTER (field_path = 'c_mktsegment') AS b,
        max(profile) FILTER (field_path = 'c_acctbal') AS c FROM own)
    SELECT c_custkey, CASE WHEN a IS NULL OR a = 'do_not_mask' THEN c_name WHEN a = 'partial_mask' THEN {partial_sql("c_name")} ELSE '[redacted]' END AS c_name,
      CASE WHEN b IS NULL OR b = 'do_not_mask' THEN c_mktsegment WHEN b = 'partial_mask' THEN {partial_sql("c_mktsegment")} ELSE '[redacted]' END AS c_mktsegment,
      CASE WHEN c IS NULL OR c = 'do_not_mask' THEN c_acctbal ELSE 0.0 END AS c_acctbal FROM customer, p""",
)
def labels_disagree(spark, sf):
    """Several confirmed labels of one column: a person's counts before the platform's, then the latest."""
    t = Tables(spark, sf)
    region, nation = F.col("n_regionkey"), F.col("n_nationkey")
    table = t.nation.select(
        F.lit(CUSTOMER_ID).alias("object_id"),
        F.when(region == 0, "c_name").when(region == 1, "c_mktsegment").when(region == 2, "c_acctbal").otherwise("other").alias("field_path"),
        F.when(nation % 3 == 0, "do_not_mask").when(nation % 3 == 1, "partial_mask").otherwise("full_redact").alias("profile"),
        F.lit("x").alias("category"),
        F.when((nation % 4 == 1) & (region != 2), "manual").otherwise("platform").alias("source"),
        F.lit("path").alias("match_mode"),
        nation.alias("updated_at"),
    )
    df = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return jobs.mask_table(df, Policy(object_id=CUSTOMER_ID, labels=table))
