"""The label table: look up, merge, confirm, queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import partial_mask
from hushframe.plans.policy import CONFIRMED, REDACTED

LABEL_SCHEMA = (
    "object_id string, field_path string, match_mode string, category string, profile string, "
    "source string, confidence double, sample_count bigint, last_observed_at timestamp, "
    "updated_at timestamp, updated_by string"
)
HUMAN = (*CONFIRMED, "dismissed")

_FIELDS = [part.split()[0] for part in LABEL_SCHEMA.split(", ")]


def confirmed_labels(path_labels: DataFrame, object_id: str | None = None) -> DataFrame:
    """Labels that a person or the platform set; an empty match mode means `path`."""
    out = path_labels.filter(F.col("source").isin(*CONFIRMED))
    if object_id is not None:
        out = out.filter(F.col("object_id") == object_id)
    return out.withColumn("match_mode", F.coalesce(F.nullif("match_mode", F.lit("")), F.lit("path")))


def one_label(path_labels: DataFrame) -> DataFrame:
    """One label per object and path: a person's before the platform's, then the latest; the rest of the row breaks
    ties, so the choice is the same in every run. An aggregation with partial results."""
    rest = [c for c in path_labels.columns if c not in ("object_id", "field_path")]
    at = F.col("updated_at") if "updated_at" in rest else F.lit(0)
    # a null time sorts first
    order = F.struct((F.col("source") == "manual").alias("human"), at.isNotNull().alias("known"), at.alias("at"), F.to_json(F.struct(*rest)).alias("row"))
    return (
        path_labels.groupBy("object_id", "field_path")
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select("object_id", "field_path", *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*path_labels.columns)
    )


def label_lookup(
    df: DataFrame,
    path_labels: DataFrame,
    object_col: str = "object_id",
    path_col: str = "path",
    key_col: str = "key",
    strict_match_mode: bool = False,
) -> DataFrame:
    """Add category, profile and matched_by (path, key or null) to rows that name a field.

    A confirmed label of the path decides; without one the lower-cased bare key is looked up. Of several labels of
    one path one is settled before, so the rows stay as many as they are (see `one_label`).
    """
    labels = confirmed_labels(path_labels).filter(F.col("object_id") != "")

    def side(prefix: str, table: DataFrame) -> DataFrame:
        return one_label(table).select(
            F.col("object_id").alias(f"_{prefix}_object"),
            F.col("field_path").alias(f"_{prefix}_path"),
            F.struct("category", "profile").alias(f"_{prefix}"),
        )

    by_key = labels.filter(F.col("match_mode") == "key_any_depth") if strict_match_mode else labels
    bare = F.lower(F.trim(F.col(key_col)))
    joined = df.join(
        side("p", labels),
        (F.col(object_col) == F.col("_p_object")) & (F.col(path_col) == F.col("_p_path")),
        "left",
    ).join(
        side("k", by_key),
        (F.col(object_col) == F.col("_k_object")) & (bare == F.col("_k_path")),
        "left",
    )
    hit = F.coalesce(F.col("_p"), F.col("_k"))
    matched = F.when(F.col("_p").isNotNull(), F.lit("path")).when(F.col("_k").isNotNull(), F.lit("key"))
    return joined.select(
        *df.columns,
        hit["category"].alias("category"),
        hit["profile"].alias("profile"),
        matched.alias("matched_by"),
    )


def mask_by_lookup(
    df: DataFrame,
    path_labels: DataFrame,
    value_col: str = "value",
    object_col: str = "object_id",
    path_col: str = "path",
    key_col: str = "key",
    strict_match_mode: bool = False,
) -> DataFrame:
    """Mask the text values of rows that name their object and path, such as a table of leaves."""
    found = label_lookup(df.withColumn("_value", F.col(value_col)), path_labels, object_col, path_col, key_col, strict_match_mode)
    value, profile = F.col("_value"), F.col("profile")
    masked = (
        F.when(F.col("matched_by").isNull() | value.isNull() | (profile == "do_not_mask"), value)
        .when(profile == "partial_mask", partial_mask(value))
        .otherwise(F.lit(REDACTED))
    )
    return found.withColumn(value_col, masked).select(*df.columns)


def column_lineage_lookup(columns_df: DataFrame, column_map: DataFrame, org: str, driver: str, database: str) -> DataFrame:
    """Resolve result columns (table_id, column_no, name) to the real table column behind them.

    `column_map` has table_id, column_no, table_name, real_name. Without a match the object id is
    empty and the displayed name stands in for the path. A column that the map names twice counts with its least
    entry, so no row is multiplied.
    """
    real = F.min(F.struct("table_name", "real_name"))
    known = column_map.groupBy(F.col("table_id").alias("_t"), F.col("column_no").alias("_n")).agg(real.alias("_r"))
    known = known.select("_t", "_n", F.col("_r.table_name").alias("_table"), F.col("_r.real_name").alias("_real"))
    joined = columns_df.join(
        known, (F.col("table_id") == F.col("_t")) & (F.col("column_no") == F.col("_n")), "left"
    )
    object_id = F.concat_ws(":", F.lit(org), F.lit(driver), F.lit(database), F.col("_table"))
    return joined.select(
        *columns_df.columns,
        F.when(F.col("_table").isNull(), F.lit("")).otherwise(object_id).alias("object_id"),
        F.coalesce("_real", "name").alias("path"),
    )


def _latest(value: Column, order: Column, when: Column) -> Column:
    return F.max_by(F.when(when, value), F.when(when, order))


def _valid(df: DataFrame) -> DataFrame:
    """A label without an object or a path is refused."""
    return df.filter((F.coalesce("object_id", F.lit("")) != "") & (F.coalesce("field_path", F.lit("")) != ""))


def merge_proposed(props: DataFrame, order_by: str = "seq") -> DataFrame:
    """One row per field: counts add up, the highest confidence and latest times stay, and the newest
    proposal gives category, profile and match mode."""
    given = F.struct("category", "profile", "match_mode", "updated_by")
    # equal orders are settled by time, confidence and the proposal itself
    newest = F.max_by(given, F.struct(F.col(order_by), F.col("updated_at"), F.col("confidence"), given))
    return (
        _valid(props)
        .groupBy("object_id", "field_path")
        .agg(
            newest.alias("_new"),
            F.sum("sample_count").alias("sample_count"),
            F.max("confidence").alias("confidence"),
            F.max("last_observed_at").alias("last_observed_at"),
            F.max("updated_at").alias("updated_at"),
        )
        .select(
            "object_id",
            "field_path",
            F.coalesce(F.nullif("_new.match_mode", F.lit("")), F.lit("path")).alias("match_mode"),
            F.col("_new.category").alias("category"),
            F.col("_new.profile").alias("profile"),
            F.lit("proposed").alias("source"),
            "confidence",
            "sample_count",
            "last_observed_at",
            "updated_at",
            F.col("_new.updated_by").alias("updated_by"),
        )
    )


def upsert_labels(current: DataFrame, incoming: DataFrame, order_by: str = "seq") -> DataFrame:
    """The label table after a batch of changes.

    The last decision of a person wins and no proposal overrides it; proposals only merge with
    proposals. Current and incoming rows meet in one grouping, so the table is shuffled once.
    """
    lowest = F.lit(None).cast(incoming.schema[order_by].dataType)
    both = current.withColumn(order_by, lowest).select(*_FIELDS, order_by).unionByName(
        incoming.select(*_FIELDS, order_by)
    )
    # a null order cannot win max_by, so the current row is ranked by a flag first
    rank = F.struct(F.col(order_by).isNotNull().alias("new"), F.col(order_by).alias("order"))
    human = F.col("source").isin(*HUMAN)
    rest = [f for f in _FIELDS if f not in ("object_id", "field_path")]
    row = F.struct(*rest)
    merged = (
        _valid(both)
        .groupBy("object_id", "field_path")
        .agg(
            _latest(row, rank, human).alias("_human"),
            _latest(row, rank, ~human).alias("_prop"),
            F.sum(F.when(~human, F.col("sample_count"))).alias("_n"),
            F.max(F.when(~human, F.col("confidence"))).alias("_conf"),
            F.max(F.when(~human, F.col("last_observed_at"))).alias("_seen"),
            F.max(F.when(~human, F.col("updated_at"))).alias("_updated"),
        )
    )
    proposed = {
        "sample_count": F.col("_n"),
        "confidence": F.col("_conf"),
        "last_observed_at": F.col("_seen"),
        "updated_at": F.col("_updated"),
    }
    by_hand = F.col("_human").isNotNull()
    picked = {
        f: F.when(by_hand, F.col(f"_human.{f}")).otherwise(proposed.get(f, F.col(f"_prop.{f}"))) for f in rest
    }
    picked["match_mode"] = F.coalesce(F.nullif(picked["match_mode"], F.lit("")), F.lit("path"))
    return merged.select("object_id", "field_path", *[picked[f].alias(f) for f in rest])


def union_proposals(*dfs: DataFrame) -> DataFrame:
    """Proposals of several producers in one table; missing columns are null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def suppress_dismissed(props: DataFrame, path_labels: DataFrame) -> DataFrame:
    """Leave out proposals that a person has already turned down."""
    gone = path_labels.filter(F.col("source") == "dismissed").select("object_id", "field_path", "category")
    return props.join(gone.distinct(), ["object_id", "field_path", "category"], "left_anti").select(*props.columns)


def latest_label(df: DataFrame, order_by: Sequence[str] = ("updated_at", "seq")) -> DataFrame:
    """Last write per field. An aggregation, so that hot fields shrink before the shuffle."""
    rest = [c for c in df.columns if c not in ("object_id", "field_path")]
    order = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order_by])
    return (
        df.groupBy("object_id", "field_path")
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select("object_id", "field_path", *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def rescan_selection(
    objects: DataFrame,
    history: DataFrame,
    now: Column,
    max_objects: int = 0,
    rescan_seconds: int = 86_400,
) -> DataFrame:
    """Objects to scan next: never scanned ones, then the oldest. Limits of 0 or less are off."""
    last = history.groupBy("object").agg(F.max("last_scanned").alias("last_scanned"))
    out = objects.select("object").distinct().join(last, "object", "left")
    if rescan_seconds > 0:
        edge = now - F.make_dt_interval(secs=F.lit(rescan_seconds))
        out = out.filter(F.col("last_scanned").isNull() | (F.col("last_scanned") <= edge))
    ordered = out.orderBy(F.col("last_scanned").asc_nulls_first(), "object")
    return ordered.limit(max_objects) if max_objects > 0 else ordered


def pending_cap(df: DataFrame, max_pending: int) -> DataFrame:
    """The pending proposals that fit; the least sure are dropped."""
    return df.orderBy(F.col("confidence").desc_nulls_last(), "object_id", "field_path").limit(max_pending)


def field_cap(df: DataFrame, max_fields: int, seen: str = "last_seen") -> DataFrame:
    """Fields kept in view, the least recently seen leave first."""
    fields = df.groupBy("object_id", "field_path").agg(F.max(seen).alias("last_seen"))
    return fields.orderBy(F.col("last_seen").desc_nulls_last(), "object_id", "field_path").limit(max_fields)


def review_queue(df: DataFrame) -> DataFrame:
    """Open proposals, the least sure first."""
    open_ones = df.filter(F.col("source") == "proposed")
    return open_ones.orderBy(F.col("confidence").asc_nulls_first(), "object_id", "field_path")


def proposal_batches(path_labels: DataFrame, max_pending: int | None = None, max_items: int = 1000) -> DataFrame:
    """Pending proposals in batches per object: object_id, batch, items.

    All proposals come out, at most about `max_items` to a batch; `max_pending` caps them when it is given.
    """
    pending = path_labels.filter(F.col("source") == "proposed")
    if max_pending is not None:
        pending = pending_cap(pending, max_pending)
    item = F.struct("field_path", "match_mode", "category", "confidence", "sample_count", "last_observed_at")
    # batches are dealt by a hash of the path, as many as the object's proposals ask for
    counts = pending.groupBy("object_id").agg(F.ceil(F.count(F.lit(1)) / max_items).alias("_batches"))
    dealt = pending.join(counts, "object_id").withColumn("batch", F.pmod(F.xxhash64("field_path"), F.col("_batches")))
    return dealt.groupBy("object_id", "batch").agg(F.sort_array(F.collect_list(item)).alias("items"))
