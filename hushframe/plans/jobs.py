"""The jobs a user calls: mask, propose labels, report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hushframe.operators import columns as cols
from hushframe.operators import detect, documents, labels, metrics, sampling
from hushframe.operators.labels import LABEL_SCHEMA
from hushframe.plans.policy import Detection, Policy, classify_columns, make_object_id
from hushframe.session import shared_folder
from hushframe.sources.tables import field_inventory

# A plugged-in masker: same columns out, null stays null.
Masker = Callable[[DataFrame, Policy], DataFrame]


def policy_layers(policy: Policy) -> list[cols.Layer]:
    """The layers of a policy in its order; what is not configured is not in the plan."""
    out: list[cols.Layer] = []
    for name in policy.order:
        if name == "detection" and policy.detection is not None:
            out.append(lambda df: detect.detection_layer(df, policy.detection))
        elif name == "overlay" and policy.role_col and policy.role_rules:
            out.append(lambda df: cols.role_overlay(df, policy.role_col, policy.overlay, policy.role_rules))
        elif name == "overlay" and policy.overlay:
            out.append(lambda df: cols.overlay_mask(df, policy.overlay))
        elif name == "labels" and policy.object_id:
            out.append(
                lambda df: cols.path_label_mask(df, policy.object_id, policy.labels, policy.strict_match_mode, policy.paths)
            )
    return out


def real_names(resolved: DataFrame, object_id: str) -> dict[str, str]:
    """`Policy.paths` from a resolved lineage (`column_lineage_lookup`): one entry per result column of the object."""
    rows = resolved.filter(F.col("object_id") == object_id).select("name", "path").collect()
    return {r["name"]: r["path"] for r in rows}


def mask_table(df: DataFrame, policy: Policy, extra: Sequence[Masker] = ()) -> DataFrame:
    """Mask the flat columns of a table. Rows, columns and types stay; `extra` maskers run last."""
    plugged = [lambda d, m=m: m(d, policy) for m in extra]
    return cols.mask_chain(df, *policy_layers(policy), *plugged)


def mask_documents(df: DataFrame, doc_cols: Sequence[str], policy: Policy, strict: bool | None = None) -> DataFrame:
    """Mask document columns by path; the flat columns beside them are not touched."""
    for name in doc_cols:
        df = documents.doc_mask(df, name, policy, strict=strict)
    return df


def masking_report(
    df: DataFrame, policy: Policy, connection: Column, max_buckets: int = metrics.MAX_BUCKETS, doc_cols: Sequence[str] = ()
) -> DataFrame:
    """What masking `df` under `policy` looks at and masks, largest buckets first kept apart.

    With `doc_cols` the leaves of those documents are counted instead of the flat columns. The sums, which the choice
    of buckets reads twice, are written to the shared folder first: `df` is scanned once.
    """
    counted = metrics.masking_metrics(metrics.outcome_rows(df, policy, connection, doc_cols))
    path = shared_folder(df.sparkSession, "counted")
    counted.write.parquet(path)
    return metrics.metrics_overflow(df.sparkSession.read.schema(counted.schema).parquet(path), max_buckets)


def mask_and_report(
    df: DataFrame,
    policy: Policy,
    connection: str,
    write: Callable[[DataFrame], None],
    doc_cols: Sequence[str] = (),
    entities: Sequence[str] = (),
) -> DataFrame:
    """Mask, hand the masked rows to `write`, and return the counts of that very pass: the input is read once.

    `write` runs one action over the rows it is given (`df.write...`). The counts are kept per entity of the policy and
    per name in `entities` (what a plugged-in detector may answer); all others come under OTHER.
    """
    counted = metrics.mask_documents_counted(df, doc_cols, policy) if doc_cols else metrics.mask_counted(df, policy)
    keys, observation = metrics.known_keys(policy, entities), Observation()
    write(metrics.observe_outcomes(counted, observation, keys))
    return metrics.observed_metrics(df.sparkSession, observation, keys, connection)


def coverage_report(fields: DataFrame, policies: Mapping[str, Policy]) -> DataFrame:
    """Which layers have a rule for each field: object_id, field_path, covered_by ('none' when none).

    `fields` comes from field_inventory, whose nested paths are texts. A rule of any role covers its field. Content detection covers the fields named in
    the policy's object; typed columns are left to labels.
    """
    key = F.lower(F.regexp_replace(F.substring_index("field_path", ".", -1), r"\[\]$", ""))
    names = F.array().cast("array<string>")
    for object_id, policy in policies.items():
        layers = []
        if policy.detection is not None:
            layers.append(F.lit("detection"))
        by_role = policy.role_rules.values() if policy.role_col else ()
        overlay = sorted({name for rules in (policy.overlay, *by_role) for name in cols.overlay_rules(rules)})
        if overlay:
            layers.append(F.when(key.isin(*overlay), F.lit("overlay")))
        labelled = list(cols.resolve_labels(policy.labels, object_id))
        if labelled:
            hit = F.col("field_path").isin(*labelled) | key.isin(*labelled)
            layers.append(F.when(hit, F.lit("labels")))
        if layers:
            found = F.array_compact(F.array(*layers))
            names = F.when(F.col("object_id") == object_id, found).otherwise(names)
    shown = F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise(F.lit("none"))
    return fields.select("object_id", "field_path", shown.alias("covered_by"))


def masking_mode(policy: Policy) -> str:
    """Short name of the layers that act on every table: content detection and overlay."""
    parts = []
    if policy.detection is not None:
        parts.append("remote")
    if policy.overlay:
        parts.append("overlay")
    mode = "+".join(parts)
    strict = policy.detection is not None and policy.detection.strict
    return (mode + "(strict)" if strict else mode) or "none"


def _as_proposals(found: DataFrame, now: Column, updated_by: str) -> DataFrame:
    filled = {
        "match_mode": F.lit("path"),
        "source": F.lit("proposed"),
        "last_observed_at": now,
        "updated_at": now,
        "updated_by": F.lit(updated_by),
        "seq": F.lit(0).cast("bigint"),
    }
    names = [p.split()[0] for p in LABEL_SCHEMA.split(", ")] + ["seq"]
    have = set(found.columns)
    profile = {} if "profile" in have else {"profile": F.lit("")}
    full = found.withColumns({**filled, **profile})
    return full.select(*names)


def propose_from_values(
    df: DataFrame, object_id: str, now: Column, detection: Detection | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Label proposals from what content detection finds in the values of a table.

    Each value with a find is one observation; the newest one in `order_by` order gives the category.
    """
    values = sampling.field_values(df, object_id, order_by)
    best = detect.best_of(detect.span_array(F.col("value"), detection))
    seen = values.withColumn("_best", best).filter(F.col("_best").isNotNull())
    named = seen.select(
        "object_id",
        "field_path",
        F.lit("path").alias("match_mode"),
        F.col("_best.category").alias("category"),
        F.lit("").alias("profile"),
        F.col("_best.confidence").alias("confidence"),
        F.lit(1).cast("bigint").alias("sample_count"),
        now.alias("last_observed_at"),
        now.alias("updated_at"),
        F.lit("detector").alias("updated_by"),
        F.struct(*order_by, "value").alias("_order"),
    )
    return labels.merge_proposed(named, order_by="_order")


def propose_labels(
    tables: Mapping[str, DataFrame],
    org: str,
    driver: str,
    database: str,
    current: DataFrame,
    history: DataFrame,
    now: Column,
    order_by: Mapping[str, Sequence[str]] | None = None,
    classifier: sampling.Classifier | None = None,
    sampler: Callable[[DataFrame, int], DataFrame] | None = None,
    extra_proposals: Sequence[DataFrame] = (),
    max_objects: int = 0,
    rescan_seconds: int = 86_400,
    max_samples: int = sampling.MAX_SAMPLES,
    min_confidence: float = 0.5,
    taxonomy: Sequence[str] = sampling.TAXONOMY,
    max_pending: int | None = None,
) -> DataFrame:
    """One scan over the tables that are due: sample fields, classify them and merge the proposals into
    the label table. Returns the new label table.

    `sampler(df, n)` may replace the default sampling; it gives field_path and samples. `max_objects` and
    `max_pending` limit a scan when they are given.
    """
    session = current.sparkSession
    objects = session.createDataFrame([(name,) for name in tables], "object string")
    # the names of the tables to scan: at most as many as the caller named
    due = labels.rescan_selection(objects, history, now, max_objects, rescan_seconds)
    chosen = [r["object"] for r in due.select("object").collect()]
    sampled = []
    for name in chosen:
        object_id = make_object_id(org, driver, database, name)
        if sampler is not None:
            own = sampler(tables[name], max_samples).withColumn("object_id", F.lit(object_id))
            sampled.append(own.select("object_id", "field_path", "samples"))
        elif any(c.free_text for c in classify_columns(tables[name].schema)):
            order = list((order_by or {}).get(name, ()))
            values = sampling.field_values(tables[name], object_id, order)
            sampled.append(sampling.first_values(values, order, max_samples))
    if not sampled:
        return current
    fields = labels.union_proposals(*sampled)
    found = sampling.classify_fields(fields, classifier, taxonomy, 1, min_confidence)
    props = labels.union_proposals(_as_proposals(found, now, "classifier"), *extra_proposals)
    merged = labels.merge_proposed(labels.suppress_dismissed(props, current))
    capped = merged if max_pending is None else labels.pending_cap(merged, max_pending)
    capped = capped.withColumn("seq", F.lit(1).cast("bigint"))
    return labels.upsert_labels(current, capped)


def scan_fields(tables: Mapping[str, DataFrame], org: str, driver: str, database: str) -> DataFrame:
    """Fields of many tables as one inventory."""
    parts = [field_inventory(df, make_object_id(org, driver, database, name)) for name, df in tables.items()]
    return labels.union_proposals(*parts)
