"""Counts of what was looked at and what was masked. Values never leave the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.text import inline_rows, let
from hushframe.operators import columns as cols
from hushframe.operators import documents
from hushframe.operators.detect import active_recognizers, found_texts
from hushframe.operators.outcomes import FIELD_RULE, OTHER, RECOGNIZER, UNSPECIFIED, no_outcomes, of_detection, of_label
from hushframe.plans.policy import ColumnPolicy, Detection, PathLabel, Policy, classify_columns, resolve_labels

MAX_BUCKETS = 500
KEYS = ["connection_key", "entity_type", "detection_source"]
COUNTS = ["count_analyzed", "count_masked", "bytes_masked"]
#: The column of outcomes beside the masked ones.
HIDDEN = "_outcomes"


def _label_of(c: ColumnPolicy, labels: Mapping[str, PathLabel], policy: Policy) -> PathLabel | None:
    return cols.find_label(labels, policy.paths.get(c.name, c.name), c.name, policy.strict_match_mode)


def _acts(c: ColumnPolicy, label: PathLabel | None) -> bool:
    if label is None or label.profile == "do_not_mask":
        return False
    return c.free_text or cols.typed_placeholder(c.data_type, c.kind) is not None


def _count_detection(df: DataFrame, d: Detection, text: bool) -> DataFrame:
    names = [c.name for c in classify_columns(df.schema) if c.free_text]
    if not names:
        return df
    texts = F.array(*[F.col(f"`{n}`") for n in names])
    found = df.withColumn("_found", found_texts(texts, d, text))
    counts = F.flatten(F.transform("_found", of_detection))
    new = {HIDDEN: F.concat(HIDDEN, counts)}
    if text:
        new |= {n: F.get("_found", F.lit(i))["text"] for i, n in enumerate(names)}
    return cols.replace_columns(found, new).drop("_found")


def _count_labels(df: DataFrame, policy: Policy) -> DataFrame:
    labels = resolve_labels(policy.labels, policy.object_id)
    counts, masked = [], {}
    for c in classify_columns(df.schema):
        if not c.text or (not c.free_text and c.kind is None):
            continue
        label, value = _label_of(c, labels, policy), F.col(f"`{c.name}`")
        acts = _acts(c, label)
        counts.append(of_label(value, F.lit(acts), F.lit(label.category if acts else "")))
        if acts:
            masked[c.name] = cols.profile_value(value, c, label.profile)
    return cols.replace_columns(df, {**masked, HIDDEN: F.concat(HIDDEN, *counts)}) if counts else df


def mask_counted(df: DataFrame, policy: Policy, only_counts: bool = False) -> DataFrame:
    """The masked flat columns and, as `_outcomes`, what masking each row looked at and masked: one pass for both.

    Content detection counts each eligible value as analyzed and each span as masked, with its length in
    characters; a plugged-in detector that fails has only looked. Labels count each non-null value looked up, and
    each masked value with its length in bytes at that point of the chain. Overlay and role rules count nothing.
    With `only_counts` texts that no count depends on are not rewritten.
    """
    labels = resolve_labels(policy.labels, policy.object_id)
    sized = any(c.free_text and _acts(c, _label_of(c, labels, policy)) for c in classify_columns(df.schema))
    out = df.withColumn(HIDDEN, no_outcomes())
    for layer in policy.order:
        if layer == "detection" and policy.detection is not None:
            out = _count_detection(out, policy.detection, sized or not only_counts)
        elif layer == "overlay" and policy.role_col and policy.role_rules:
            out = cols.role_overlay(out, policy.role_col, policy.overlay, policy.role_rules)
        elif layer == "overlay" and policy.overlay:
            out = cols.overlay_mask(out, policy.overlay)
        elif layer == "labels" and policy.object_id:
            out = _count_labels(out, policy)
    return out


def mask_documents_counted(
    df: DataFrame, doc_cols: Sequence[str], policy: Policy, strict: bool | None = None, only_counts: bool = False
) -> DataFrame:
    """The same for the leaves of document columns; flat columns are neither masked nor counted."""
    out = df.withColumn(HIDDEN, no_outcomes())
    for name in doc_cols:
        out = documents.doc_mask_counted(out, name, policy, HIDDEN, strict=strict, only_counts=only_counts)
    return out


def outcome_rows(df: DataFrame, policy: Policy, connection: Column, doc_cols: Sequence[str] = ()) -> DataFrame:
    """One row per outcome of masking `df` under `policy`: its flat columns, or the named document columns, where the
    leaves of a document that were only looked at are one row with their number."""
    keyed = df.withColumn("_connection", connection)
    if doc_cols:
        counted = mask_documents_counted(keyed, doc_cols, policy, only_counts=True)
    else:
        # the key is no column of the table: no rule sees it
        counted = mask_counted(df.withColumn("_connection", F.struct(connection.alias("key"))), policy, only_counts=True)
        counted = counted.withColumn("_connection", F.col("_connection.key"))
    return inline_rows(counted, [F.col("_connection").alias("connection_key")], F.col(HIDDEN), "detection_source")


def known_keys(policy: Policy, entities: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(source, entity) that masking under `policy` can count, with one more per source for all others."""
    out = []
    if policy.detection is not None:
        names = [r.entity for r in active_recognizers(policy.detection)] if policy.detection.detector is None else policy.detection.entities
        out += [(RECOGNIZER, e) for e in (UNSPECIFIED, *names, *entities, OTHER)]
    if policy.object_id:
        categories = [l.category.strip() for l in resolve_labels(policy.labels, policy.object_id).values()]
        out += [(FIELD_RULE, e) for e in (UNSPECIFIED, *filter(None, categories), OTHER)]
    return list(dict.fromkeys(out))


def observe_outcomes(counted: DataFrame, observation: Observation, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows without `_outcomes`; whoever writes them fills the observation with the sums by key.

    The sums are collected by the tasks that write: no second scan and no shuffle. They count each row once as long
    as what follows is written without another shuffle.
    """
    if not keys:
        return counted.drop(HIDDEN)
    names = F.array(*[F.lit(f"{s}/{e}") for s, e in keys])
    others = F.create_map(*[x for s in dict(keys) for x in (F.lit(s), F.lit(keys.index((s, OTHER)) + 1))])

    def slot(o: Column) -> Column:
        entity = F.trim(F.coalesce(o["entity_type"], F.lit("")))
        entity = F.when(entity == "", F.lit(UNSPECIFIED)).otherwise(entity)
        at = F.array_position(names, F.concat(o["detection_source"], F.lit("/"), entity))
        return F.when(at > 0, at).otherwise(others[o["detection_source"]].cast("bigint"))

    def total(rows: Column, name: str) -> Column:
        return F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, o: a + F.greatest(F.coalesce(o["o"][name], F.lit(0)), F.lit(0)))

    def totals(slotted: Column) -> Column:
        def of(k: Column) -> Column:
            own = F.filter(slotted, lambda o: o["slot"] == k)
            return let(own, lambda rows: F.when(F.size(rows) > 0, F.struct(*[total(rows, c).alias(c) for c in COUNTS])))

        return F.transform(F.sequence(F.lit(1), F.lit(len(keys))), of)

    slotted = F.transform(HIDDEN, lambda o: F.struct(slot(o).alias("slot"), o.alias("o")))
    staged = counted.withColumn("_totals", let(slotted, totals)).drop(HIDDEN)
    sums = [F.sum(F.get("_totals", F.lit(i))[c]).alias(f"{c}_{i}") for i in range(len(keys)) for c in COUNTS]
    return staged.observe(observation, *sums).drop("_totals")


def observed_metrics(session: SparkSession, observation: Observation, keys: Sequence[tuple[str, str]], connection: str) -> DataFrame:
    """The sums of an observation as a table of metrics; at most one row per key of the policy."""
    found = observation.get if keys else {}
    rows = [(connection, e, s, *(int(found[f"{c}_{i}"] or 0) for c in COUNTS)) for i, (s, e) in enumerate(keys)]
    schema = "connection_key string, entity_type string, detection_source string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return session.createDataFrame([r for r in rows if any(r[3:])], schema)


def masking_metrics(outcomes: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """Sums per connection, entity and source (and what `by` names)."""
    entity = F.trim(F.coalesce("entity_type", F.lit("")))
    clean = outcomes.withColumns(
        {
            "entity_type": F.when(entity == "", F.lit(UNSPECIFIED)).otherwise(entity),
            "bytes_masked": F.greatest(F.coalesce("bytes_masked", F.lit(0)), F.lit(0)),
        }
    )
    return clean.groupBy(*by, *KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])


def metrics_overflow(metrics: DataFrame, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Keep the largest buckets and fold the entities of all others into OTHER."""
    size = F.col("count_analyzed") + F.col("count_masked")
    top = metrics.orderBy(size.desc(), *KEYS).limit(max_buckets)
    # at most `max_buckets` rows: always small enough to send everywhere
    kept = F.broadcast(top.select(*KEYS).withColumn("_kept", F.lit(True)))
    marked = metrics.join(kept, KEYS, "left")
    entity = F.when(F.col("_kept").isNotNull(), F.col("entity_type")).otherwise(F.lit(OTHER))
    return marked.withColumn("entity_type", entity).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def merge_metrics(*parts: DataFrame) -> DataFrame:
    """Add up metric tables, such as a pending one and a batch that could not be delivered."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def daily_metrics(outcomes: DataFrame, ts: str) -> DataFrame:
    """Sums per day of receipt (UTC)."""
    return masking_metrics(outcomes.withColumn("day", F.to_date(ts)), by=["day"])
