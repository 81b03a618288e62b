"""Masking of flat columns. Every rule is settled per schema field, so a job is one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import partial_mask
from hushframe.plans.policy import (
    REDACTED,
    ColumnPolicy,
    OverlayRule,
    PathLabel,
    classify_columns,
    kind_of,
    overlay_rules,
    resolve_labels,
)

Layer = Callable[[DataFrame], DataFrame]

ZERO_UUID = "00000000-0000-0000-0000-000000000000"


def typed_placeholder(data_type: T.DataType, kind: str | None = None) -> Column | None:
    """A harmless value the column type can hold; None when there is none."""
    kind = kind or kind_of(data_type)
    if kind == "numeric":
        return F.lit(0).cast(data_type)
    if kind == "bool":
        return F.lit(False)
    if kind == "uuid":
        return F.lit(ZERO_UUID)
    if kind == "object_id":
        if isinstance(data_type, T.BinaryType):
            return F.unhex(F.lit("00" * 12))
        return F.lit("0" * 24)
    if isinstance(data_type, T.DateType):
        return F.expr("DATE'0001-01-01'")
    if isinstance(data_type, T.TimestampType):
        # built from a number: the same instant whatever the session time zone
        return F.timestamp_seconds(F.lit(0))
    if isinstance(data_type, T.TimestampNTZType):
        return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    if isinstance(data_type, T.TimeType):
        return F.expr("TIME'00:00:00'").cast(data_type)
    if isinstance(data_type, T.DayTimeIntervalType):
        return F.expr("INTERVAL '0' SECOND").cast(data_type)
    if isinstance(data_type, T.YearMonthIntervalType):
        return F.expr("INTERVAL '0' MONTH").cast(data_type)
    return None


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Put new values in place; order, names and field metadata stay."""
    if not new:
        return df
    return df.select(
        *[
            new[f.name].alias(f.name, metadata=f.metadata) if f.name in new else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _keep_null(original: Column, masked: Column) -> Column:
    # this form keeps the column's nullability
    return F.when(original.isNull(), original).otherwise(masked)


def overlay_value(col: Column, rule: OverlayRule) -> Column:
    return partial_mask(col) if rule.partial else _keep_null(col, F.lit(rule.token))


def overlay_mask(df: DataFrame, rules: Mapping[str, OverlayRule | str]) -> DataFrame:
    """Mask free-text columns by name."""
    by_name = overlay_rules(rules)
    hits = {
        c.name: overlay_value(F.col(f"`{c.name}`"), by_name[c.name.lower()])
        for c in classify_columns(df.schema)
        if c.free_text and c.name.lower() in by_name
    }
    return replace_columns(df, hits)


def role_value(
    col: Column,
    name: str,
    role: Column,
    default: Mapping[str, OverlayRule],
    by_role: Mapping[str, Mapping[str, OverlayRule]],
) -> Column:
    """A role with its own rules uses only those; every other row uses the default rules."""
    key = name.lower()
    fallback = overlay_value(col, default[key]) if key in default else col
    tokens = {r: rules[key].token for r, rules in by_role.items() if key in rules}
    silent = [r for r, rules in by_role.items() if key not in rules]
    out = F.when(F.lit(False), col)
    if tokens:
        pairs = [F.lit(x) for pair in tokens.items() for x in pair]
        out = out.when(role.isin(*tokens), _keep_null(col, F.create_map(*pairs)[role]))
    if silent:
        out = out.when(role.isin(*silent), col)
    return out.otherwise(fallback)


def role_overlay(
    df: DataFrame,
    role_col: str,
    default_rules: Mapping[str, OverlayRule | str],
    role_rules: Mapping[str, Mapping[str, str]],
) -> DataFrame:
    """Overlay rules chosen per row by the role in `role_col`."""
    default = overlay_rules(default_rules)
    by_role = {r: overlay_rules(rules) for r, rules in role_rules.items() if r}
    named = set(default).union(*by_role.values())
    hits = {
        c.name: role_value(F.col(f"`{c.name}`"), c.name, F.col(role_col), default, by_role)
        for c in classify_columns(df.schema)
        if c.free_text and c.name.lower() in named
    }
    return replace_columns(df, hits)


def find_label(
    labels: Mapping[str, PathLabel], path: str, name: str, strict_match_mode: bool = False
) -> PathLabel | None:
    """The label of a path, else of the bare lower-cased name."""
    if path in labels:
        return labels[path]
    hit = labels.get(name.strip().lower())
    if hit is not None and strict_match_mode and hit.match_mode != "key_any_depth":
        return None
    return hit


def profile_value(col: Column, c: ColumnPolicy, profile: str) -> Column:
    """Apply what a confirmed label asks for."""
    if profile == "do_not_mask" or not c.text:
        return col
    if c.free_text:
        if profile == "partial_mask":
            return partial_mask(col)
        return _keep_null(col, F.lit(REDACTED))
    zero = typed_placeholder(c.data_type, c.kind)
    return col if zero is None else _keep_null(col, zero)


def path_label_mask(
    df: DataFrame,
    object_id: str,
    path_labels: DataFrame | Sequence[PathLabel],
    strict_match_mode: bool = False,
    paths: Mapping[str, str] | None = None,
) -> DataFrame:
    """Mask columns by confirmed labels. `paths` gives the real name behind an alias."""
    labels = resolve_labels(path_labels, object_id)
    hits = {}
    for c in classify_columns(df.schema):
        label = find_label(labels, (paths or {}).get(c.name, c.name), c.name, strict_match_mode)
        if label is not None and c.text:
            hits[c.name] = profile_value(F.col(f"`{c.name}`"), c, label.profile)
    return replace_columns(df, hits)


def mask_chain(df: DataFrame, *layers: Layer | None) -> DataFrame:
    """Apply layers left to right, each on the output of the one before."""
    for layer in layers:
        if layer is not None:
            df = df.transform(layer)
    return df
