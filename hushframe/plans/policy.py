"""What to mask: rules resolved while the plan is built, before any row is read."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import DRIVER_ALIASES

REDACTED = "[redacted]"
CONFIRMED = ("manual", "platform")

# Entities looked for when none are named.
DEFAULT_ENTITIES = (
    "EMAIL_ADDRESS",
    "PHONE_NUMBER",
    "CREDIT_CARD",
    "US_SSN",
    "IP_ADDRESS",
    "IBAN_CODE",
    "CRYPTO",
)


@dataclass(frozen=True)
class OverlayRule:
    """Replace the whole value by `token`, or keep only its last characters."""

    token: str = REDACTED
    partial: bool = False


@dataclass(frozen=True)
class PathLabel:
    field_path: str
    profile: str = ""
    category: str = ""
    source: str = "manual"
    match_mode: str = "path"
    object_id: str = ""
    updated_at: Any = None


@dataclass(frozen=True)
class Recognizer:
    """A pattern for one entity.

    `gate` is a cheap test that is true for every text with a match; `numeric` marks the patterns
    that share one test for digits. One of the words of `context` shortly before a match makes it surer (see
    `detect.CONTEXT_BOOST`). A recognizer with a `language` is off where the detection has another one.
    """

    entity: str
    regex: str
    score: float
    check: Callable[[Column], Column] | None = None
    gate: Callable[[Column], Column] | None = None
    numeric: bool = False
    context: Sequence[str] = ()
    language: str | None = None


@dataclass(frozen=True)
class Anonymizer:
    """How a found span is rewritten: replace, redact, mask or hash."""

    type: str = "replace"
    new_value: str = REDACTED
    masking_char: str = "*"
    chars_to_mask: int = 0
    from_end: bool = False


@dataclass(frozen=True)
class Detection:
    """Settings of content detection; empty values mean the defaults."""

    entities: Sequence[str] = ()
    recognizers: Sequence[Recognizer] = ()
    threshold: float | None = None
    allow_list: Sequence[str] = ()
    allow_match: str = "exact"
    anonymizers: Mapping[str, Anonymizer] = field(default_factory=dict)
    min_len: int = 4
    # a plugged-in detector of texts instead of the patterns, see operators.detect
    detector: Callable[[Sequence[str]], Sequence[Sequence[Mapping[str, Any]]]] | None = None
    strict: bool = False
    language: str | None = None


@dataclass(frozen=True)
class Policy:
    """Everything one masking job needs to know."""

    object_id: str = ""
    overlay: Mapping[str, OverlayRule | str] = field(default_factory=dict)
    role_col: str | None = None
    role_rules: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    labels: DataFrame | Sequence[PathLabel] = ()
    detection: Detection | None = None
    order: Sequence[str] = ("detection", "overlay", "labels")
    strict_match_mode: bool = False
    # shown column -> real name, for labels of columns that a query has renamed
    paths: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnPolicy:
    """How one column may be treated: `kind` names the typed family, None when there is none."""

    name: str
    data_type: T.DataType
    text: bool
    free_text: bool
    kind: str | None


def kind_of(data_type: T.DataType, metadata: Mapping[str, Any] | None = None) -> str | None:
    named = (metadata or {}).get("type_kind")
    if named in ("uuid", "object_id"):
        return named
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    temporal = (
        T.DateType,
        T.TimestampType,
        T.TimestampNTZType,
        T.TimeType,
        T.DayTimeIntervalType,
        T.YearMonthIntervalType,
    )
    if isinstance(data_type, temporal):
        return "date"
    return None


def classify_columns(schema: T.StructType) -> list[ColumnPolicy]:
    """Sort the columns of a schema into free text, typed and untouched."""
    out = []
    for f in schema.fields:
        kind = kind_of(f.dataType, f.metadata)
        stringy = isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        binary = isinstance(f.dataType, T.BinaryType) and kind is None
        out.append(
            ColumnPolicy(
                name=f.name,
                data_type=f.dataType,
                text=not (nested or binary),
                free_text=stringy and kind is None,
                kind=kind,
            )
        )
    return out


def overlay_rules(rules: Mapping[str, OverlayRule | str]) -> dict[str, OverlayRule]:
    """Rules by lower-cased, trimmed column name; blank names are dropped."""
    out = {}
    for name, rule in rules.items():
        key = name.strip().lower()
        if key:
            out[key] = rule if isinstance(rule, OverlayRule) else OverlayRule(token=rule)
    return out


def resolve_labels(
    labels: DataFrame | Sequence[PathLabel], object_id: str
) -> dict[str, PathLabel]:
    """Confirmed labels of one object by path; of several labels of one path the one that `one_label` takes.

    Only the rows of this object reach the driver: one per labelled field of one schema.
    """
    if not object_id:
        return {}
    if isinstance(labels, DataFrame):
        from hushframe.operators.labels import one_label

        own = labels.filter((F.col("object_id") == object_id) & F.col("source").isin(*CONFIRMED))
        rows = one_label(own).select("field_path", "profile", "category", "source", "match_mode").collect()
        found = [
            PathLabel(
                r["field_path"],
                r["profile"] or "",
                r["category"] or "",
                r["source"],
                r["match_mode"] or "path",
                object_id,
            )
            for r in rows
        ]
    else:
        found = [l for l in labels if l.object_id in ("", object_id) and l.source in CONFIRMED]
        # the last one of a path stands: a person's before the platform's, then the latest
        found.sort(key=lambda l: (l.source == "manual", l.updated_at is not None, l.updated_at or 0, l.profile, l.category, l.match_mode))
    return {l.field_path: l for l in found}


def make_object_id(org: str, driver: str, database: str, obj: str) -> str:
    """The id of a table known by name, same rule as functions.text.object_id."""
    name = driver.strip().lower()
    return f"{org}:{DRIVER_ALIASES.get(name, name)}:{database}:{obj}" if org else ""
