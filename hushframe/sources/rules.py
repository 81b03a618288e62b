"""Read rule files: overlay, recognizers, anonymizers, lists."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.plans.policy import Anonymizer, OverlayRule, Recognizer

OVERLAY_SCHEMA = "role_id string, column_name string, token string, partial boolean"
RECOGNIZER_SCHEMA = "entity string, pattern_name string, regex string, score double, context array<string>"


def read_text(spark: SparkSession, path: str) -> str:
    """A small rule file from any store Spark can reach."""
    return spark.read.text(path, wholetext=True).first()[0]


def _parse(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML rules need the yaml package; JSON works without it") from e
    return yaml.safe_load(text)


def overlay_from_text(text: str) -> dict[str, OverlayRule]:
    """A string is a token, `{partial_mask: true}` a partial mask; any other shape skips its key."""
    out = {}
    for name, value in (_parse(text) or {}).items():
        if isinstance(value, str):
            out[str(name)] = OverlayRule(token=value)
        elif isinstance(value, dict) and value.get("partial_mask") is True:
            out[str(name)] = OverlayRule(partial=True)
    return out


def recognizers_from_text(inline: str = "", file_text: str = "") -> list[Recognizer]:
    """Recognizers of the registry shape; inline text wins over the file."""
    text = inline or file_text
    found = (_parse(text) or {}).get("recognizers", []) if text else []
    return [
        Recognizer(
            r["supported_entity"], p["regex"], float(p["score"]), context=tuple(r.get("context") or ()), language=r.get("supported_language")
        )
        for r in found
        for p in r.get("patterns", [])
    ]


def anonymizers_from_text(text: str) -> dict[str, Anonymizer]:
    """Rewriting rules by entity; unreadable text gives none."""
    try:
        raw = json.loads(text)
    except ValueError:
        return {}
    known = Anonymizer.__dataclass_fields__
    return {entity: Anonymizer(**{k: v for k, v in rule.items() if k in known}) for entity, rule in raw.items()}


def entities_from_text(text: str) -> list[str]:
    return [p.strip().upper() for p in text.split(",") if p.strip()]


def allow_list_from_text(text: str) -> list[str]:
    """Entries keep their case: they are values or patterns."""
    return [p.strip() for p in text.split(",") if p.strip()]


def load_rules(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """Rules as a table. Kinds: overlay, recognizers, entities, allow_list."""
    if kind == "overlay":
        rows = [("", n.strip().lower(), r.token, r.partial) for n, r in overlay_from_text(text).items() if n.strip()]
        return spark.createDataFrame(rows, OVERLAY_SCHEMA)
    if kind == "recognizers":
        rows = [
            (r["supported_entity"], p.get("name"), p["regex"], float(p["score"]), r.get("context"))
            for r in (_parse(text) or {}).get("recognizers", [])
            for p in r.get("patterns", [])
        ]
        return spark.createDataFrame(rows, RECOGNIZER_SCHEMA)
    if kind == "entities":
        return spark.createDataFrame([(e,) for e in entities_from_text(text)], "entity string")
    if kind == "allow_list":
        return spark.createDataFrame([(e,) for e in allow_list_from_text(text)], "text string")
    raise ValueError(f"unknown kind of rules: {kind}")


def role_rules(overlay_rules: DataFrame) -> dict[str, dict[str, str]]:
    """Overlay rows with a role, as role -> column -> token. One row per rule a person wrote."""
    rows = overlay_rules.filter(F.coalesce("role_id", F.lit("")) != "").select("role_id", "column_name", "token")
    out: dict[str, dict[str, str]] = {}
    for r in rows.collect():
        out.setdefault(r["role_id"], {})[r["column_name"]] = r["token"]
    return out
