"""Sample values per field and turn the samples into label proposals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.text import inline_rows, let
from hushframe.operators import detect
from hushframe.plans.policy import classify_columns

MAX_SAMPLES = 20

Classifier = Callable[[str, str, Sequence[str]], tuple[str, str, float] | None]

TAXONOMY = ("email_fields", "ssn_fields", "phone_fields", "dob_fields")
#: Names that speak for a category, as a part of a field's name or all of it without separators.
NAME_PARTS = {
    "email_fields": ("email", "emails", "mail", "mailbox"),
    "ssn_fields": ("ssn", "socialsecurity", "socialsecuritynumber"),
    "phone_fields": ("phone", "phones", "tel", "telephone", "mobile", "fax"),
    "dob_fields": ("dob", "birthday", "birthdate", "dateofbirth", "born"),
}
#: Patterns of the content detection that speak for a category when samples hold them.
VALUE_PATTERNS = {"email_fields": detect.EMAIL, "ssn_fields": detect.SSN, "phone_fields": detect.PHONE}
NAME_WEIGHT, SHARE_WEIGHT, SHARE_ALONE = 0.6, 0.4, 0.9


def field_values(df: DataFrame, object_id: str, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per non-null free-text value: object_id, field_path, value and the order columns."""
    names = [c.name for c in classify_columns(df.schema) if c.free_text and c.name not in order_by]
    pairs = F.array(
        *[F.struct(F.lit(n).alias("field_path"), F.col(f"`{n}`").cast("string").alias("value")) for n in names]
    )
    present = F.filter(pairs, lambda p: p["value"].isNotNull())
    return inline_rows(df, [F.lit(object_id).alias("object_id"), *order_by], present, "field_path")


def first_values(
    values: DataFrame, order_by: Sequence[str], n: int = MAX_SAMPLES, drop_blank: bool = False
) -> DataFrame:
    """First `n` values of every field in order, as an array.

    The rank filter is applied before the shuffle as well, so a field sends at most `n` rows per task.
    """
    rows = values.filter(F.col("value") != "") if drop_blank else values
    order = [F.col(c) for c in order_by] + [F.col("value")]
    rank = F.row_number().over(Window.partitionBy("object_id", "field_path").orderBy(*order))
    kept = rows.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    samples = F.array_sort(F.collect_list(F.struct("_rank", "value")))
    return kept.groupBy("object_id", "field_path").agg(
        F.transform(samples, lambda s: s["value"]).alias("samples")
    )


def sample_fields(
    df: DataFrame, object_id: str, n: int = MAX_SAMPLES, order_by: Sequence[str] = (), drop_blank: bool = False
) -> DataFrame:
    """object_id, field_path, samples for every free-text column that has a value."""
    return first_values(field_values(df, object_id, order_by), order_by, n, drop_blank)


def classification_prompt(samples: DataFrame, taxonomy: Sequence[str] = TAXONOMY) -> DataFrame:
    """Add `prompt`, the question a language model is asked about a field."""
    lines = F.array_join(F.transform("samples", lambda s: F.concat(F.lit("- "), s, F.lit("\n"))), "")
    # The question's words.
    prompt = F.concat(
        F.lit("You are classifying a database field for personally identifiable information (PII).\n"),
        F.lit("Table/collection: "),
        F.col("object_id"),
        F.lit("\nField path: "),
        F.col("field_path"),
        F.lit("\nSample values:\n"),
        lines,
        F.lit('Pick exactly one category from this list, or "none" if none apply: '),
        F.lit(", ".join(taxonomy)),
        F.lit(
            '\nRespond with a single JSON object: {"category": "...", "profile": "...", '
            '"confidence": 0.0-1.0, "rationale": "..."}\n'
        ),
    )
    return samples.withColumn("prompt", prompt)


def accept_classification(
    df: DataFrame, taxonomy: Sequence[str] = TAXONOMY, min_samples: int = 1, min_confidence: float = 0.5
) -> DataFrame:
    """Answers good enough to become a proposal."""
    return df.filter(
        (F.size("samples") >= max(min_samples, 1))
        & F.col("category").isin(*taxonomy)
        & (F.col("confidence") >= min_confidence)
    )


def rule_answer(field_path: Column, samples: Column) -> Column:
    """The default classifier as one expression: what the name says and the share of samples with a find.

    A category's confidence is 0.6 for its name plus 0.4 times the share of samples that content detection finds
    it in, or 0.9 times that share if that is more. The surest category wins, the first in TAXONOMY on a tie.
    """
    last = F.substring_index(field_path, ".", -1)
    spaced = F.regexp_replace(last, "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(F.lower(spaced), "[^a-z0-9]+")
    spoken = F.array_append(parts, F.array_join(parts, ""))

    def confidence(category: str) -> Column:
        named = F.arrays_overlap(spoken, F.array(*[F.lit(n) for n in NAME_PARTS[category]]))
        by_name = F.when(named, F.lit(NAME_WEIGHT)).otherwise(F.lit(0.0))
        pattern = VALUE_PATTERNS.get(category)
        if pattern is None:
            return by_name
        share = F.size(F.filter(samples, lambda s: s.rlike(pattern))) / F.greatest(F.size(samples), F.lit(1))
        return F.greatest(by_name + share * SHARE_WEIGHT, share * SHARE_ALONE)

    answers = [
        F.struct(F.round(confidence(c), 6).alias("confidence"), F.lit(-i).alias("rank"), F.lit(c).alias("category"))
        for i, c in enumerate(TAXONOMY)
    ]

    def answer(best: Column) -> Column:
        found = best["confidence"] > 0
        return F.struct(
            F.when(found, best["category"]).otherwise(F.lit("none")).alias("category"),
            F.when(found, F.lit("full_redact")).otherwise(F.lit("")).alias("profile"),
            best["confidence"].alias("confidence"),
        )

    return let(F.array_max(F.array(*answers)), answer)


def _run_classifier(samples: DataFrame, classifier: Classifier) -> DataFrame:
    """Ask a plugged-in classifier about each field; an error means no answer."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for row in pdf.itertuples(index=False):
                try:
                    answers.append(classifier(row.object_id, row.field_path, list(row.samples)) or (None, None, None))
                except Exception:
                    answers.append((None, None, None))
            pdf = pdf[["object_id", "field_path", "samples"]].copy()
            pdf["category"] = [a[0] for a in answers]
            pdf["profile"] = [a[1] for a in answers]
            pdf["confidence"] = pd.Series([a[2] for a in answers], dtype="float64", index=pdf.index)
            yield pdf

    schema = "object_id string, field_path string, samples array<string>, category string, profile string, confidence double"
    return samples.select("object_id", "field_path", "samples").mapInPandas(ask, schema)


def classify_fields(
    samples: DataFrame,
    classifier: Classifier | None = None,
    taxonomy: Sequence[str] = TAXONOMY,
    min_samples: int = 1,
    min_confidence: float = 0.5,
) -> DataFrame:
    """Proposals for sampled fields: object_id, field_path, category, profile, confidence, sample_count."""
    if classifier is None:
        answered = samples.withColumn("_a", rule_answer(F.col("field_path"), F.col("samples"))).select(
            "object_id", "field_path", "samples", "_a.*"
        )
    else:
        answered = _run_classifier(samples, classifier)
    named = (F.coalesce("object_id", F.lit("")) != "") & (F.coalesce("field_path", F.lit("")) != "")
    good = accept_classification(answered.filter(named), taxonomy, min_samples, min_confidence)
    return good.select(
        "object_id",
        "field_path",
        "category",
        "profile",
        "confidence",
        F.size("samples").cast("bigint").alias("sample_count"),
    )


def classification_summary(fields: DataFrame, proposals: DataFrame) -> DataFrame:
    """Fields looked at and labels proposed, per object."""
    key = ["object_id", "field_path"]
    hit = proposals.select(*key).distinct().withColumn("_hit", F.lit(1))
    return (
        fields.select(*key)
        .distinct()
        .join(hit, key, "left")
        .groupBy("object_id")
        .agg(
            F.count(F.lit(1)).alias("fields_scanned"),
            F.count("_hit").alias("labels_proposed"),
        )
    )
