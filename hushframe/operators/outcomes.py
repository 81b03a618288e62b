"""What masking one value adds to the counts, as arrays of structs beside the masked value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSPECIFIED = "UNSPECIFIED"
OTHER = "OTHER"
RECOGNIZER = "recognizer"
FIELD_RULE = "field_rule"
OUTCOMES = "array<struct<entity_type:string,detection_source:string,count_analyzed:bigint,count_masked:bigint,bytes_masked:bigint>>"


def outcome(entity: Column, source: str, analyzed: Column | int, masked: int, size: Column) -> Column:
    return F.struct(
        entity.alias("entity_type"),
        F.lit(source).alias("detection_source"),
        F.lit(analyzed).cast("bigint").alias("count_analyzed"),
        F.lit(masked).cast("bigint").alias("count_masked"),
        size.cast("bigint").alias("bytes_masked"),
    )


def no_outcomes() -> Column:
    return F.array().cast(OUTCOMES)


def looked_at(source: str, values: Column | int = 1) -> Column:
    """One outcome for so many values; none for no value."""
    one = F.array(outcome(F.lit(UNSPECIFIED), source, values, 0, F.lit(0)))
    return one if isinstance(values, int) else F.when(values > 0, one).otherwise(no_outcomes())


def of_detection(found: Column) -> Column:
    """Outcomes of one entry of `detect.found_texts`: one per eligible text and one per span."""
    spans = F.transform(found["spans"], lambda s: outcome(s["entity_type"], RECOGNIZER, 0, 1, s["size"]))
    return F.when(found["looked"], F.concat(looked_at(RECOGNIZER), spans)).otherwise(no_outcomes())


def of_label(value: Column, acts: Column, category: Column) -> Column:
    """Outcomes of looking up the label of one value; `value` is what the layers before left of it."""
    hit = F.array(outcome(category, FIELD_RULE, 0, 1, F.octet_length(value.cast("string"))))
    found = F.when(acts, F.concat(looked_at(FIELD_RULE), hit)).otherwise(looked_at(FIELD_RULE))
    return F.when(value.isNotNull(), found).otherwise(no_outcomes())
