"""Scalar column expressions: partial masking, identifiers, rendering, small helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of the same source system.
DRIVER_ALIASES = {"postgresql": "postgres", "mongodb": "mongo"}

KEEP_LAST = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times inside `body`."""
    return F.transform(F.array(value), body)[0]


def inline_rows(df: DataFrame, keep: list, rows: Column, never_null: str) -> DataFrame:
    """One row per struct of an array, beside the kept columns. `never_null` names a field of the struct.

    The array is a column of its own first: a generator over nested fields can lose columns to the
    optimizer. The outer form with a filter behind it keeps the optimizer from testing the size of the
    array below, which would compute the array once more per test.
    """
    staged = df.select(*keep, rows.alias("rows_"))
    kept = [F.col(f"`{c}`") for c in staged.columns[:-1]]
    return staged.select(*kept, F.inline_outer("rows_")).filter(F.col(never_null).isNotNull())


def strip(col: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.regexp_replace(col, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def lowered(col: Column) -> Column:
    """Lower case. Inside lambdas that asks the Unicode library, at many times the cost of seeing that nothing is to do."""
    return F.when(col.rlike(r"\A[\x00-@\[-\x7F]*\z"), col).otherwise(F.lower(col))


def partial_mask(col: Column, keep: int = KEEP_LAST, char: str = "*") -> Column:
    """Keep the last characters and cover the rest; short values are covered whole."""
    size = F.char_length(col)
    tail = F.when(size > keep, F.right(col, F.lit(keep))).otherwise(F.lit(""))
    covered = F.when(size > keep, size - keep).otherwise(size)
    return F.concat(F.repeat(F.lit(char), covered), tail)


def eligible(col: Column, min_len: int = 4) -> Column:
    """True for values long enough (in bytes) for content detection."""
    return F.coalesce(F.octet_length(col) >= min_len, F.lit(False))


def normal_driver(driver: Column) -> Column:
    name = F.lower(strip(driver))
    out = F.when(F.lit(False), name)
    for alias, driver_name in DRIVER_ALIASES.items():
        out = out.when(name == alias, F.lit(driver_name))
    return out.otherwise(name)


def object_id(org: Column, driver: Column, database: Column, obj: Column) -> Column:
    """`org:driver:database:object`; an empty organisation gives an empty id."""
    joined = F.concat_ws(":", org, normal_driver(driver), database, obj)
    return F.when(F.coalesce(org, F.lit("")) == "", F.lit("")).otherwise(joined)


def parse_object_id(col: Column) -> Column:
    """Read (driver, database, object) from the right; null when there are fewer than four parts."""
    parts = F.split(col, ":")
    return F.when(
        F.size(parts) >= 4,
        F.struct(
            F.element_at(parts, -3).alias("driver"),
            F.element_at(parts, -2).alias("database"),
            F.element_at(parts, -1).alias("object"),
        ),
    )


def connection_key(driver: Column, role: Column) -> Column:
    return F.concat(F.lower(strip(driver)), F.lit("__"), strip(role))


def connection_driver(key: Column) -> Column:
    return F.split_part(key, F.lit("__"), F.lit(1))


def query_path(path: Column) -> Column:
    """Index-erased path to the plain dotted path a document filter takes."""
    return F.replace(path, F.lit("[]"), F.lit(""))


def render_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """`a=1, b=NULL`; a column without a name is shown as `col{i}`."""
    pieces = []
    for i, name in enumerate(columns if columns is not None else df.columns):
        shown = name if name else f"col{i}"
        value = F.coalesce(df[name].cast("string"), F.lit("NULL"))
        pieces.append(F.concat(F.lit(f"{shown}="), value))
    return F.concat_ws(", ", *pieces) if pieces else F.lit("")


# Bytes a number, flag or time takes in a stored document.
_DOC_WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 4,
    T.ShortType: 4,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 8,
    T.DoubleType: 8,
    T.DecimalType: 16,
    T.DateType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
}


def render_doc(col: Column, doc_type: T.StructType) -> Column:
    """Top-level fields of a document on one line; nested parts are only named."""
    pieces = []
    for field in doc_type.fields:
        value = col.getField(field.name)
        kind = field.dataType
        if isinstance(kind, T.StringType):
            shown = value
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            shown = F.lit("<nested>")
        elif isinstance(kind, T.BinaryType):
            # length prefix and subtype byte are stored with the bytes
            shown = F.concat(F.lit("<"), (F.octet_length(value) + 5).cast("string"), F.lit(" bytes>"))
        else:
            shown = F.lit(f"<{_DOC_WIDTH.get(type(kind), 8)} bytes>")
        pieces.append(
            F.concat(F.lit(f"{field.name}="), F.when(value.isNull(), F.lit("NULL")).otherwise(shown))
        )
    return F.concat_ws(", ", *pieces)


def clip_bytes(col: Column, size: int) -> Column:
    """First `size` bytes of a text; a character cut in half is left out."""

    def cut(n: int) -> Column:
        return F.try_validate_utf8(F.substring(col.cast("binary"), 1, n).cast("string"))

    # a UTF-8 character has at most four bytes
    return F.coalesce(*[cut(max(size - k, 0)) for k in range(4)])


def request_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, joined by NUL so that no two splits collide."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def iso_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def clamp(col: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def sorted_unique(col: Column) -> Column:
    return F.array_sort(F.array_distinct(col))
