"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.session import shared_folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Lexicon(dict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def numbered(lists: list[list[bytes]], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The lists' items as numbers of the lexicon, one after another, and each list's length."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(sizes.sum())
    return np.fromiter((n for x in lists for n in map(lexicon.__getitem__, x)), np.int64, total), sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of `sizes` values; 0 for empty runs."""
    out, some = np.zeros((len(sizes), *values.shape[1:]), values.dtype), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(column: pa.Array, most: int = 8 << 20) -> Iterator[pa.Array]:
    """The texts in runs of at most `most` bytes (a longer text alone), to bound what a worker holds at a time."""
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(column), 0), np.int64))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield column.slice(first, last - first)
        first = last


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte string."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read back: a cut that survives lost executors. What the write
    shuffled leaves the disks with it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def settled_labels(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """One 0/1 label per id: the majority of its rows, 1 on a tie; null ids and labels are left out."""
    return (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    )
