"""Benchmark decontamination with suffix arrays over the training text.

Every Arrow batch of documents is one shard. Its words become numbers, its suffixes a suffix array (sorted by as
many words as a window has), and every suffix of the test items is binary-searched in it. Windows that follow each
other on the same diagonal are joined to the longest verbatim match. There is no shuffle: the test set is the
stated query set; it is cut into parts of bounded size, each of which is sent to the tasks in turn.

Defined cases: null and empty texts have no words; items without id or words are left out; repeated items and
documents each count as they stand; an empty benchmark hits nothing; all columns of the documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import texts_of

WINDOW = 10
PART_BYTES = 16 << 20
SPANS = "array<struct<item_id:string,start:long,length:long>>"
RESULT = f"struct<n_words:long,n_hit:long,spans:{SPANS}>"

#: Letters A-Z become small, digits, a-z and all bytes of other characters stay, the rest parts words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class TestPart:
    """The windows of some test items as numbers."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        self.window, rows, lengths, self.item, self.at = window, [], [], [], []
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                rows.append(ids[i : i + m] + [0] * (window - m))
                lengths.append(m)
                self.item.append(item)
                self.at.append(i)
        self.rows = np.array(rows, np.int64).reshape(-1, window)
        self.lengths, self.at = np.array(lengths, np.int64), np.array(self.at, np.int64)
        names = sorted(set(self.item))
        self.names, place = names, {x: i for i, x in enumerate(names)}
        self.item = np.array([place[x] for x in self.item], np.int64)


def suffix_array(t: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The given suffixes of `t`, sorted by their first `window` numbers; `t` goes on for a window behind them."""
    bits = max(1, int(t.max()).bit_length())
    each = max(1, 62 // bits)
    keys = []
    for first in range(0, window, each):
        key = np.zeros(len(starts), np.int64)
        for j in range(first, min(first + each, window)):
            key = (key << bits) | t[starts + j]
        keys.append(key)
    return starts[np.lexsort(keys[::-1])]


def bound(t: np.ndarray, array: np.ndarray, part: TestPart, upper: bool) -> np.ndarray:
    """For every test suffix, the first place in the suffix array not below it (or above it)."""
    n, step = len(part.rows), np.arange(part.window)
    low, high, counts = np.zeros(n, np.int64), np.full(n, len(array), np.int64), step < part.lengths[:, None]
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        there, q = t[array[middle][:, None] + step], part.rows[open_]
        differs = (there != q) & counts[open_]
        j, some, k = differs.argmax(1), differs.any(1), np.arange(len(open_))
        right = np.where(some, there[k, j] < q[k, j], upper)
        low[open_] = np.where(right, middle + 1, low[open_])
        high[open_] = np.where(right, high[open_], middle)
    return low


def longest_matches(texts: list[bytes], part: TestPart) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Words per text, and (text, item, start, length) of the longest verbatim matches."""
    get, sizes, flat = part.number.get, np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        found = words(text)
        sizes[i] = len(found)
        flat.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
        flat.append(np.zeros(1, np.int64))  # no match goes past the end of a text
    t = np.concatenate([*flat, np.zeros(part.window, np.int64)])
    none = [np.zeros(0, np.int64)] * 4
    if not len(part.rows):
        return sizes, none
    # Only a suffix that begins with enough known words can match a window.
    gaps = np.flatnonzero(t == 0)
    runs = gaps[np.searchsorted(gaps, np.arange(len(t)))] - np.arange(len(t))
    array = suffix_array(t, np.flatnonzero(runs >= part.lengths.min()), part.window)
    low, high = bound(t, array, part, False), bound(t, array, part, True)
    counts = high - low
    if not counts.any():
        return sizes, none
    which = np.repeat(np.arange(len(counts)), counts)
    place = array[np.repeat(low, counts) + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)]
    item, ends = part.item[which], place + part.lengths[which]
    diagonal = place - part.at[which]
    order = np.lexsort((place, diagonal, item))
    place, ends, item, diagonal = place[order], ends[order], item[order], diagonal[order]
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    start, end = place[first], np.maximum.reduceat(ends, first)
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return sizes, [doc, item[first], start - offsets[doc], end - start]


def covered(n: int, spans: list[dict]) -> int:
    mark = np.zeros(n + 1, np.int64)
    for s in spans:
        mark[s["start"]] += 1
        mark[s["start"] + s["length"]] -= 1
    return int((np.cumsum(mark[:n]) > 0).sum())


def _search(part):
    """A column function of (text, spans of the parts before)."""

    @F.arrow_udf(RESULT)
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, before in batches:
            sizes, (doc, item, start, length) = longest_matches(texts_of(column), part.value)
            spans = [x or [] for x in before.to_pylist()]
            for d, i, s, n in sorted(zip(doc.tolist(), item.tolist(), start.tolist(), length.tolist())):
                spans[d].append({"item_id": part.value.names[i], "start": s, "length": n})
            hit = [covered(n, s) if s else 0 for n, s in zip(sizes.tolist(), spans)]
            made = pa.array(spans, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))
            yield pa.StructArray.from_arrays([pa.array(sizes), pa.array(hit, pa.int64()), made], ["n_words", "n_hit", "spans"])

    return search


def verbatim_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    result: str = "matches",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Documents with a struct `result`: n_words, n_hit and the longest verbatim matches (item, first word, words).

    Items shorter than `window` words are matched whole. `part_bytes` bounds what is sent to the tasks at once.
    """
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")
    )
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    spans: Column = F.lit(None).cast(SPANS)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).distinct().orderBy("i", "t").collect()
        part = TestPart([(r["i"], r["t"].encode()) for r in rows], window)
        sent = docs.sparkSession.sparkContext.broadcast(SimpleNamespace(**vars(part)))
        docs = docs.withColumn(result, _search(sent)(F.col(text), spans))
        spans = F.col(f"{result}.spans")
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that share no window with the benchmark, with the columns they came with."""
    name = "matches"
    while name in docs.columns:
        name += "_"
    found = verbatim_matches(docs, benchmark, text, result=name, **options)
    return found.where(F.col(name)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
