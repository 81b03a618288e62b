"""Language identification with bit-sliced Bloom filters of n-grams.

One filter serves all languages: every slot holds one bit per language, so the bitwise AND of an n-gram's slots gives
all languages that contain it. Every n-gram of a language's texts is in, however rare it is and however many others
use it; the filter has eight slots or more for each and is sent to the tasks whole.
A text's n-grams are counted per language, each divided by how many languages it has (popcounts). The part of the hits
that the filter's false positives explain (the share of set slots to the power of the probes) is taken off, and the
largest share decides. `told` says if that language's own n-grams are more than false positives explain (three
standard deviations); other languages, related or not, have no part in it.

N-grams have 3 to 5 characters of one lower-cased word and its ends. Counts are taken over all texts with a language.

Defined cases: a text that is null or has no letter is `und` with score 0; a text of unknown n-grams only gets the
most frequent language with score 0 and is not told; ties go to the language that sorts first; null languages are not learned;
without any learned language all are `und`; repeated rows count as they stand; all columns of the documents are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Lexicon, fmix, numbered, slices, sums, texts_of, written

ORDERS = (3, 4, 5)
PROBES = 3
SLICE = 1 << 14
PART_BYTES = 4 << 20  # of text that a worker looks at at a time
RESULT = "struct<lang:string,score:double,told:boolean>"


class Grams:
    """The n-grams of lower-cased chunks, one order at a time: hashes, and the chunk of each."""

    def __init__(self, chunks: list[bytes]):
        joined = " ".join(c.decode("utf-8", "replace") for c in chunks).lower()
        points = np.frombuffer(f" {joined}      ".encode("utf-32-le"), np.uint32)
        known, inverse = np.unique(points, return_inverse=True)
        self.letter = np.array([chr(c).isalpha() for c in known], bool)[inverse]
        self.chunk = (np.cumsum(points == 32) - 1).astype(np.int32)
        self.points = np.where(self.letter, points, np.uint32(0))
        has = np.zeros(len(chunks) + 8, bool)
        has[self.chunk[self.letter]] = True
        self.has_letter = has[: len(chunks)]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in ORDERS:
            last = len(self.points) - n + 1
            inner = self.letter[1 : 1 + last].copy()
            for j in range(2, n - 1):
                inner &= self.letter[j : j + last]
            at = np.flatnonzero(inner)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h *= np.uint64(0x100000001B3)
                h += self.points[at + j]
            yield fmix(h), self.chunk[at + 1]


def grams(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams' hashes and chunks, and which chunks have a letter."""
    found = Grams(chunks)
    parts = list(found)
    return np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]), found.has_letter


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for some in slices(batch.column(0), PART_BYTES):
            yield from _counts(texts_of(some), batch.column(1).slice(first, len(some)).to_pylist())
            first += len(some)


def _counts(texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon()
    ids, sizes = numbered([t.split() for t in texts], lexicon)
    names = sorted(set(langs))
    of = np.repeat(np.array([names.index(x) for x in langs], np.int64), sizes)
    by_lang = [np.bincount(ids[of == k], minlength=len(lexicon)) for k in range(len(names))]
    for hashes, owner in Grams(list(lexicon)):
        for name, times in zip(names, by_lang):
            some = times[owner] > 0
            gram, inverse = np.unique(hashes[some], return_inverse=True)
            n = np.bincount(inverse, weights=times[owner[some]], minlength=len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array([name] * len(gram), pa.string()), pa.array(n)], ["gram", "lang", "n"]
            )


class Filter:
    """The sliced filter: `slots[slot, word]` has one bit per language, 64 to a word; few languages take less."""

    def __init__(self, langs: list[str], prior: str, slots: np.ndarray):
        for bits, kind in ((8, np.uint8), (16, np.uint16), (32, np.uint32)):
            if len(langs) <= bits:
                slots = slots.astype(kind)
                break
        self.langs, self.prior, self.slots = langs, prior, slots
        filled = [_bit(slots, i).mean() for i in range(len(langs))]
        self.false = np.array(filled) ** PROBES


def _bit(masks: np.ndarray, language: int) -> np.ndarray:
    """Which rows of masks have a language's bit."""
    word = masks[:, language // 64]
    return (word >> word.dtype.type(language % 64)) & word.dtype.type(1) == 1


def _probes(hashes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    first, step = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return (((first + np.uint64(j) * step) & np.uint64(slots - 1)).astype(np.int64) for j in range(PROBES))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filter:
    """The filter of all texts with a language."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.coalesce(F.col(text), F.lit("")), F.col(lang).cast("string"))
    counts = rows.mapInArrow(_counted, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = written(counts, "language")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filter([], "und", np.zeros((SLICE, 1), np.uint64))
    prior = max(langs, key=lambda x: totals[x])
    number = F.create_map(*[F.lit(v) for i, x in enumerate(langs) for v in (x, i)])
    sets = written(counts.groupBy("gram").agg(F.collect_list(number[F.col("lang")]).alias("i")), "language")
    slots = max(SLICE, 1 << math.ceil(math.log2(8 * max(1, sets.count()))))
    low, high = F.col("gram").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("gram", 32)
    probes = F.array(*[(low + j * high).bitwiseAND(slots - 1) for j in range(PROBES)])
    bits = (
        sets.select(F.explode(probes).alias("slot"), "i")
        .select("slot", F.explode("i").alias("i"))
        .select("slot", F.expr("i div 64").alias("word"), (F.col("i") % 64).alias("bit"))
        .select("slot", "word", F.expr("shiftleft(1L, bit)").alias("mask"))
        .groupBy("slot", "word")
        .agg(F.bit_or("mask").alias("mask"))
    )
    words = -(-len(langs) // 64)

    def sliced(group: pa.Table) -> pa.Table:
        slot = group.column("slot").to_numpy()
        out = np.zeros((SLICE, words), np.uint64)
        out[slot % SLICE, group.column("word").to_numpy()] = group.column("mask").to_numpy().view(np.uint64)
        return pa.table({"slice": pa.array([int(slot[0]) // SLICE], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    found = bits.groupBy(F.expr(f"slot div {SLICE}")).applyInArrow(sliced, "slice long, bits binary").collect()
    table = np.zeros((slots, words), np.uint64)
    for r in found:
        table[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["bits"], np.uint64).reshape(SLICE, words)
    return Filter(langs, prior, table)


def decide(texts: list[bytes], f: Filter) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and `told` of each text."""
    lexicon = Lexicon()
    ids, sizes = numbered([t.split() for t in texts], lexicon)
    found = Grams(list(lexicon))
    letters = sums(found.has_letter[ids].astype(np.int64), sizes) > 0
    if not f.langs:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    n = len(lexicon)
    count, hits, parts = np.zeros(n, np.int64), np.zeros((len(f.langs), n), np.int64), np.zeros((len(f.langs), n))
    for hashes, owner in found:
        masks = None
        for slots in _probes(hashes, len(f.slots)):
            masks = f.slots[slots] if masks is None else masks & f.slots[slots]
        count += np.bincount(owner, minlength=n)
        part = 1 / np.maximum(1, np.bitwise_count(masks).sum(axis=1, dtype=np.int64))
        for i in range(len(f.langs)):
            some = np.flatnonzero(_bit(masks, i))
            hits[i] += np.bincount(owner[some], minlength=n)
            parts[i] += np.bincount(owner[some], part[some], minlength=n)
    all_ = sums(count[ids], sizes)
    share, told = np.zeros((len(texts), len(f.langs))), np.zeros((len(texts), len(f.langs)), bool)
    for i in range(len(f.langs)):
        hit, false = sums(hits[i][ids], sizes), f.false[i]
        true = np.maximum(0, (hit - all_ * false) / max(1e-9, 1 - false))
        share[:, i] = sums(parts[i][ids], sizes) * true / np.maximum(hit, 1)
        told[:, i] = hit > all_ * false + 3 * np.sqrt(all_ * false * (1 - false))
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    score = share[np.arange(len(texts)), best] / np.where(total > 0, total, 1)
    names = [f.langs[b] if t > 0 else f.prior for b, t in zip(best, total)]
    told = told[np.arange(len(texts)), best] & letters
    return [x if ok else "und" for x, ok in zip(names, letters)], np.where(letters, score, 0.0), told


def identify(spark, f: Filter, text: Column) -> Column:
    """A struct of the language, the score and `told` for each text."""
    sent = spark.sparkContext.broadcast(SimpleNamespace(**vars(f)))

    @F.arrow_udf(RESULT)
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            names, scores, told = [], [np.zeros(0)], [np.zeros(0, bool)]
            for some in slices(column, PART_BYTES):
                found, score, ok = decide(texts_of(some), sent.value)
                names += found
                scores.append(score)
                told.append(ok)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(told))], ["lang", "score", "told"])

    return identified(text)
