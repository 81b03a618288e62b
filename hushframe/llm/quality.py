"""Quality classifier: hashed word n-grams, logistic regression with follow-the-regularised-leader updates.

Features of a text are its words (white space parts them) and pairs of neighbouring words, once lower-cased without
the punctuation around them and once as shapes (letters and digits by kind, runs cut to two, punctuation as it is;
a pair of shapes also says if the words are the same). They are hashed to `WIDTH` numbers; their values are
relative frequencies. Scoring is one sparse dot product per text, in one pass without a shuffle.

Labels are learned from at most `SAMPLE` labelled rows, chosen by a hash of their ids: a documented bound. Texts are
read whole everywhere.

Defined cases: null and empty texts have no features, their score is that of the bias; repeated ids with different
labels count by majority; without labelled rows every score is 0.5; all columns of the documents are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Lexicon, fmix, numbered, settled_labels, slices, sums, texts_of, word_hashes
from hushframe.llm.ftrl import SPARSE, fitted, labelled_sample

WIDTH = 1 << 18
SAMPLE = 6000
SCALE = 10.0
THRESHOLD = 0.3
OPTIONS = {"alpha": 0.3, "beta": 1.0, "l1": 0.05, "l2": 0.1, "epochs": 4}


def _shape(chunk: str) -> str:
    kinds = "".join(
        "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in re.sub(r"(.)\1{2,}", r"\1\1", chunk)
    )
    return re.sub(r"(.)\1{2,}", r"\1\1", kinds)


def features(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Four feature numbers for each word, and the number of words of each text."""
    lexicon = Lexicon()
    ids, sizes = numbered([t.split() for t in texts], lexicon)
    chunks = [w.decode("utf-8", "replace") for w in lexicon]
    cores = [c.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for c in chunks]
    core = word_hashes([c.encode() for c in cores], 1)[ids]
    shape = word_hashes([_shape(c).encode() for c in chunks], 2)[ids]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before_core, before_shape = np.roll(core, 1), np.roll(shape, 1)
    before_core[starts] = before_shape[starts] = 0
    pair = np.uint64(0x9E3779B97F4A7C15)
    same = (before_core == core).astype(np.uint64)
    made = [core, fmix(before_core * pair + core), shape, fmix(before_shape * pair + shape + same)]
    return np.stack([(x & np.uint64(width - 1)).astype(np.int32) for x in made], axis=1), sizes


def sparse(text: Column) -> Column:
    """Feature numbers and values of each text."""

    @F.arrow_udf(SPARSE)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = []
            for some in slices(column):
                at, sizes = features(texts_of(some), WIDTH)
                for part in np.split(at, np.cumsum(sizes)[:-1]):
                    number, count = np.unique(part, return_counts=True)
                    rows.append({"at": number.tolist(), "by": (count * (SCALE / max(1, len(part)))).tolist()})
            yield pa.array(rows, pa.struct([("at", pa.list_(pa.int32())), ("by", pa.list_(pa.float32()))]))

    return made(text)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights from the given labels; `sample` bounds the labelled rows that are used."""
    rows = labelled_sample(docs, settled_labels(labels, doc_id, label), sample, doc_id, text)
    return fitted(rows.select("doc_id", "label", sparse(F.col("text")).alias("x")), WIDTH, **OPTIONS)


def score(spark, weights: np.ndarray, text: Column) -> Column:
    """Probability of label 1 for each text."""
    sent = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value.astype(np.float64)
        for column in batches:
            made = [np.zeros(0)]
            for some in slices(column):
                at, sizes = features(texts_of(some), WIDTH)
                total = sums(w[at].sum(axis=1), sizes) * SCALE / np.maximum(sizes, 1) + w[-1]
                made.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.array(np.concatenate(made))

    return scored(text)
