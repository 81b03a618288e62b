"""Toxicity with noisy-channel deobfuscation.

A word that looks disguised becomes a lattice over its characters: look-alikes (leetspeak) read as letters, signs
between letters drop out, runs of a character shrink to one or two. Single characters apart from each other are one
lattice, in which every space drops out or ends a word. Viterbi decoding finds the reading that is likeliest under a character model (interpolated 4-grams of
all words of the corpus) and the channel's costs. The restored words are scored by a logistic regression on the
presence of words and of their beginnings, fitted by follow-the-regularised-leader updates.

Labels are learned from at most `SAMPLE` labelled rows, chosen by a hash of their ids: a documented bound. Counts of
the character model are taken over all texts (a table of fixed size per task, added up). Scoring is one pass without
a shuffle.

Defined cases: null and empty texts have no words, their score is that of the bias; repeated ids with different
labels count by majority; without labelled rows every score is 0.5; all columns of the documents are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Lexicon, settled_labels, slices, sums, texts_of, word_hashes
from hushframe.llm.ftrl import SPARSE, fitted, labelled_sample

WIDTH = 1 << 18
SAMPLE = 12000
THRESHOLD = 0.3
OPTIONS = {"alpha": 0.2, "beta": 1.0, "l1": 0.3, "l2": 0.1, "epochs": 4}

#: Characters that stand for letters.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
BETWEEN = set(".-_*~,'`^/\\:;=#%&")
LOOK_COST, DROP_COST, RUN_COST, PAIR_COST, KEEP_COST = 0.7, 0.7, 1.0, 5.0, 4.0
#: Letters of the character model; accents are taken off, everything else is one symbol.
SYMBOLS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
OTHER, EDGE, BASE = 27, 0, 32
LAST_THREE = BASE**3 - 1
FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys")
#: The symbol of each character by its number; the last stands for all above.
POINTS = np.full(257, OTHER, np.int64)
POINTS[0] = EDGE
POINTS[[*map(ord, SYMBOLS), *FOLD]] = [*SYMBOLS.values(), *(SYMBOLS[chr(c)] for c in FOLD.values())]
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


TWICE = re.compile(r"(.)\1")
_CHARACTER = rb"(?:[\x21-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
#: Three characters apart from each other: only then a text has to be walked word by word.
APART = re.compile(rb"(?<!\S)" + _CHARACTER + rb"\s+" + _CHARACTER + rb"\s+" + _CHARACTER + rb"(?!\S)")


def _symbols(text: str) -> list[int]:
    return [SYMBOLS.get(c, OTHER) for c in (text if text.isascii() else text.translate(FOLD))]


def count_letters(words: list[str], times: np.ndarray) -> np.ndarray:
    """Counts of the 4-grams of symbols in the words, with their ends."""
    table = np.zeros(BASE**4, np.float64)
    lowered = "\n".join(words).lower().split("\n")  # words hold no white space
    plain = [(w, n) for w, n in zip((x.strip(EDGES) for x in lowered), times.tolist()) if w.isalpha()]
    if plain:
        # all words as one text, their ends as NUL
        line = "".join([f"\0\0\0{w}\0" for w, _ in plain])
        points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        flat = POINTS[np.minimum(points, len(POINTS) - 1)]
        weight = np.repeat([n for _, n in plain], [len(w) + 4 for w, _ in plain])
        four = ((flat[:-3] * BASE + flat[1:-2]) * BASE + flat[2:-1]) * BASE + flat[3:]
        # A window is inside one word if it does not end in that word's first two edges.
        ok = np.ones(len(four), bool)
        ends = np.cumsum([len(w) + 4 for w, _ in plain])[:-1]
        for j in (1, 2, 3):
            ok[ends - j] = False
        table += np.bincount(four[ok], weight[:-3][ok], len(table))
    return table


def letter_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """-log probability of a symbol after three others, interpolated over the shorter contexts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BASE**4)
        for batch in batches:
            for some in slices(batch.column(0)):
                words = pc.ascii_split_whitespace(pc.fill_null(some, "").cast(pa.large_string())).flatten().dictionary_encode()
                times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                total += count_letters(words.dictionary.to_pylist(), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["at", "n"])

    rows = docs.select(text).mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    # One row for each pair of 16 symbol pairs at most: the table has BASE**4 places whatever the input.
    packed = rows.groupBy(F.expr(f"at div {BASE**3}")).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    counts = np.zeros(BASE**4)
    for r in packed.collect():
        counts[np.array(r["at"], np.int64)] = r["n"]
    p = np.full((BASE,), 1 / 28)
    for order in (1, 2, 3, 4):
        n = counts.reshape(-1, BASE**order).sum(axis=0).reshape(-1, BASE)
        lower = np.broadcast_to(p, (BASE ** (order - 1) // max(1, p.size // BASE), *p.shape)).reshape(-1, BASE)
        p = (n + 5 * lower) / (n.sum(axis=1, keepdims=True) + 5)
    return -np.log(p.reshape(-1)).astype(np.float32)


def disguised(core: str) -> bool:
    """Has a letter and a sign or digit inside, a letter twice in a row, characters apart, or look-alikes only."""
    if " " in core:
        return True
    if core.isalpha():
        return TWICE.search(core) is not None
    letters = sum(c.isalpha() for c in core)
    if letters and letters < len(core):
        return any(c in LOOKS or c in BETWEEN for c in core) and letters + sum(c in LOOKS for c in core) >= 3
    if not letters:
        return len(core) >= 3 and all(c in LOOKS or c in BETWEEN for c in core) and sum(c in LOOKS for c in core) >= 3
    return TWICE.search(core) is not None


def run_lengths(word: str) -> list[int]:
    """How many equal characters follow from each place on, its own counted."""
    out = [1] * len(word)
    for i in range(len(word) - 2, -1, -1):
        if word[i] == word[i + 1]:
            out[i] = out[i + 1] + 1
    return out


@lru_cache(1 << 14)
def edges(c: str, run: int) -> list[tuple[int, str, tuple[int, ...], float]]:
    """The lattice's edges from a character that `run` equal ones begin with: length, letters, their symbols, cost."""
    if c == " ":
        return [(1, "", (), 0.0), (1, " ", (EDGE,), 0.0)]
    out = []
    for letter in (c, *LOOKS.get(c, "")):
        base = 0.0 if letter == c and c.isalpha() else LOOK_COST if letter != c else KEEP_COST
        out.append((1, letter, base))
        if run >= 2:
            out.append((run, letter, base + (RUN_COST if run >= 3 else PAIR_COST)))
        if run >= 3:
            out.append((run, letter * 2, base + RUN_COST))
    if c in BETWEEN:
        out.append((1, "", DROP_COST))
    return [(size, letters, tuple(_symbols(letters)), price) for size, letters, price in out]


def decode(word: str, cost: np.ndarray) -> str:
    """The likeliest reading of a word's lattice; a space is read as nothing or as the end of a word.

    A context is a number of three symbols; the cost of one more is looked up at context and symbol together.
    """
    costs = cost.data  # plain numbers come faster out of a buffer
    at: dict[int, dict[int, tuple]] = {0: {0: (0.0, None)}}  # place, context: cost and the way back
    n, runs = len(word), run_lengths(word)
    for i, c in enumerate(word):
        here = at.pop(i, None)
        if not here:
            continue
        run = runs[i] if i == 0 or word[i - 1] != c else 1
        states = list(here.items())
        for size, letters, symbols, price in edges(c, run):
            target = at.get(i + size)
            if target is None:
                target = at[i + size] = {}
            if len(symbols) == 1 and symbols[0]:
                s = symbols[0]
                for k, (so_far, back) in states:
                    k = k << 5 | s
                    total = so_far + price + costs[k]
                    k &= LAST_THREE
                    found = target.get(k)
                    if found is None or total < found[0]:
                        target[k] = (total, (letters, back))
                continue
            for k, (so_far, back) in states:
                total = so_far + price
                for s in symbols:
                    k = k << 5 | s
                    total += costs[k]
                    k = k & LAST_THREE if s else 0
                found = target.get(k)
                if found is None or total < found[0]:
                    target[k] = (total, (letters, back))
    best = min(at[n].items(), key=lambda x: x[1][0] + costs[x[0] * BASE])
    out, back = [], best[1][1]
    while back:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out))


def core_of(chunk: str) -> str:
    """A word without the punctuation around it; signs that begin or end it and may be letters stay."""
    if chunk.isalpha():
        return chunk.lower()
    if len(chunk) >= 3 and all(c in LOOKS for c in chunk):
        return chunk
    core = chunk.lower().lstrip("\"#%&'*,-./:;<=>?[\\]^_`}~").rstrip("\"#%&'()*,-./:;<=>?[\\]^_`{|}~!")
    trailing = re.search(r"([$@!|+])\1*$", core)
    return core[: trailing.start()] if trailing and len(trailing[0]) > 1 else core


def joined(text: bytes) -> list[bytes]:
    """The words of a text; runs of single characters, three or more of them no mere signs, are one item with spaces."""
    words = text.split()
    if APART.search(text) is None:
        return words
    out, run, count = [], [], 0
    for w in (*words, b""):
        c = w.decode("utf-8", "replace") if 1 <= len(w) <= 4 else ""
        if len(c) == 1 and (c.isalnum() or c in LOOKS or c in BETWEEN):
            run.append(w)
            count += c.isalnum() or c in LOOKS
            continue
        out += [b" ".join(run)] if count >= 3 else run
        run, count = [], 0
        if w:
            out.append(w)
    return out


#: Distinct items that a worker keeps the reading of: its copy of a broadcast lives through its tasks.
KEPT_ITEMS = 400_000


def restored(texts: list[bytes], cost: np.ndarray, known: dict[str, list[str]] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct restored words; each text's distinct ones as numbers, one text after another, and how many.

    `known` keeps what was read before.
    """
    known = {} if known is None else known
    if len(known) > KEPT_ITEMS:
        known.clear()
    # items with characters apart keep together by a sign that is no white space
    apart: dict[bytes, None] = {}
    lines = []
    for text in texts:
        if APART.search(text) is not None:
            items = joined(text)
            apart |= {x.replace(b" ", b"\0"): None for x in items if b" " in x}
            text = b"\n".join(items).replace(b" ", b"\0")
        lines.append(text)
    spaced = {x.decode(): None for x in apart}
    lists = pc.ascii_split_whitespace(pa.array(lines, pa.large_binary()).cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    ids, of = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    chunks = coded.dictionary.to_pylist()
    if "" in chunks:
        some = ids != chunks.index("")
        ids, of = ids[some], of[some]
    cores, number, length = Lexicon(), [], []
    for chunk in chunks:
        made = known.get(chunk)
        if made is None:
            core = core_of(chunk.replace("\0", " ") if chunk in spaced else chunk).strip()
            read = decode(core, cost) if disguised(core) else core
            made = known[chunk] = read.split() if " " in core else [read]
        number += [cores[x] for x in made]
        length.append(len(made))
    # An item of characters apart may be several words.
    flat, length = np.array(number, np.int64), np.array(length, np.int64)
    count = length[ids]
    at = np.repeat((np.cumsum(length) - length)[ids] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    words = flat[at]
    doc = np.repeat(of, count)
    pairs = np.sort(doc * max(1, len(cores)) + words)
    pairs = pairs[np.append(np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1])]
    return list(cores), pairs % max(1, len(cores)), np.bincount(pairs // max(1, len(cores)), minlength=len(texts))


def features(words: list[str]) -> np.ndarray:
    """Three numbers for each word: itself, and its first four and five characters."""
    raw = [[w.encode() for w in words], [w[:4].encode() for w in words], [w[:5].encode() for w in words]]
    return np.stack([(word_hashes(x, k) & np.uint64(WIDTH - 1)).astype(np.int64) for k, x in enumerate(raw, 11)], axis=1).reshape(-1, 3)


def _sparse(sent):
    @F.arrow_udf(SPARSE)
    def sparse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cost, known = sent.value
        for column in batches:
            rows = []
            for some in slices(column):
                words, ids, sizes = restored(texts_of(some), cost, known)
                at = features(words)
                for part in np.split(ids, np.cumsum(sizes)[:-1]):
                    number, count = np.unique(at[part], return_counts=True)
                    rows.append({"at": number.tolist(), "by": count.tolist()})
            yield pa.array(rows, pa.struct([("at", pa.list_(pa.int32())), ("by", pa.list_(pa.float32()))]))

    return sparse


def train(docs: DataFrame, labels: DataFrame, cost: np.ndarray, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    """Weights from the given labels; `sample` bounds the labelled rows that are used."""
    sent = docs.sparkSession.sparkContext.broadcast((cost, {}))
    rows = labelled_sample(docs, settled_labels(labels, doc_id, label), sample, doc_id, text)
    return fitted(rows.select("doc_id", "label", _sparse(sent)("text").alias("x")), WIDTH, **OPTIONS)


def score(spark, cost: np.ndarray, weights: np.ndarray, text: Column) -> Column:
    """Probability of label 1 for each text."""
    sent = spark.sparkContext.broadcast((cost, weights, {}))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cost, weights, known = sent.value
        for column in batches:
            made = [np.zeros(0)]
            for some in slices(column):
                words, ids, sizes = restored(texts_of(some), cost, known)
                each = weights.astype(np.float64)[features(words)].sum(axis=1)
                total = sums(each[ids], sizes) + weights[-1]
                made.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.array(np.concatenate(made))

    return scored(text)
