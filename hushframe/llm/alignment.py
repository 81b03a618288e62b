"""Tokens of two tokenizers aligned by their bytes.

`align(docs, byte_bpe, piece_bpe)` gives one row per document: how many tokens each side has, the groups that the common
ends of both sides cut, the links (pairs of tokens that share a byte) and how often the linked ids are linked in the
whole corpus. `groups` spells the groups out (`a1,a2|b1;a3|b2,b3`) where asked for.

Groups come by pointer jumping: every token points to the token that reaches farthest right among those it overlaps
(among equal ends the second side's), the last of each group to itself; pointers are doubled, all tokens of a batch at
once, until nothing changes, and the token reached names the group.

Both sides part a text before a space that follows a letter, digit or printable ASCII character: the byte-level pattern
never holds such a space inside, and no piece has a word mark behind another character. So each distinct stretch between
these places is encoded and aligned once by a worker as long as it keeps them. Stretches lie in blocks of at most `BLOCK_BYTES` of text (a longer
text is a block by itself), which are written to the shared folder without their texts:

1. per block: results that need no corpus, stretches per document, the distinct id pairs of the block and their counts;
2. the pairs' counts are added up over all blocks; the highest count of each second id (at most a vocabulary) is broadcast;
3. every block gets the numbers of its own pairs back. Pairs that more than one in `HOT` of all rows hold are at most `HOT`
   and are broadcast, so no key of the remaining join has more than that share.

Defined results: null and empty texts, and texts that either side changes (bytes of the joined tokens differ: the word
mark U+2581 as a character), have no tokens, zeros, and '' for their groups. Special tokens' strings are plain text.
Ties: every pair with the highest count of its second id is a best one. Repeated rows and ids stay rows of their own, null
ids too; further columns are not read. An empty table gives an empty result. `piece_bpe` must normalise nothing.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import slices, written

BLOCK_BYTES = 4 << 20
KEPT_STRETCHES = 250_000
LEARNED_AT_ONCE = 10_000
LINE = 100
HOT = 10_000
BLOCKS = (
    "part long, block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, hashes array<string>, "
    "groups array<string>, sizes binary, stretches binary, widths binary, links binary, pairs array<long>, counts array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both sides the number of its group; the sides cover the same bytes."""
    n, m = len(a_ends), len(b_ends)
    far_b = np.searchsorted(b_ends, a_ends - 1, side="right")  # the token of the other side that holds the last byte
    far_a = np.searchsorted(a_ends, b_ends - 1, side="right")
    beyond = a_ends[far_a] > b_ends if m else np.zeros(0, bool)
    points = np.concatenate([n + far_b, np.where(beyond, far_a, n + np.arange(m))])
    while True:
        doubled = points[points]
        if np.array_equal(doubled, points):
            break
        points = doubled
    last = np.flatnonzero(~beyond) + n
    labels = np.searchsorted(last, points)
    return labels[:n], labels[n:]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of spaces that follow a character which is no white space in any reading."""
    at = np.flatnonzero(data == 0x20)
    before = [np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3, 4)]
    inner = [(b >= 0x80) & (b < 0xC0) for b in before]
    ascii_sign = (before[0] > 0x20) & (before[0] < 0x7F)
    two = inner[0] & (before[1] >= 0xC3) & (before[1] < 0xE0)
    three = inner[0] & inner[1] & ((before[2] == 0xE0) | (before[2] >= 0xE4) & (before[2] <= 0xED))
    four = inner[0] & inner[1] & inner[2] & (before[3] >= 0xF0)
    return at[ascii_sign | two | three | four]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, one after another, and how many each has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Stretches:
    """Aligned stretches of text: each one met is encoded once."""

    def __init__(self, byte_spec: str, piece_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        alphabet = byte_alphabet()
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths = np.fromiter(map(len, self.a_bytes), np.int64, size)
        self.b_lengths = np.fromiter(map(len, self.b_bytes), np.int64, self.b_size)
        self.a_size = size
        self.texts = [f"{i}{sign}" for n, sides in ((size, ",|"), (self.b_size, ",;")) for sign in sides for i in range(n)]
        self.mark = self.b.piece_to_id("▁")
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)  # else texts are taken whole
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.good: list[bool] = []
        self.spelled: list[str] = []
        self.numbers: list[np.ndarray] = []  # per stretch: tokens of both sides, groups, links
        self.pairs: list[np.ndarray] = []

    def byte_ids(self, strings: list[str], data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-level ids of the stretches, one after another, and how many each has. Stretches stand in one line as long
        as each is parted from the next there too: many in one text cost less."""
        parted = np.zeros(len(data) + 1, bool)
        parted[cuts(np.append(data, np.uint8(0x20)))] = True
        last = ~parted[ends]
        last[LINE - 1 :: LINE] = last[-1:] = True
        stops = (np.flatnonzero(last) + 1).tolist()
        lines = ["".join(strings[i:j]) for i, j in zip([0, *stops], stops)]
        flat = flattened([e.ids for e in self.a.encode_batch_fast(lines, add_special_tokens=False)])[0]
        reached = np.cumsum(self.a_lengths[flat])
        at = np.searchsorted(reached, ends)
        if len(reached) and reached[-1] == ends[-1] and np.array_equal(reached[at], ends):
            return flat, np.diff(at + 1, prepend=0)
        return flattened([e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)])

    def learn(self, new: list[bytes]) -> None:
        """Encode and align stretches, each with its leading space."""
        strings, whole = [x.decode() for x in new], b"".join(new)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        a_ids, a_count = self.byte_ids(strings, np.frombuffer(whole, np.uint8), np.cumsum(sizes))
        b = self.b.encode([s[1:] for s in strings], num_threads=1)
        b_ids, b_count = flattened([x if len(s) > 1 else [self.mark] for x, s in zip(b, strings)])
        good = (run_sums(self.a_lengths[a_ids], a_count) == sizes) & (run_sums(self.b_lengths[b_ids], b_count) == sizes)
        a_parts, b_parts = list(map(self.a_bytes.__getitem__, a_ids.tolist())), list(map(self.b_bytes.__getitem__, b_ids.tolist()))
        if not (good.all() and b"".join(a_parts) == whole == b"".join(b_parts)):
            a_stop, b_stop = np.cumsum(a_count), np.cumsum(b_count)
            for i in np.flatnonzero(good).tolist():
                good[i] = b"".join(a_parts[a_stop[i] - a_count[i] : a_stop[i]]) == new[i] == b"".join(b_parts[b_stop[i] - b_count[i] : b_stop[i]])
            a_ids, b_ids = a_ids[np.repeat(good, a_count)], b_ids[np.repeat(good, b_count)]
            a_count, b_count = np.where(good, a_count, 0), np.where(good, b_count, 0)
        self.good += good.tolist()
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        a_ends, b_ends = np.cumsum(self.a_lengths[a_ids]), np.cumsum(self.b_lengths[b_ids])
        a_groups, b_groups = group_labels(a_ends, b_ends)
        n_groups = int(b_groups[-1]) + 1 if len(b_groups) else 0
        a_last, b_last = np.cumsum(a_count), np.cumsum(b_count)
        group_last = np.where(b_last > 0, np.append(b_groups, 0)[b_last - 1] + 1, 0) if n_groups else np.zeros(len(new), np.int64)
        # per group the ids of both sides in turn, each with the sign behind it
        signs = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (a_groups, b_groups)]
        order = np.argsort(np.concatenate([2 * a_groups, 2 * b_groups + 1]), kind="stable")
        codes = np.concatenate([a_ids + signs[0] * self.a_size, b_ids + signs[1] * self.b_size + 2 * self.a_size])[order]
        spelled = list(map(self.texts.__getitem__, codes.tolist()))
        limits = [0, *(a_last + b_last).tolist()]
        self.spelled += ["".join(spelled[i:j])[:-1] for i, j in zip(limits, limits[1:])]
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends  # between two neighbours lies exactly one link
        pair = a_ids[np.searchsorted(a_ends, ends)] * self.b_size + b_ids[np.searchsorted(b_ends, ends)]
        stop = np.where(b_last > 0, np.append(b_ends, 0)[b_last - 1], 0)
        link_last = np.searchsorted(ends, stop, side="right")
        self.numbers.append(np.stack([np.diff(x, prepend=0) for x in (a_last, b_last, group_last, link_last)]))
        self.pairs.append(pair)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (four rows) and pairs of all known stretches."""
        if len(self.numbers) > 1:
            self.numbers, self.pairs = [np.concatenate(self.numbers, axis=1)], [np.concatenate(self.pairs)]
        return (self.numbers[0], self.pairs[0]) if self.numbers else (np.zeros((4, 0), np.int64), np.zeros(0, np.int64))

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Known numbers of all stretches of the texts, and how many each text has."""
        size = np.array(pc.binary_length(texts), np.int64)
        whole = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary()))
        whole = whole.filter(pa.array(size > 0))
        data = np.frombuffer(b"".join(whole.to_pylist()), np.uint8)
        starts = np.cumsum(np.append(0, size[size > 0] + 1))
        begins = np.zeros(len(data), bool)
        begins[starts[:-1]] = True
        if self.parts:
            begins[cuts(data)] = True
        places = np.flatnonzero(begins)
        offsets = np.append(places, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.known]
        for i in range(0, len(new), LEARNED_AT_ONCE):
            self.learn(new[i : i + LEARNED_AT_ONCE])
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        counts = np.zeros(len(size), np.int64)
        counts[size > 0] = np.diff(np.searchsorted(places, starts))
        return numbers[coded.indices.to_numpy()] if len(places) else np.zeros(0, np.int64), counts


def squeezed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def spread(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def run_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _block(known: Stretches, ids: list, parts: list[tuple[np.ndarray, np.ndarray]], part: int, block: int, spell: bool) -> pa.RecordBatch:
    """One block of documents as a row."""
    numbers, pairs = known.tables()
    stretches, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    ends = np.cumsum(sizes)
    wrong = run_sums(~np.array(known.good, bool)[stretches] if len(stretches) else stretches, sizes) > 0
    have = ~wrong & (sizes > 0)
    stretches, sizes, bounds = stretches[np.repeat(have, sizes)], np.where(have, sizes, 0), (ends, ends - sizes)
    used, local = np.unique(stretches, return_inverse=True)
    each = [run_sums(row[stretches], sizes) for row in numbers]
    order, hashes, groups, at = stretches.tolist(), [], [], 0
    for size in sizes.tolist():
        text = ";".join(map(known.spelled.__getitem__, order[at : at + size]))
        hashes.append(hashlib.sha256(text.encode()).hexdigest() if size else "")
        groups.append(text if spell else None)
        at += size
    widths = numbers[3][used]
    firsts = (np.cumsum(numbers[3]) - numbers[3])[used]
    total = np.cumsum(widths)
    linked = pairs[np.repeat(firsts - (total - widths), widths) + np.arange(int(total[-1]) if len(total) else 0)]
    distinct, inverse = np.unique(linked, return_inverse=True)
    weight = np.repeat(np.bincount(local, minlength=len(used)), widths)
    counts = np.bincount(inverse, weight, len(distinct)).astype(np.int64)
    lists = [ids, *(x.tolist() for x in each), hashes, groups]
    fields = [c.split() for c in BLOCKS.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    row = [part, block, *lists, squeezed(sizes), squeezed(local), squeezed(widths), squeezed(inverse), distinct.tolist(), counts.tolist()]
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(row, fields)], [n for n, _ in fields])


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, doc_id: Column | str = "doc_id", text: Column | str = "text", spell: bool = False) -> DataFrame:
    """One row per document; `groups` holds the groups' text if `spell`, else null."""
    spark = docs.sparkSession
    with open(byte_bpe, encoding="utf-8") as file, open(piece_bpe, "rb") as model:
        # a worker keeps its copy of a broadcast, and with it the tokenizers and the stretches it knows, through its tasks
        specs = spark.sparkContext.broadcast((file.read(), model.read(), {}))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_spec, piece_model, kept = specs.value
        if "known" not in kept:
            kept["known"] = Stretches(byte_spec, piece_model)
        known, part = kept["known"], TaskContext.get().partitionId()
        block, held, ids, parts = 0, 0, [], []
        for batch in batches:
            first = 0
            for some in slices(batch.column(1), BLOCK_BYTES // 4):
                texts = pc.fill_null(some.cast(pa.large_binary()), b"")
                ids += batch.column(0).slice(first, len(some)).to_pylist()
                parts.append(known.split(texts))
                first, held = first + len(some), held + texts.nbytes
                if held >= BLOCK_BYTES:
                    yield _block(known, ids, parts, part, block, spell)
                    block, held, ids, parts = block + 1, 0, [], []
                    if len(known.known) > KEPT_STRETCHES:
                        known.clear()
        if ids:
            yield _block(known, ids, parts, part, block, spell)

    columns = [F.col(c) if isinstance(c, str) else c for c in (doc_id, text)]
    blocks = written(docs.select(columns[0].cast("long"), columns[1].cast("string")).mapInArrow(made, BLOCKS), "alignment")
    size = Stretches(*specs.value[:2]).b_size
    pairs = blocks.select("part", "block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x"))
    pairs = pairs.select("part", "block", "at", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = written(pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "alignment")
    highest = totals.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("highest"))
    rated = totals.join(F.broadcast(highest), F.col("pair") % size == F.col("b"))
    rated = rated.select("pair", F.col("n").alias("count"), (F.col("n") == F.col("highest")).alias("best"), "rows")
    hot = (totals.agg(F.sum("rows")).first()[0] or 0) / HOT
    often, seldom = rated.where(F.col("rows") > hot).drop("rows"), rated.where(F.col("rows") <= hot).drop("rows")
    places = pairs.drop("n")
    answers = places.join(F.broadcast(often), "pair").unionByName(
        places.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(seldom, "pair")
    )

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, numbers = left.to_pylist(), (right.column(c).to_numpy() for c in ("at", "count", "best"))
        at, count, best = numbers
        counts, bests = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        counts[at], bests[at] = count, best
        out = []
        for row in rows:
            sizes, stretches, widths, links = (spread(row[c]) for c in ("sizes", "stretches", "widths", "links"))
            sums = [run_sums(run_sums(x[links], widths)[stretches], sizes) for x in (bests, counts)]
            names = ("doc_ids", "n_a", "n_b", "n_groups", "n_links")
            columns = [pa.array(row[c], pa.int64()) for c in names] + [pa.array(x, pa.int64()) for x in sums]
            columns += [pa.array(row[c], pa.string()) for c in ("hashes", "groups")]
            out.append(pa.table(columns, names=[c.split()[0] for c in RESULT.split(", ")]))
        return pa.concat_tables(out)

    keys = ("part", "block")
    held = blocks.select(*keys, "doc_ids", "n_a", "n_b", "n_groups", "n_links", "hashes", "groups", "sizes", "stretches", "widths", "links")
    answers = answers.select(F.col("part").alias("p"), F.col("block").alias("k"), "at", "count", "best")
    return held.groupBy(*keys).cogroup(answers.groupBy("p", "k")).applyInArrow(finished, RESULT)
