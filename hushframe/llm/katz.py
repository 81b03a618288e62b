"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

Texts are split once into blocks: numbers of a block's words and the words' hashes, written to the shared folder.
Blocks and tables of n-grams talk in both directions, one order after another. A block sends its distinct n-grams with
their training counts, packed by ranges of their hash (buckets); a bucket adds up the counts and answers every block
with the totals of just its n-grams. One block is told to own each n-gram, and whether it alone holds it: what is longer
stands nowhere else either, so the block counts that by itself. For the backoff weights the owners add up discounted
counts and lower-order probabilities per context. A context that one block alone holds is settled there; of the others
the buckets settle the weights, and answer again. Then each block scores its tokens by the recursion

    P(w | h) = d(c) c(hw) / c(h)   if hw was seen,   else   a(h) P(w | shorter h).

A frequent word is one entry per block and bucket, so no key is hot; what moves is the distinct n-grams of blocks,
not tokens. Words are compared as 64-bit hashes.

Discounts: Good-Turing up to the largest k <= 5 whose discounts lie between 0 and 1, else 0.5 is taken off every
count. Mass left over by words goes to one unknown word. A context whose counts are not discounted at all gets one
count more below the fraction, so that every context leaves something over and sums to exactly one.

Defined cases: null and empty texts consist of the end token; rows with a null training flag do not train; repeated
rows count and are scored once each; without training rows every token is unknown and has probability 1; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Lexicon, fmix, numbered, slices, sums, texts_of, word_hashes, written

ORDER = 3
DEPTH = 5
BLOCK_TOKENS = 1 << 21
BUCKET_ENTRIES = 1 << 20
START, END = np.uint64(0x5AFE57A27), np.uint64(0x5AFEE4D)
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = "block long, doc_ids array<long>, train array<boolean>, sizes array<long>, hashes binary, ids binary, n long"
PIECE = "bucket long, block long, order int, data binary"
SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of their places, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(data: bytes, kind=np.uint64) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def table(rows: dict[str, list], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array(rows[name], types[kind]) for name, kind in fields})


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, the number of each key among them, and one place of each."""
    order = np.argsort(keys)
    line = keys[order]
    fresh = np.ones(len(line), bool)
    fresh[1:] = line[1:] != line[:-1]
    number = np.empty(len(line), np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return line[fresh], number, order[fresh].astype(np.int32)


class Block:
    """Distinct n-grams of a block's tokens. Lists are by order, from 1 on."""

    def __init__(self, train: list[bool], sizes: list[int], hashes: np.ndarray, ids: np.ndarray, order: int):
        # the words and the end sign of each text; before its first word stand start signs
        self.sizes = np.array(sizes, np.int64) + 1
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        word = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        word[ends - 1] = False
        code = np.full(len(word), len(hashes), np.int32)
        code[word] = ids
        line = np.append(hashes, END)[code]
        learned = np.repeat(np.array([bool(t) for t in train], bool), self.sizes)
        self.keys, self.number, self.place, self.count, self.starts = [], [], [], [], []
        sequence, start = fmix(line), fmix(np.array([START]))
        for n in range(1, order + 1):
            if n == 1:  # the words are distinct already
                keys, rank, _ = ranked(fmix(np.append(hashes, END)))
                number = rank[code]
                place = np.empty(len(keys), np.int32)
                place[number] = np.arange(len(number), dtype=np.int32)
            else:
                before = np.empty_like(sequence)
                before[1:] = sequence[:-1]
                before[self.first] = start
                self.starts.append(start)
                start = fmix(start * MIX + START)
                before *= MIX
                before += line
                sequence = fmix(before)
                del before
                keys, number, place = ranked(sequence)
            self.keys.append(keys)
            self.number.append(number)
            self.place.append(place)
            self.count.append(np.bincount(number[learned], minlength=len(keys)).astype(np.int32))

    def contexts(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the contexts of order `n`, the context of each place, and which n-gram of order `n - 1` each context
        is; -1 for the one of start signs alone."""
        keys, number, start = self.keys[n - 2], self.number[n - 2], self.starts[n - 2]
        at = int(np.searchsorted(keys, start)[0])
        context = np.empty_like(number)
        context[1:] = (number + (number >= at))[:-1]
        context[self.first] = at
        used = np.zeros(len(keys) + 1, bool)
        used[context] = True
        shorter = np.insert(np.arange(len(keys), dtype=np.int32), at, -1)
        dense = np.cumsum(used, dtype=np.int32) - 1
        return np.insert(keys, at, start)[used], dense[context], shorter[used]

    @property
    def context_number(self) -> list[np.ndarray | None]:
        """The context of each place, by order; made when asked for."""
        return [None, *(self.contexts(n)[1] for n in range(2, len(self.keys) + 1))]

    @property
    def context(self) -> list[np.ndarray | None]:
        """The context of each n-gram, by order; made when asked for."""
        return [c if c is None else c[place] for c, place in zip(self.context_number, self.place)]


def cuts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that sorted keys fall into, and where."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.diff(bucket.astype(np.int64))) + 1
    for a, b in zip([0, *edge], [*edge, len(keys)]):
        if b > a:
            yield int(bucket[a]), slice(int(a), int(b))


def discounts(n: list[int]) -> tuple[np.ndarray, float]:
    """Factors for counts 1 to DEPTH + 1 (the last for all above), from the numbers of n-grams by count; what is
    taken off every count instead, if Good-Turing does not hold."""
    for k in range(DEPTH, 1, -1):
        if n[0] and all(n[: k + 1]):
            most = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - most) / (1 - most) if most < 1 else 2.0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array(d + [1.0] * (DEPTH + 1 - k)), 0.0
    return np.ones(DEPTH + 1), 0.5


def discounted(count: np.ndarray, rule: tuple[np.ndarray, float]) -> np.ndarray:
    factors, off = rule
    some = np.concatenate([[0.0], np.arange(1, DEPTH + 2) * factors - off])
    out = some[np.minimum(count, DEPTH + 1)]
    many = count > DEPTH + 1
    out[many] = count[many] * factors[DEPTH] - off
    return out


def blocks_of(docs: DataFrame, doc_id: Column, train: Column, text: Column) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        fresh = lambda: (Lexicon(), [], [], [], [])
        lexicon, ids, learned, sizes, flat = fresh()

        def out() -> pa.RecordBatch:
            numbers = np.concatenate(flat)
            # Frequent words get small numbers: they compress better.
            order = np.argsort(-np.bincount(numbers, minlength=len(lexicon)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            hashes = word_hashes(list(lexicon))[order] if len(order) else np.zeros(0, np.uint64)
            small = rank[numbers].astype("<u4").view(np.uint8).reshape(-1, 4).T
            import zstandard

            packed = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(small).tobytes())
            n = len(numbers) + len(sizes)
            values = [[(part << 24) + count], [ids], [learned], [sizes], [hashes.tobytes()], [packed], [n]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            first = 0
            for some in slices(batch.column(2)):
                numbers, counts = numbered([t.lower().split() for t in texts_of(some)], lexicon)
                ids += batch.column(0).slice(first, len(some)).to_pylist()
                learned += [bool(t) for t in batch.column(1).slice(first, len(some)).to_pylist()]
                sizes += counts.tolist()
                flat.append(numbers)
                first += len(some)
                if sum(map(len, flat)) + len(sizes) >= BLOCK_TOKENS:
                    yield out()
                    count += 1
                    lexicon, ids, learned, sizes, flat = fresh()
        if sizes:
            yield out()

    return written(docs.select(doc_id.cast("long"), train, text).mapInArrow(made, BLOCK), "katz")


def _block(row: dict, order: int) -> Block:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"]), np.uint8).reshape(4, -1)
    ids = np.ascontiguousarray(raw.T).reshape(-1).view("<u4")
    return Block(row["train"], row["sizes"], np.frombuffer(row["hashes"], np.uint64), ids, order)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows one by one: a row may hold a whole block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _answers(replies: pa.Table, kind: str, order: int) -> Iterator[list[bytes]]:
    """The answers to a block of one kind and order, by bucket."""
    own = np.flatnonzero(np.array(pc.and_(pc.equal(replies["kind"], kind), pc.equal(replies["order"], order))))
    buckets = replies["bucket"].to_numpy()[own]
    for i in own[np.argsort(buckets, kind="stable")]:
        yield parted(replies["data"][int(i)].as_py())


def settled(count: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Divisors of contexts: their counts, or one more where nothing was taken off."""
    return np.where((count > 0) & (count - mass <= 1e-9 * count), count + 1, count)


def backoff(count: np.ndarray, mass: np.ndarray, lower: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Backoff weights of contexts."""
    return np.where(count > 0, (1 - mass / np.where(count > 0, below, 1)) / np.maximum(1e-300, 1 - lower), 1.0)


class Known:
    """What a block knows after its n-grams (and contexts) were answered; read from the answers when asked for.

    What no other block holds stands nowhere else inside a longer n-gram or as a context: the block counts and settles
    that by itself. Only the other n-grams and contexts are sent and answered."""

    def __init__(self, b: Block, replies: pa.Table, stats: dict):
        self.b, self.replies, self.stats = b, replies, stats
        self.read: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.at, self.last, self.sums = 0, None, None  # the contexts that were last looked at

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of the block's n-grams, which ones it owns, and which ones no other block holds."""
        if n not in self.read:
            sent = ~self.certain(n)
            total = self.b.count[n - 1].astype(np.int64)
            own, alone = total > 0, ~sent
            x = np.concatenate([np.zeros(0, np.int64), *(expand(x[0], np.int64) for x in _answers(self.replies, "counts", n))])
            total[sent], own[sent], alone[sent] = x >> 2, x & 2 == 2, x & 1 == 1
            self.read[n] = total, own, alone
        return self.read[n]

    def certain(self, n: int) -> np.ndarray:
        """Which n-grams begin or end with a shorter one that no other block holds."""
        if n == 1:
            return np.zeros(len(self.b.keys[0]), bool)
        alone, place = self.counts(n - 1)[2][self.b.number[n - 2]], self.b.place[n - 1]
        before = np.empty_like(alone)
        before[1:] = alone[:-1]
        before[self.b.first] = False  # start signs stand in every block
        return (alone | before)[place]

    def contexts(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the contexts of order `n`, the context of each place and of each n-gram, and which contexts no other
        block holds."""
        if n != self.at:
            keys, number, shorter = self.b.contexts(n)
            alone = self.counts(n - 1)[2][shorter] & (shorter >= 0)
            self.at, self.last, self.sums = n, (keys, number, number[self.b.place[n - 1]], alone), None
        return self.last

    def totals(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and discounted counts of the contexts, over the n-grams that the block owns."""
        keys, _, context, _ = self.contexts(n)
        if self.sums is None:
            total, own, _ = self.counts(n)
            at, total = context[own], total[own]
            self.sums = np.bincount(at, total, len(keys)), np.bincount(at, discounted(total, self.stats[n]["rule"]), len(keys))
        return self.sums

    def lower(self, n: int, below: np.ndarray) -> np.ndarray:
        """Per context, the probability `below` of its followers after the shorter context, over the n-grams that the
        block owns."""
        keys, _, context, _ = self.contexts(n)
        own = self.counts(n)[1]
        return np.bincount(context[own], below[self.b.number[n - 2][self.b.place[n - 1][own]]], len(keys))

    def asked(self, n: int) -> np.ndarray:
        """Which contexts of order `n` back off in the block: they stand before an n-gram that was not seen."""
        keys, _, context, _ = self.contexts(n)
        out = np.zeros(len(keys), bool)
        out[context[self.counts(n)[0] == 0]] = True
        return out

    def answers(self, n: int, which: int) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(expand(x[which], np.float64) for x in _answers(self.replies, "weights", n))])

    def probability(self, n: int) -> np.ndarray:
        """P of each of the block's distinct n-grams of order `n` that were seen, 0 for the others."""
        d = discounted(self.counts(n)[0], self.stats[n]["rule"])
        if n == 1:
            return d / max(1, self.stats[1]["tokens"])
        _, _, context, alone = self.contexts(n)
        below = settled(*self.totals(n))
        below[~alone] = self.answers(n, 0)
        below = below[context]
        return d / np.where(below > 0, below, 1.0)

    def weights(self, n: int, below: np.ndarray) -> np.ndarray:
        """Backoff weights at each place for order `n`, 1 for contexts that were not asked for; `below`: the probabilities
        of the shorter n-grams."""
        _, number, _, alone = self.contexts(n)
        asked = self.asked(n)
        count, mass = self.totals(n)
        out = np.where(asked, backoff(count, mass, self.lower(n, below), settled(count, mass)), 1.0)
        out[asked & ~alone] = self.answers(n, 1)
        return out[number]


def facts(total: np.ndarray) -> np.ndarray:
    """How many n-grams have which count, how many there are, and their occurrences."""
    by_count = np.bincount(np.minimum(total, DEPTH + 2), minlength=DEPTH + 3)[1 : DEPTH + 2]
    return np.array([*by_count, (total > 0).sum(), total.sum()], np.int64)


def _send_counts(n: int, buckets: int):
    def send(blocks: pa.Table, replies: pa.Table | None) -> pa.Table:
        rows = {"bucket": [], "block": [], "order": [], "data": []}

        def add(*values) -> None:
            for name, value in zip(rows, values):
                rows[name].append(value)

        for row in _rows(blocks):
            b = _block(row, n)
            sure = Known(b, replies, {}).certain(n)
            keys, count = b.keys[n - 1][~sure], b.count[n - 1][~sure].astype(np.int64)
            for bucket, part in cuts(keys, buckets):
                add(bucket, row["block"], n, joined(squeeze(np.diff(keys[part], prepend=np.uint64(0))), squeeze(count[part])))
            add(row["block"] % buckets, -1, n, facts(b.count[n - 1][sure].astype(np.int64)).tobytes())
        return table(rows, PIECE)

    return send


def _send_words(buckets: int):
    send = _send_counts(1, buckets)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from send(pa.Table.from_batches([batch.slice(i, 1)]), None).to_batches()

    return sent


def _add_counts(group: pa.Table) -> pa.Table:
    """All blocks' n-grams of one bucket: totals for each block, and the facts of them and of those counted before."""
    rows = {"bucket": [], "block": [], "order": [], "data": []}
    pieces = sorted(group.to_pylist(), key=lambda r: r["block"])
    counted = sum((np.frombuffer(r["data"], np.int64) for r in pieces if r["block"] == -1), np.zeros(DEPTH + 3, np.int64))
    own = [r for r in pieces if r["block"] != -1]
    bucket, n = pieces[0]["bucket"], pieces[0]["order"]
    if own:
        parts = [parted(r["data"]) for r in own]
        keys = [np.cumsum(expand(p[0])) for p in parts]
        counts = np.concatenate([expand(p[1], np.int64) for p in parts])
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, inverse, counts)
        first = np.full(len(unique), len(inverse), np.int64)
        seen = np.flatnonzero(counts > 0)
        np.minimum.at(first, inverse[seen], seen)
        mine = np.zeros(len(inverse), np.int64)
        mine[first[first < len(inverse)]] = 1
        alone = np.bincount(inverse, minlength=len(unique))[inverse] == 1
        answer, at = total[inverse] << 2 | mine << 1 | alone, 0
        for r, k in zip(own, keys):
            for name, value in zip(rows, (bucket, r["block"], n, joined(squeeze(answer[at : at + len(k)])))):
                rows[name].append(value)
            at += len(k)
        counted = counted + facts(total)
    for name, value in zip(rows, (bucket, -1, n, counted.tobytes())):
        rows[name].append(value)
    return table(rows, PIECE)


def _send_sums(n: int, buckets: int, sent, turn: int, turns: int):
    def send(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        rows = {"bucket": [], "block": [], "order": [], "data": []}
        for row in _rows(blocks):
            known = Known(_block(row, n), replies, sent.value)
            known.b.keys[n - 1] = None  # not read here
            below = known.probability(n - 1)
            keys, _, _, alone = known.contexts(n)
            sums_ = [*known.totals(n), known.lower(n, below), known.asked(n).astype(np.int64)]
            keys, sums_ = keys[~alone], [x[~alone] for x in sums_]
            for bucket, part in cuts(keys, buckets):
                if bucket % turns != turn:
                    continue
                gaps = np.diff(keys[part], prepend=np.uint64(0))
                for name, value in zip(rows, (bucket, row["block"], n, joined(squeeze(gaps), *(squeeze(x[part]) for x in sums_)))):
                    rows[name].append(value)
        return table(rows, PIECE)

    return send


def _settle(group: pa.Table) -> pa.Table:
    """Divisors of one bucket's contexts for each block, and the backoff weights it asked for."""
    rows = {"bucket": [], "block": [], "order": [], "data": []}
    pieces = sorted(group.to_pylist(), key=lambda r: r["block"])
    parts = [parted(r["data"]) for r in pieces]
    keys = [np.cumsum(expand(p[0])) for p in parts]
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count, mass, lower = (np.bincount(inverse, np.concatenate([expand(p[k], np.float64) for p in parts]), len(unique)) for k in (1, 2, 3))
    below = settled(count, mass)
    weight, at = backoff(count, mass, lower, below), 0
    for r, k, p in zip(pieces, keys, parts):
        here = inverse[at : at + len(k)]
        asked = here[expand(p[4], np.int64) == 1]
        for name, value in zip(rows, (r["bucket"], r["block"], r["order"], joined(squeeze(below[here]), squeeze(weight[asked])))):
            rows[name].append(value)
        at += len(k)
    return table(rows, PIECE)


def _score(order: int, sent):
    def score(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in _rows(blocks):
            b, stats = _block(row, order), sent.value
            b.keys[order - 1] = None  # not read here
            known = Known(b, replies, stats)
            seen = known.counts(1)[0][b.number[0]]
            below = known.probability(1)
            p = np.where(seen > 0, below[b.number[0]], stats[1]["unknown"])
            for n in range(2, order + 1):
                p *= known.weights(n, below)
                below = known.probability(n)
                p = np.where(known.counts(n)[0][b.number[n - 1]] > 0, below[b.number[n - 1]], p)
            base = np.log10((seen + 1) / (stats[1]["tokens"] + stats[1]["types"] + 1))
            made = {
                "doc_id": row["doc_ids"], "train": row["train"], "n_tokens": b.sizes, "n_known": sums((seen > 0).astype(np.int64), b.sizes),
                "base_score": sums(base, b.sizes), "score": sums(np.log10(p), b.sizes),
            }
            out.append(table(made, SCORES))
        return pa.concat_tables(out) if out else table({c.split()[0]: [] for c in SCORES.split(", ")}, SCORES)

    return score


def katz_scores(docs: DataFrame, train: Column, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: SCORES and train_tokens. `train` says which rows teach the model; `order` is its longest n-gram."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    blocks = blocks_of(docs, F.col(doc_id), F.coalesce(train, F.lit(False)), F.col(text))
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(1 << 31, -(-tokens // BUCKET_ENTRIES)))
    own = blocks.select("block", "doc_ids", "train", "sizes", "hashes", "ids")
    each = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DEPTH + 3)]
    stats, replies = {}, None

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x, np.int64).tolist() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.int64()))], ["v"])

    def heard(kind: str, answers: DataFrame) -> DataFrame:
        found = answers.where("block >= 0").select("block", "bucket", "order", F.lit(kind).alias("kind"), "data")
        return replies.union(found) if replies is not None else found

    for n in range(1, order + 1):
        if n == 1:
            pieces = own.mapInArrow(_send_words(buckets), PIECE)
        else:
            known = replies.where("kind = 'counts'")
            pieces = own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_send_counts(n, buckets), PIECE)
        counted = written(pieces.groupBy("bucket").applyInArrow(_add_counts, PIECE), "katz")
        replies = heard("counts", counted)
        values = [x or 0 for x in counted.where("block = -1").select("data").mapInArrow(added, "v array<long>").agg(*each).first()]
        stats[n] = {"by": values[: DEPTH + 1], "types": values[-2], "tokens": values[-1], "rule": discounts(values[: DEPTH + 1])}
        if n == 1:
            words = stats[1]
            factors, off = words["rule"]
            taken = off * words["types"] + sum(k * r * (1 - factors[r - 1]) for r, k in enumerate(words["by"][:DEPTH], 1))
            words["unknown"] = taken / words["tokens"] if words["tokens"] else 1.0
            continue
        sent = spark.sparkContext.broadcast(dict(stats))
        # Longer contexts are more: their buckets are settled in turns, so that the disks hold one turn's sums at a time.
        known = own.groupBy("block").cogroup(replies.groupBy("block"))
        for turn in range(n - 1):
            sums_ = known.applyInArrow(_send_sums(n, buckets, sent, turn, n - 1), PIECE)
            replies = heard("weights", written(sums_.groupBy("bucket").applyInArrow(_settle, PIECE), "katz"))
    scores = own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(order, sent), SCORES)
    return scores.withColumn("train_tokens", F.lit(words["tokens"]).cast("long"))
