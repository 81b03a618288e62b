"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' ids. A round grants every queue its share of one window; what a share
leaves over below one whole id is the queue's deficit and is carried to the next round, so after r rounds a queue
has sent the whole part of r times its quantum. Rounds follow each other without gaps and are cut every `window`
ids, so only the last sequence can have padding. Without targets the shares are the sources' own shares of all ids;
with targets a queue that runs dry leaves its share to the others in proportion.

Because a queue's grants after any round have a closed form, no task walks through the rounds before its own:
a partition needs the queues' totals (one number per queue) and how many ids of each queue lie in the partitions
before it; that is how deficits carry over windows and partitions. Quanta are fixed-point numbers, so all tasks
compute the same integers.

Defined cases: null and empty texts consist of the end id; null sources are a queue of their own; repeated rows are
packed once each; targets of absent sources are left out and sources without a target come last, in one round-robin
of their own shares; of more than `MAX_QUEUES` sources those with a target keep their queues and the others are dealt
to that many queues by a hash of their name; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.tokens import token_blocks, unpacked

WINDOW = 2048
MAX_QUEUES = 4096
UNIT = 16  # binary digits of a quantum after the point
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """Grants of every queue after any round."""

    def __init__(self, totals: list[int], shares: list[float], window: int):
        self.window, self.totals = window, np.array(totals, np.int64)
        goal, base, start = self.totals << UNIT, np.zeros(len(totals), np.int64), 0
        self.start, self.base, self.quantum = [], [], []
        share = np.array(shares, np.float64)
        while (open_ := base < goal).any():
            weights = np.where(open_, share, 0.0)
            if weights.sum() <= 0:
                weights = np.where(open_, self.totals, 0).astype(np.float64)
            # Rounding up lets a queue run dry early rather than late.
            quantum = np.ceil(weights / weights.sum() * (window << UNIT)).astype(np.int64)
            for kept, value in ((self.start, start), (self.base, base), (self.quantum, quantum)):
                kept.append(value)
            live = quantum > 0
            rounds = int((-((base[live] - goal[live]) // quantum[live])).min())
            base, start = np.minimum(goal, base + rounds * quantum), start + rounds
        self.start, self.base, self.quantum = (np.array(x, np.int64) for x in (self.start, self.base, self.quantum))

    def granted(self, rounds: np.ndarray) -> np.ndarray:
        """Ids that each queue has sent after the rounds: one row per round."""
        e = np.maximum(np.searchsorted(self.start, rounds, side="right") - 1, 0)
        units = self.base[e] + (rounds - self.start[e])[:, None] * self.quantum[e]
        return np.minimum(self.totals, units >> UNIT)

    def round_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The round that sends a queue's id number `at`."""
        need, found = (at + 1) << UNIT, np.zeros(len(at), np.int64)
        for e in range(len(self.start)):
            q = self.quantum[e][queue]
            here = (need > self.base[e][queue]) & (q > 0)
            found[here] = self.start[e] - (self.base[e][queue][here] - need[here]) // q[here]
        return found

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, first id in it, length and place in the whole stream of every piece."""
        first, last = self.round_of(queue, start), self.round_of(queue, start + size - 1)
        doc, rounds = _ranges(first, last - first + 1)
        known, inverse = np.unique(rounds, return_inverse=True)
        q, low, at = queue[doc], np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        high = low.copy()
        order, step = np.argsort(inverse, kind="stable"), max(1, (1 << 21) // len(self.totals))
        bounds = np.searchsorted(inverse[order], np.arange(0, len(known) + step, step))
        for k in range(len(bounds) - 1):
            rows, of = order[bounds[k] : bounds[k + 1]], known[k * step : (k + 1) * step]
            before, after = self.granted(of - 1), self.granted(of)
            places = before.sum(axis=1)[:, None] + np.cumsum(after - before, axis=1) - (after - before)
            i = inverse[rows] - k * step
            low[rows], high[rows], at[rows] = before[i, q[rows]], after[i, q[rows]], places[i, q[rows]]
        a, b = np.maximum(start[doc], low), np.minimum((start + size)[doc], high)
        at, some = at + a - low, b > a
        doc, a, at, length = doc[some], a[some], at[some], (b - a)[some]
        piece, window = _ranges(at // self.window, (at + length - 1) // self.window - at // self.window + 1)
        left = np.maximum(at[piece], window * self.window)
        right = np.minimum((at + length)[piece], (window + 1) * self.window)
        return doc[piece], (a - start[doc])[piece] + left - at[piece], right - left, left


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, `count[i]` consecutive numbers from `first[i]`."""
    of = np.repeat(np.arange(len(count)), count)
    return of, first[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]


def _dealt(queue: Column, targets: dict[str, float]) -> Column:
    """The queue of a source when there are too many: its own if it has a target, else one by its hash."""
    own = F.coalesce(queue.isin([x for x in targets if x is not None]), F.lit(None in targets))
    return F.when(own, F.concat(F.lit("="), queue)).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64(queue), F.lit(MAX_QUEUES))))


def pack(
    docs: DataFrame,
    path: str,
    end: int = 1,
    window: int = WINDOW,
    targets: dict[str, float] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pieces of all documents: PIECES. `path` is a tokenizer file, `targets` token shares by source."""
    spark = docs.sparkSession
    blocks = token_blocks(docs, F.col(doc_id), F.col(source), F.col(text), path, end, "packing")
    by_part = (
        blocks.select("part", F.explode(F.arrays_zip("queues", "sizes")).alias("d"))
        .groupBy("part", F.col("d.queues").alias("queue"))
        .agg(F.sum("d.sizes").alias("n"))
    )
    sums = by_part.groupBy("queue").agg(F.sum("n").alias("n"))
    hashed, wanted = sums.limit(MAX_QUEUES + 1).count() > MAX_QUEUES, targets or {}
    key = _dealt(F.col("queue"), wanted) if hashed else F.col("queue")
    sums = sums.groupBy(key.alias("queue")).agg(F.sum("n").alias("n")).orderBy(F.col("queue").asc_nulls_first()).collect()
    names, totals = [r["queue"] for r in sums], [r["n"] for r in sums]
    if hashed:
        wanted = {x if x is None else "=" + x: share for x, share in wanted.items()}
    plan = Schedule(totals, [wanted.get(x, 0.0) if targets else float(n) for x, n in zip(names, totals)], window)
    number = {x: i for i, x in enumerate(names)}
    state = spark.sparkContext.broadcast((totals, plan.start, plan.base, plan.quantum, number))

    by_part = by_part.select("part", key.alias("queue"), "n").groupBy("part", "queue").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        by_part.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("queue", "n")).alias("offsets"))  # at most MAX_QUEUES numbers
    )
    # Blocks of a part also need what the part's blocks before them hold.
    held = blocks.select("part", "block", F.explode(F.arrays_zip("queues", "sizes")).alias("d"))
    held = held.groupBy("part", "block", F.col("d.queues").alias("queue")).agg(F.sum("d.sizes").alias("n"))
    held = held.select("part", "block", key.alias("queue"), "n").groupBy("part", "block", "queue").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("part", "queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = (
        held.select("part", "block", "queue", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n"))
        .groupBy("part", "block")
        .agg(F.collect_list(F.struct("queue", "n")).alias("inner"))
    )
    queues = F.transform("queues", lambda x: _dealt(x, targets or {})) if hashed else F.col("queues")
    placed = blocks.withColumn("queues", queues).join(inner.join(offsets, "part"), ["part", "block"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, start, base, quantum, number = state.value
        plan = Schedule.__new__(Schedule)
        plan.window, plan.totals = window, np.array(totals, np.int64)
        plan.start, plan.base, plan.quantum = start, base, quantum
        for batch in batches:
            for row in batch.to_pylist():
                ids, size = unpacked(row["ids"]), np.array(row["sizes"], np.int64)
                queue = np.array([number[x] for x in row["queues"]], np.int64)
                at = np.zeros(len(number), np.int64)
                for x in (*row["inner"], *row["offsets"]):
                    at[number[x["queue"]]] += x["n"]
                order = np.argsort(queue, kind="stable")
                running = np.cumsum(size[order]) - size[order]
                heads = np.searchsorted(queue[order], queue[order])
                begin = np.zeros(len(size), np.int64)
                begin[order] = at[queue[order]] + running - running[heads]
                doc, first, length, place = plan.pieces(queue, begin, size)
                inside = (np.cumsum(size) - size)[doc] + first
                data = ids.astype("<u4").tobytes()
                parts = [data[4 * a : 4 * b] for a, b in zip(inside.tolist(), (inside + length).tolist())]
                doc_ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(first), pa.array(length), pa.array(parts, pa.binary()), pa.array(size[doc]), pa.array(place // window), pa.array(place % window)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return placed.select("doc_ids", "queues", "sizes", "ids", "inner", "offsets").mapInArrow(cut, PIECES)
