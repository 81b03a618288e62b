"""Windows that open at an event, over rows in one global order.

Rows are range-partitioned by key, time and ties, so a hot key lies over many tasks and each task reads its rows in order.
That one sorted pass settles every row but those of a task's first key, whose window may have opened in an earlier task.
For these the pass gives a short table: if the window that comes in ends at this time, then this is the window that goes
out. Tables are followed from task to task per key, then from block to block inside a task; what comes into a block settles
its rows. Rows travel packed, in blocks of `BLOCK_ROWS` that end early at `BLOCK_BYTES`, written once to the shared folder.
A block is one large value, so blocks are compressed by the worker that packs them: every size that writer, reader and
shuffle go by is then the size they hold. Files are cut into groups of `GROUP_BYTES`, since a reader takes a group as one.

A table has at most one entry per distinct time in the first window's length of its rows, mostly far fewer: windows that
open at different events soon fall into step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.session import shared_folder

BLOCK_ROWS = 65_536
BLOCK_BYTES = 4 << 20
GROUP_BYTES = 8 << 20
#: No window has opened yet.
NONE = int(np.iinfo(np.int64).min)

STATE = "start long, count long, tag binary"
TABLE = "upto array<long>, starts array<long>, counts array<long>, tags array<binary>, n long"
BLOCKS = f"part long, block long, key string, open boolean, {TABLE}, last_key string, last_start long, last_count long, last_tag binary, rows binary"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


@dataclass
class Table:
    """Where windows lead that come into a run of rows of one key.

    A window that ends at or before `upto[i]` (and after the one before) leads to the window that began at `starts[i]`,
    with so many rows and this tag of its first row; a window that ends later only gains the `n` rows.
    """

    upto: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    tags: np.ndarray
    n: int

    def follow(self, state: tuple, width: int) -> tuple:
        start, count, tag = state
        at = 0 if start == NONE else int(np.searchsorted(self.upto, start + width, side="left"))
        if at < len(self.upto):
            return int(self.starts[at]), int(self.counts[at]), self.tags[at]
        return start, count + self.n, tag

    def then(self, other: Table, width: int) -> Table:
        """This run and the one behind it as one."""
        ends = self.starts + width
        at = np.searchsorted(other.upto, ends, side="left")
        hit = at < len(other.upto)
        into = np.minimum(at, max(len(other.upto) - 1, 0))
        starts, counts, tags = self.starts.copy(), self.counts + other.n, self.tags.copy()
        if len(other.upto):
            starts[hit], counts[hit], tags[hit] = other.starts[into[hit]], other.counts[into[hit]], other.tags[into[hit]]
        later = other.upto > (self.upto[-1] if len(self.upto) else NONE)  # windows that outlast this run
        joined = [np.concatenate([a, b[later]]) for a, b in ((self.upto, other.upto), (starts, other.starts), (counts, other.counts), (tags, other.tags))]
        return Table(*joined, self.n + other.n).short()

    def short(self) -> Table:
        """Without entries that lead where the next one leads."""
        if len(self.upto) < 2:
            return self
        keep = np.append((self.starts[1:] != self.starts[:-1]), True)
        return Table(self.upto[keep], self.starts[keep], self.counts[keep], self.tags[keep], self.n)


def successors(us: np.ndarray, firsts: np.ndarray, width: int) -> np.ndarray:
    """For each row the first row of its run at or after the end of a window that opens with it, else the next run's first."""
    n = len(us)
    sizes = np.diff(np.append(firsts, n))
    run = np.repeat(np.arange(len(firsts)), sizes)
    low, high = int(us.min()), int(us.max())
    span = high - low + width + 1
    if span * (len(firsts) + 1) < 1 << 62:
        # runs one behind the other on one time line
        line = run * span + (us - low)
        return np.minimum(np.searchsorted(line, line + width, side="left"), np.append(firsts[1:], n)[run])
    out = np.empty(n, np.int64)
    for first, size in zip(firsts.tolist(), sizes.tolist()):
        own = us[first : first + size]
        out[first : first + size] = first + np.searchsorted(own, own + width, side="left")
    return out


def last_openers(nxt: np.ndarray) -> np.ndarray:
    """For each row of one run the opener of the last window if a window opens with it: pointers are doubled to the end."""
    n = len(nxt)
    to = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def run_table(us: np.ndarray, nxt: np.ndarray, tags: np.ndarray, width: int) -> Table:
    """The table of the rows of one key."""
    n = len(us)
    last = last_openers(nxt)
    # a window that comes in began at or before the first row
    reach = min(int(np.searchsorted(us, us[0] + width, side="left")) + 1, n)
    first = np.flatnonzero(np.append(True, us[1:reach] != us[: reach - 1]))  # the first row of each time
    to = last[first]
    return Table(us[first], us[to], n - to, tags[to], n).short()


def settle(us: np.ndarray, firsts: np.ndarray, nxt: np.ndarray, tags: np.ndarray, into: tuple, width: int) -> tuple:
    """Per row start and number of its window and the tag of the window's first row."""
    n = len(us)
    start, count, tag = into
    end = int(firsts[1]) if len(firsts) > 1 else n
    at = 0 if start == NONE else int(np.searchsorted(us[:end], start + width, side="left"))
    openers, follow = [], nxt.tolist()
    carried = at
    while at < n:
        openers.append(at)
        at = follow[at]
    openers = np.array(openers, np.int64)
    row = np.arange(n)
    of = np.searchsorted(openers, row, side="right") - 1
    own = openers[np.maximum(of, 0)] if len(openers) else np.zeros(n, np.int64)
    before = row < carried
    starts = np.where(before, start, us[own])
    ranks = np.where(before, count + row + 1, row - own + 1)
    of_first = tags[own]
    of_first[:carried] = tag
    return starts, ranks, of_first


def _runs(keys: pa.Array) -> np.ndarray:
    coded = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    codes = coded.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(np.diff(codes)) + 1)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    us = table["_us"].combine_chunks().to_numpy(zero_copy_only=False)
    tags = np.empty(len(us), object)
    if not pa.types.is_null(table["_tag"].type):
        tags[:] = table["_tag"].to_pylist()
    return us, tags


def _settled(table: pa.Table, starts: np.ndarray, ranks: np.ndarray, of_first: np.ndarray) -> pa.Table:
    return table.append_column("_start", pa.array(starts)).append_column("_rank", pa.array(ranks)).append_column("_first_tag", pa.array(of_first, pa.binary()))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
SCHEMA = [tuple(c.split()) for c in BLOCKS.split(", ")]
# sizes are looked at from the first block on, not after a hundred; a block is no word of a dictionary
WRITE = {
    "compression": "uncompressed",
    "parquet.block.size": str(GROUP_BYTES),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}


def _packer(width: int, block_rows: int, names: Sequence[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, _TYPES[t]) for n, t in SCHEMA])
        part, block = TaskContext.get().partitionId(), 0
        first_key, whole, summary, last = None, True, None, (None, NONE, 0, None)
        held, size, weight = [], 0, 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            nonlocal first_key, whole, summary, last
            keys, (us, tags) = table["_key"], _arrays(table)
            firsts = _runs(keys)
            nxt = successors(us, firsts, width)
            key, end = keys[0].as_py(), int(firsts[1]) if len(firsts) > 1 else len(us)
            if first_key is None:
                first_key = key
            begins = key == first_key and whole  # rows here may belong to a window of an earlier task
            if begins:
                own = run_table(us[:end], nxt[:end], tags[:end], width)
                summary = own if summary is None else summary.then(own, width)
                own = (own.upto.tolist(), own.starts.tolist(), own.counts.tolist(), own.tags.tolist(), own.n)
                into = (NONE, 0, None)
            else:
                own = (None, None, None, None, end)
                into = last[1:] if last[0] == key else (NONE, 0, None)
            if not (begins and len(firsts) == 1):
                whole = False
            starts, ranks, of_first = settle(us, firsts, nxt, tags, into, width)
            n = len(us)
            last = (keys[n - 1].as_py(), int(starts[-1]), int(ranks[-1]), of_first[-1])
            if begins and end == n:
                last = (last[0], NONE, 0, None)  # known once the window that comes in is
            if not begins:
                table = _settled(table, starts, ranks, of_first).select(names)
            return _row(schema, part, block, key, begins, *own, None, None, None, None, _ipc(table))

        for batch in batches:
            held.append(batch)
            size, weight = size + batch.num_rows, weight + batch.nbytes
            while size and (size >= block_rows or weight >= BLOCK_BYTES):
                table = pa.Table.from_batches(held)
                taken = min(size, block_rows, max(1, size * BLOCK_BYTES // weight))
                yield emit(table.slice(0, taken))
                rest = table.slice(taken)
                held, size, weight, block = rest.to_batches(), rest.num_rows, rest.nbytes, block + 1
        if size:
            yield emit(pa.Table.from_batches(held))
        if first_key is not None:
            t = summary
            yield _row(schema, part, -1, first_key, whole, t.upto.tolist(), t.starts.tolist(), t.counts.tolist(), t.tags.tolist(), t.n, *last, None)

    return pack


def _read(row: dict) -> Table:
    tags = np.empty(len(row["upto"]), object)
    tags[:] = row["tags"]
    return Table(*(np.array(row[c], np.int64) for c in ("upto", "starts", "counts")), tags, row["n"])


def _states(rows: list[tuple], names: Sequence[str]) -> pa.Table:
    types = [pa.int64()] * (len(names) - 1) + [pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def windows_in_order(
    df: DataFrame,
    key: Column,
    us: Column,
    width: int,
    ties: Sequence[str] = (),
    tag: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Adds `_start`, `_rank` and `_first_tag`: when a row's window opened, the row's number in it and the tag (binary) of
    its first row.

    A window opens at the first row of a key and lasts `width`; the next row at or after its end opens the next one. Rows
    are ordered by time, then `ties`. The input is read twice (its range bounds are sampled), shuffled once, and no task
    needs all rows of a key.
    """
    spark = df.sparkSession
    shown = df.withColumns({"_key": key.cast("string"), "_us": us.cast("long"), "_tag": (F.lit(None) if tag is None else tag).cast("binary")})
    order = [F.col("_key"), F.col("_us"), *(F.col(f"`{c}`") for c in ties)]
    ranged = shown.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    path = shared_folder(spark, "ordered")
    names = [*df.columns, "_start", "_rank", "_first_tag"]
    ranged.mapInArrow(_packer(width, block_rows, names), BLOCKS).write.options(**WRITE).parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def across(rows: pa.Table) -> pa.Table:
        """What comes into each task's first rows, in the order of the tasks."""
        state, found = (NONE, 0, None), []
        for row in sorted(rows.to_pylist(), key=lambda r: (r["part"], r["origin"])):
            if row["origin"]:
                state = (row["last_start"], row["last_count"], row["last_tag"])
            else:
                found.append((row["part"], *state))
                state = _read(row).follow(state, width)
        return _states(found, ("part", "start", "count", "tag"))

    tables = blocks.drop("rows")
    # a task's first key, and its last one where that begins in the task
    ends = F.struct(F.col("last_key").alias("key"), F.lit(True).alias("origin"))
    firsts_ = F.struct("key", F.lit(False).alias("origin"))
    chained = tables.where("block = -1").withColumn("_end", F.explode(F.when(F.col("open"), F.array(firsts_)).otherwise(F.array(firsts_, ends))))
    chained = chained.select("part", "upto", "starts", "counts", "tags", "n", "last_start", "last_count", "last_tag", "_end.key", "_end.origin")
    into = chained.groupBy("key").applyInArrow(across, f"part long, {STATE}")

    def inside(rows: pa.Table) -> pa.Table:
        """What comes into each block of a task's first key."""
        rows, found = sorted(rows.to_pylist(), key=lambda r: r["block"]), []
        state = (rows[0]["start"], rows[0]["count"], rows[0]["tag"])
        for row in rows:
            found.append((row["part"], row["block"], *state))
            state = _read(row).follow(state, width)
        return _states(found, ("part", "block", "start", "count", "tag"))

    first = tables.where("block >= 0 AND open").drop("key", "last_key", "last_start", "last_count", "last_tag")
    # a few numbers per block: written, so that the plan knows their size and need not shuffle the rows to join them
    carry, states = shared_folder(spark, "carried"), f"part long, block long, {STATE}"
    first.join(into, "part").groupBy("part").applyInArrow(inside, states).write.parquet(carry)
    carried = spark.read.schema(states).parquet(carry)
    schema = df.withColumns({"_start": F.lit(0).cast("long"), "_rank": F.lit(0).cast("long"), "_first_tag": F.lit(None).cast("binary")}).select(*[F.col(f"`{n}`") for n in names]).schema

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.ipc.open_stream(batch["rows"][i].as_buffer()).read_all()
                row = batch.select(["open", "start", "count", "tag"]).slice(i, 1).to_pylist()[0]
                if row["open"]:
                    us_, tags = _arrays(table)
                    firsts = _runs(table["_key"])
                    state = (row["start"], row["count"], row["tag"])
                    starts, ranks, of_first = settle(us_, firsts, successors(us_, firsts, width), tags, state, width)
                    table = _settled(table, starts, ranks, of_first)
                yield from table.select(names).combine_chunks().to_batches()

    packed = blocks.where("block >= 0").select("part", "block", "open", "rows")
    return packed.join(carried, ["part", "block"], "left").select("open", "rows", "start", "count", "tag").mapInArrow(unpacked, schema)
