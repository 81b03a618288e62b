"""Token ids in files of range asymmetric numeral system (rANS) blocks.

One frequency table, counted over all ids and scaled to 2**SCALE, is shared by all blocks. A block is coded by
`LANES` interleaved states: symbol i belongs to lane i mod LANES, so encoding and decoding work on vectors. Every
`CHECK` symbols per lane the block keeps a checkpoint (states and place in the stream) from which decoding can
begin. Blocks hold whole documents, need nothing but the table, and are decoded in parallel.

Block, little-endian: `RANS`, version u32, symbols u64, lanes u32, steps between checkpoints u32, checkpoints u32,
words u64, crc32 of the ids u32, then per checkpoint the place in words u64 and the lanes' states u64, the words u32,
and the crc32 of all bytes before it u32.

Files: Parquet with one row per block: (first id's place, document ids, sizes, block), ordered by document id over
the parts' names; the table beside them as (id, frequency).

Defined cases: null and empty texts consist of the end id; null ids sort first; equal ids are written next to each
other, in the order of a hash of their texts; an empty table gives no rows; a damaged block raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.tokens import token_blocks, unpacked
from hushframe.session import shared_folder

SCALE = 20
LANES = 4096
CHECK = 32
LOW = np.uint64(1 << 31)
HEAD = "<4sIQIIIQI"
FILE = "part long, block long, first long, doc_ids array<long>, sizes array<long>, data binary"
DOCS = "doc_id long, start long, ids binary"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale; every id that occurs gets at least 1."""
    some = counts > 0
    if not some.any():
        return np.zeros(len(counts), np.int64)
    total = int(counts.sum())
    exact = counts.astype(np.float64) * ((1 << scale) / total)
    out = np.where(some, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    left = (1 << scale) - int(out.sum())
    order = np.argsort(-out, kind="stable")
    while left:  # the most frequent ids feel a change least
        for i in order[: min(abs(left), int(some.sum()))]:
            if left > 0 or out[i] > 1:
                out[i] += 1 if left > 0 else -1
                left += -1 if left > 0 else 1
            if not left:
                break
    return out


def encode(ids: np.ndarray, frequency: np.ndarray, lanes: int = LANES, check: int = CHECK) -> bytes:
    """One block."""
    n = len(ids)
    steps = -(-n // lanes)
    cumulative = np.cumsum(frequency) - frequency
    padded = np.full(steps * lanes, int(frequency.argmax()), np.int64)
    padded[:n] = ids
    f, c = (x[padded].astype(np.uint64).reshape(steps, lanes) for x in (frequency, cumulative))
    x, scale = np.full(lanes, LOW, np.uint64), np.uint64(SCALE)
    words, points, left = [], [], 0
    for k in range(steps - 1, -1, -1):
        if (k + 1) % check == 0 or k == steps - 1:
            points.append((k + 1, left, x.copy()))
        full = x >= (f[k] << np.uint64(63 - SCALE))
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        words.append(out)
        left += len(out)
        x = np.where(full, x >> np.uint64(32), x)
        whole = x // f[k]
        x = (whole << scale) + (x - whole * f[k]) + c[k]
    points.append((0, left, x))
    points = [(left - at, states) for step, at, states in points[::-1] if step % check == 0 and step < max(1, steps)]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    raw = ids.astype("<u4").tobytes()
    head = struct.pack(HEAD, b"RANS", 1, n, lanes, check, len(points), len(stream), zlib.crc32(raw))
    body = b"".join(struct.pack("<Q", at) + states.astype("<u8").tobytes() for at, states in points)
    data = head + body + stream.tobytes()
    return data + struct.pack("<I", zlib.crc32(data))


class Decoder:
    """Reads blocks that were written with one frequency table."""

    def __init__(self, frequency: np.ndarray):
        cumulative = np.cumsum(frequency) - frequency
        self.frequency, self.cumulative = frequency.astype(np.uint64), cumulative.astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)

    def decode(self, data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The block's ids from `first` to before `last`, from the nearest checkpoint on."""
        size = struct.calcsize(HEAD)
        if len(data) < size + 4 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("damaged block: its checksum differs")
        magic, version, n, lanes, check, points, words, crc = struct.unpack(HEAD, data[:size])
        if magic != b"RANS" or version != 1:
            raise ValueError("not a block of this format")
        last = n if last is None else min(last, n)
        stream = np.frombuffer(data, "<u4", words, size + points * (8 + 8 * lanes))
        point = min(first // (lanes * check), max(0, points - 1))
        at = struct.unpack_from("<Q", data, size + point * (8 + 8 * lanes))[0]
        x = np.frombuffer(data, "<u8", lanes, size + point * (8 + 8 * lanes) + 8).copy()
        begin, steps = point * check, -(-last // lanes)
        out = np.empty((max(0, steps - begin), lanes), np.uint32)
        mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for k in range(len(out)):
            slot = x & mask
            symbol = self.symbol[slot]
            out[k] = symbol
            x = self.frequency[symbol] * (x >> scale) + slot - self.cumulative[symbol]
            short = np.flatnonzero(x < LOW)
            x[short] = (x[short] << np.uint64(32)) | stream[at : at + len(short)]
            at += len(short)
        ids = out.reshape(-1)[first - begin * lanes : last - begin * lanes]
        if first == 0 and last == n and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("damaged block: its ids differ")
        return ids


def write(docs: DataFrame, path: str, folder: str, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all documents, in ascending order of their ids, into files below `folder`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = token_blocks(ordered, F.col("doc_id"), F.lit(None), F.col("text"), path, end, "rans")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = np.bincount(unpacked(data))
                total, found = (total, found) if len(total) >= len(found) else (found, total)
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.collect()  # at most one row per id of the vocabulary
    table = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for r in found:
        table[r["id"]] = r["n"]
    frequency = scaled(table)
    spark.createDataFrame([(i, f) for i, f in enumerate(frequency.tolist()) if f], "id long, frequency long").coalesce(1).write.parquet(f"{folder}/table")

    sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    # One number per partition: the ids in the partitions before it.
    parts = blocks.select("part", sizes.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before = dict(zip([r["part"] for r in parts], np.cumsum([0] + [r["n"] for r in parts]).tolist()))
    sent = spark.sparkContext.broadcast((frequency, before))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, before = sent.value
        for batch in batches:
            data = [encode(unpacked(x), frequency) for x in batch.column("ids").to_pylist()]
            first = [before[p] + at for p, at in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist())]
            made = [*(batch.column(c) for c in ("part", "block")), pa.array(first, pa.int64()), *(batch.column(c) for c in ("doc_ids", "sizes")), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, [c.split()[0] for c in FILE.split(", ")])

    encoded = blocks.select("part", "block", "at", "doc_ids", "sizes", "ids").mapInArrow(coded, FILE)
    encoded.write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of the files: DOCS."""
    rows = spark.read.schema("id long, frequency long").parquet(f"{folder}/table").collect()  # one per id at most
    frequency = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        frequency[r["id"]] = r["frequency"]
    sent = spark.sparkContext.broadcast(frequency)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                data = decoder.decode(row["data"]).astype("<u4").tobytes()
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                begins = ends - np.array(row["sizes"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(begins + row["first"]),
                        pa.array([data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    blocks = spark.read.schema(FILE).parquet(f"{folder}/blocks")
    return blocks.select("first", "doc_ids", "sizes", "data").mapInArrow(decoded, DOCS)


def round_trip(docs: DataFrame, path: str, end: int = 2, folder: str | None = None, **names) -> DataFrame:
    """Write the documents and read them back."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    write(docs, path, folder, end, **names)
    return read(docs.sparkSession, folder)
