"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets 64 signs of random projections; vectors are sorted by them as one lexicographic key
and compared with the `WINDOW` vectors behind it. Vectors whose leading signs agree form a run; runs longer than the
window are compared in full, in chunks of bounded size, so two vectors within the threshold meet in every pass in
which those signs agree, however many others lie around them. That probability does not depend on the data, and the
number of passes follows from it and the wanted recall. How many signs a run has only decides about the work: it is
chosen by the angles inside a sample of the vectors. The vectors are not centred, as angles around a mean have no
bound. Verified pairs are united over all passes; inside every component that they give, all pairs are compared in
chunks as well, which gives the links. Tasks give counts and spanning links only.

Equal vectors are one class. Cosines are computed in double precision.

Defined cases: null vectors, vectors of zeros and those that hold null or non-finite components link with nothing;
vectors of different lengths are never compared; a null id takes part and only names a component of null ids;
repeated rows are copies of each other; an empty table gives no rows. Labels play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import written
from hushframe.llm.components import components

THRESHOLD = 0.95
WINDOW = 256
RECALL = 0.999
CHUNK = 2048
ROW = "turn int, dim int, key binary, fp string, vec binary"
RUN = "turn int, dim int, prefix long, fp string"
SCANNED = "border long, turn int, dim int, key binary, fp string, vec binary, other string"
SAMPLE = 1024  # vectors whose angles are looked at
MOST_SIGNS = 48


def passes_for(signs: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has agreed in its first signs with the wanted probability."""
    once = (1 - math.acos(threshold) / math.pi) ** signs
    return max(4, math.ceil(math.log(1 - recall) / math.log1p(-once)))


def signs_for(vectors: int, sample: list[np.ndarray], threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """The leading signs of a run with the least work over all passes. `sample` has one matrix for each length."""
    agree, pairs = [np.zeros(0)], sum(map(len, sample)) * max(1, sum(map(len, sample)) - 1)
    for x in sample:
        near = 1 - np.arccos(np.clip(_cosines(x, x), -1, 1)) / math.pi
        agree.append(near[~np.eye(len(x), dtype=bool)])
    agree = np.concatenate(agree)

    def work(signs: int) -> float:
        return passes_for(signs, threshold, recall) * (window + vectors * float((agree**signs).sum()) / max(1, pairs))

    return min(range(1, MOST_SIGNS + 1), key=work)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length; each is divided by its largest component."""
    rows = column.to_pylist()
    raw = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    return raw / np.abs(raw).max(axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of `n` members reaches over the pairs."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def window_roots(x: np.ndarray, window: int, threshold: float, split: int | None = None) -> np.ndarray:
    """Roots over all pairs at most `window` apart; with `split`, only over pairs on either side of it."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(x), window):
        a, b = np.nonzero(_cosines(x[i : i + window], x[i : i + 2 * window]) >= threshold)
        ok = (a < b) & (b - a <= window)
        if split is not None:
            ok &= (a + i < split) & (b + i >= split)
        left.append(a[ok] + i)
        right.append(b[ok] + i)
    return _roots(len(x), np.concatenate(left), np.concatenate(right))


def _classed():
    @F.arrow_udf("struct<fp:string,dim:int,vec:binary>")
    def classed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for row in column.to_pylist():
                ok = row is not None and len(row) > 0 and None not in row
                x = np.array(row, "<f8") + 0.0 if ok else np.zeros(0)
                if ok and np.isfinite(x).all() and x.any():
                    out.append({"fp": hashlib.md5(x.tobytes()).hexdigest(), "dim": len(x), "vec": x.tobytes()})
                else:
                    out.append({"fp": None, "dim": None, "vec": None})
            yield pa.array(out, pa.struct([("fp", pa.string()), ("dim", pa.int32()), ("vec", pa.binary())]))

    return classed


def _signs(x: np.ndarray, turn: int) -> np.ndarray:
    return x @ np.random.default_rng([x.shape[1], turn]).standard_normal((x.shape[1], 64)) > 0


def _keys(passes: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = matrix(rows.column("vec"))
                for k in range(passes):
                    bits = np.packbits(_signs(x, k), axis=1)
                    n = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * n, pa.int32()), rows.column("dim"), pa.array([r.tobytes() for r in bits], pa.binary()), rows.column("fp"), rows.column("vec")],
                        [c.split()[0] for c in ROW.split(", ")],
                    )

    return keyed


def _runs(passes: int, signs: int):
    """The first signs of every vector in every pass, as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = matrix(rows.column("vec"))
                for k in range(passes):
                    prefix = _signs(x, k)[:, :signs] @ (1 << np.arange(signs, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(x), pa.int32()), rows.column("dim"), pa.array(prefix, pa.int64()), rows.column("fp")],
                        [c.split()[0] for c in RUN.split(", ")],
                    )

    return run


def _dealt(members: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """Members (group, fp) for every pair (x, y) of the group's chunks that needs them; `sizes` has the chunks."""
    members = members.join(sizes, group).withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks"))
    dealt = members.select(*group, "fp", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    return dealt.select(*group, "fp", "chunk", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))


def _linked(threshold: float):
    """Spanning links between two chunks of a run."""

    def linked(group: pa.Table) -> pa.Table:
        chunk, x, y = group.column("chunk").to_numpy(), group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left, right = np.flatnonzero(chunk == x), np.flatnonzero(chunk == y)
        v = matrix(group.column("vec"))
        a, b = np.nonzero(_cosines(v[left], v[right]) >= threshold)
        root = _roots(len(v), left[a], right[b])
        some, fp = np.flatnonzero(root != np.arange(len(root))), group.column("fp")
        return pa.table({"a": fp.take(pa.array(some)), "b": fp.take(pa.array(root[some]))})

    return linked


def _borders(tails: dict[int, int], window: int) -> list[tuple[int, int]]:
    """The borders (behind a partition) that each partition's last rows go to: further ones over short partitions.

    `tails` has the rows of each partition that has any, at most `window`.
    """
    last, out = max(tails, default=-1), []
    for part in tails:
        between, border = 0, part
        while border < last and between < window:
            out.append((part, border))
            border += 1
            between += tails.get(border, 0)
    return out


def _scan(window: int, threshold: float):
    """Links inside a sorted partition, and its first and last rows (border: the partition, other: which of both)."""
    names = [c.split()[0] for c in SCANNED.split(", ")]

    def out(table: pa.Table, border: int | None, other: pa.Array | None) -> pa.RecordBatch:
        n = len(table)
        made = [pa.array([border] * n, pa.int64()), *(table.column(c).combine_chunks() for c in ("turn", "dim", "key", "fp", "vec")), other if other is not None else pa.nulls(n, pa.string())]
        made = [m.cast(t) for m, t in zip(made, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.string()))]
        if border is None:
            made[3] = made[5] = pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays(made, names)

    def side(held: pa.Table, name: str) -> pa.Array:
        return pa.array([name] * min(len(held), window), pa.string())

    def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = table.column("turn").to_numpy().astype(np.int64) << 32 | table.column("dim").to_numpy()
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for first, last in zip([0, *cuts], [*cuts, len(table)]):
            rows = table.slice(first, last - first)
            root = window_roots(matrix(rows.column("vec")), window, threshold) if last > first else np.zeros(0, np.int64)
            some = np.flatnonzero(root != np.arange(len(root)))
            if len(some):
                fp = rows.column("fp").combine_chunks()
                yield out(rows.take(pa.array(some)), None, fp.take(pa.array(root[some])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if first and len(held) >= window or len(held) >= 8 * window:
                if first:
                    yield out(held.slice(0, window), part, side(held, "first"))
                    first = False
                yield from linked(held)
                held = held.slice(max(0, len(held) - window))
        if held is not None and len(held):
            if first:
                yield out(held.slice(0, window), part, side(held, "first"))
            yield from linked(held)
            yield out(held.slice(max(0, len(held) - window)), part, side(held, "last"))

    return scan


def near_duplicate_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    window: int = WINDOW,
    recall: float = RECALL,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id (least id of its component), kept (its id names the component)."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = written(named.select("vec_id", _classed()("e").alias("c")).select("vec_id", "c.fp", "c.dim", "c.vec"), "vectors")
    valid = rows.where("fp is not null")
    classes = written(
        valid.groupBy("fp").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vec").alias("vec")),
        "vectors",
    )
    # Fingerprints are random: the least are a sample of bounded size.
    seen: dict[int, list[bytes]] = {}
    for r in classes.orderBy("fp").select("dim", "vec").limit(SAMPLE).collect():
        seen.setdefault(r["dim"], []).append(bytes(r["vec"]))
    sample = [matrix(pa.array(x, pa.binary())) for x in seen.values()]
    signs = signs_for(classes.count(), sample, threshold, window, recall)
    passes = passes_for(signs, threshold, recall)
    keyed = classes.select("dim", "fp", "vec").mapInArrow(_keys(passes), ROW)
    order = ["turn", "dim", "key", "fp"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = written(ordered.mapInArrow(_scan(window, threshold), SCANNED), "vectors")

    def at_border(group: pa.Table) -> pa.Table:
        left, right = [], []
        keys = group.column("turn").to_numpy().astype(np.int64) << 32 | group.column("dim").to_numpy()
        for key in np.unique(keys):
            rows = group.take(pa.array(np.flatnonzero(keys == key))).sort_by([("key", "ascending"), ("fp", "ascending")])
            root = window_roots(matrix(rows.column("vec")), window, threshold)
            some = np.flatnonzero(root != np.arange(len(root)))
            fp = rows.column("fp")
            left += fp.take(pa.array(some)).to_pylist()
            right += fp.take(pa.array(root[some])).to_pylist()
        return pa.table({"a": pa.array(left, pa.string()), "b": pa.array(right, pa.string())})

    links = scanned.where("border is null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    edges = scanned.where("border is not null").withColumnRenamed("border", "part")
    tails = {r["part"]: r["n"] for r in edges.where("other = 'last'").groupBy("part").agg(F.count("*").alias("n")).collect()}
    goals = spark.createDataFrame(_borders(tails, window), "part long, border long")
    meet = ["border", "turn", "dim", "key", "fp", "vec"]
    borders = edges.where("other = 'last'").join(goals, "part").select(*meet)
    borders = borders.union(edges.where("other = 'first'").withColumn("border", F.col("part") - 1).select(*meet))
    links = links.union(borders.groupBy("border").applyInArrow(at_border, "a string, b string"))

    run = ["turn", "dim", "prefix"]
    runs = written(classes.select("dim", "fp", "vec").mapInArrow(_runs(passes, signs), RUN), "vectors")
    long = runs.groupBy(*run).agg(F.count("*").alias("n")).where(F.col("n") > window).select(*run, F.ceil(F.col("n") / CHUNK).alias("chunks"))
    crowd = _dealt(runs, long, run).join(classes.select("fp", "vec"), "fp").select(*run, "x", "y", "chunk", "fp", "vec")
    links = links.union(crowd.groupBy(*run, "x", "y").applyInArrow(_linked(threshold), "a string, b string"))
    parts = written(components(links), "vectors")

    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = _dealt(parts.select("component", F.col("node").alias("fp")), sizes, ["component"])

    def counted(group: pa.Table) -> pa.Table:
        chunk, x, y = group.column("chunk").to_numpy(), group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left, right = np.flatnonzero(chunk == x), np.flatnonzero(chunk == y)
        v, copies = matrix(group.column("vec")), group.column("copies").to_numpy()
        near = _cosines(v[left], v[right]) >= threshold
        if x == y:
            np.fill_diagonal(near, False)
            links = near @ copies
        else:
            links = np.zeros(len(v), np.int64)
            links[left], links[right] = near @ copies[right], near.T @ copies[left]
        return pa.table({"fp": group.column("fp"), "links": pa.array(links.astype(np.int64))})

    filled = dealt.join(classes.select("fp", "copies", "vec"), "fp").select("component", "x", "y", "chunk", "fp", "copies", "vec")
    counts = filled.groupBy("component", "x", "y").applyInArrow(counted, "fp string, links long").groupBy("fp").agg(F.sum("links").alias("links"))
    least = parts.join(classes.select(F.col("fp").alias("node"), "least"), "node")
    names = least.groupBy("component").agg(F.min("least").alias("name"))
    named_parts = least.join(names, "component").select(F.col("node").alias("fp"), "name")
    by_class = classes.select("fp", "copies", "least").join(counts, "fp", "left").join(named_parts, "fp", "left")
    by_class = by_class.select("fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id"))
    found = valid.select("vec_id", "fp").join(by_class, "fp").select("vec_id", "n_links", "component_id")
    found = found.union(rows.where("fp is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
