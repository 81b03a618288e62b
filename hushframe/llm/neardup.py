"""N-gram Jaccard self-join of documents with MinHash banding and exact verification.

Documents are sets of hashed shingles of five consecutive words (letters, digits and all characters beyond ASCII,
A-Z lower-cased; fewer words are one shingle). Texts with the same words are one class; everything after that works
on classes. Every class has a label in each of `TREES` bands (`tree`), a sequence of MinHash values of a length that is
fixed beforehand: the longest, up to `DEEPEST`, at which two documents at the threshold share one with the target
recall; with the defaults that is three values and a recall of 0.9999994. It is no LSH forest: no tries are built and
nothing is shortened by what matched. Equal labels in a band are the candidates' groups. Each group is dealt to pairs of chunks of bounded size, so a hot group is
spread over many tasks; a pair of classes is taken in the first trie in which it meets only, and its shingle sets are
compared exactly. Tasks give link counts and spanning links, never pairs; components come from repeated joins.

Only classes that meet another one get their shingles made. Nothing is capped or sampled.

Defined cases: null and empty texts (no words) link with nothing and are a class for themselves; repeated rows are
copies of each other; a null id takes part and can only be the component's name if all ids there are null; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Lexicon, fmix, numbered, slices, texts_of, word_hashes, written
from hushframe.llm.components import components
from hushframe.llm.decontaminate import words

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEEPEST = 8
RECALL = 0.999999
CHUNK_CLASSES = 1024
CHUNK_SHINGLES = 2_000_000
SIGNED = "struct<fp:string,n:long,label:binary>"


def forest_depth(trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix with which a pair at the threshold meets in some trie with the wanted probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts, their shingles' hashes one text after another, and how many shingles each has."""
    lists = [words(t) for t in texts]
    lexicon = Lexicon()
    ids, sizes = numbered(lists, lexicon)
    hashed = np.append(fmix(word_hashes(list(lexicon)))[ids] if len(ids) else np.zeros(0, np.uint64), np.zeros(size, np.uint64))
    counts = np.where(sizes > 0, np.maximum(1, sizes - size + 1), 0)
    of = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
    at = (np.cumsum(sizes) - sizes)[of] + inside
    length = np.minimum(sizes, size)[of]
    out = length.astype(np.uint64)
    for j in range(size):
        there = np.where(j < length, hashed[at + j], np.uint64(0))
        out = fmix(out * np.uint64(0x9E3779B97F4A7C15) + there)
    return lists, out, counts


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """`n` MinHash values for each text with shingles."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), n), np.uint32)
    made = np.empty_like(hashes)
    for k in range(n if len(starts) else 0):
        np.multiply(hashes, factors[k], out=made)
        np.add(made, adds[k], out=made)
        np.bitwise_xor(made, made >> np.uint64(29), out=made)
        least = np.minimum.reduceat(made, starts)
        out[:, k] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return out


def _signed(depth: int, trees: int) -> object:
    @F.arrow_udf(SIGNED)
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            prints, numbers, labels = [], [], []
            for some in slices(column, 4 << 20):
                lists, hashes, counts = shingles(texts_of(some))
                made = signatures(hashes, counts, depth * trees)
                rows = iter(made)
                prints += [hashlib.md5(b" ".join(x)).hexdigest() if x else None for x in lists]
                labels += [next(rows).astype("<u4").tobytes() if c else None for c in counts.tolist()]
                numbers += counts.tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(prints, pa.string()), pa.array(numbers, pa.int64()), pa.array(labels, pa.binary())], ["fp", "n", "label"]
            )

    return signed


def _shingle_set(text: Column) -> Column:
    @F.arrow_udf("binary")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for some in slices(column, 4 << 20):
                _, hashes, counts = shingles(texts_of(some))
                out += [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])]
            yield pa.array(out, pa.binary())

    return made(text)


def _meetings(labels: np.ndarray, depth: int, tree: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the two sides that share a prefix in this trie and in none before."""
    keys = labels.reshape(len(labels), -1, depth)
    flat = np.ascontiguousarray(keys).view(f"V{4 * depth}").reshape(len(labels), -1)
    met = None
    for t in range(tree + 1):
        _, number = np.unique(flat[:, t], return_inverse=True)
        same = number[left][:, None] == number[right][None, :]
        met = same if met is None else same & ~earlier if t == tree else same
        earlier = same if t == 0 else earlier | same
    return np.nonzero(met)


def _sides(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray, bool]:
    """The trie, the rows of either chunk, and if both are the same."""
    x, y, chunk = group.column("x")[0].as_py(), group.column("y")[0].as_py(), group.column("chunk").to_numpy()
    return group.column("tree")[0].as_py(), np.flatnonzero(chunk == x), np.flatnonzero(chunk == y), x == y


def _pairs(group: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
    tree, left, right, alike = _sides(group)
    labels = np.frombuffer(b"".join(group.column("label").to_pylist()), "<u4").reshape(len(group), -1)
    a, b = _meetings(labels, depth, tree, left, right)
    if alike:
        a, b = a[a < b], b[a < b]
    return left[a], right[b]


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the sets' intersections for each pair."""
    if len(a) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    all_, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = count[inverse] > 1  # what one set has alone is in no intersection
    place = np.cumsum(count > 1) - 1
    of, at = of[common], place[inverse[common]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 2048
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        here = slice(*np.searchsorted(at, [first, first + width]))
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[of[here], at[here] - first] = 1
        total += matrix @ matrix.T
    return total[a, b].astype(np.int64)


def similar_classes(docs: DataFrame, doc_id: str, text: str, threshold: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, fp); classes (fp, copies, least); links (fp, links, root)."""
    depth = forest_depth(trees, threshold, recall)
    none = -(1 << 63)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = named.select("doc_id", _signed(depth, trees)("text").alias("s"))
    rows = written(signed.select("doc_id", "s.fp", "s.n", "s.label"), "neardup")
    classes = written(
        rows.where("fp is not null").groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("label").alias("label")),
        "neardup",
    )
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring("label", t * (4 * depth) + 1, F.lit(4 * depth))).alias("node")))
    places = classes.select("fp", "n", F.explode(prefixes).alias("p")).select("fp", "n", "p.tree", "p.node")
    nodes = places.groupBy("tree", "node").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("m > 1")
    nodes = nodes.select("tree", "node", F.greatest(F.ceil(F.col("m") / CHUNK_CLASSES), F.ceil(F.col("all") / CHUNK_SHINGLES)).alias("chunks"))
    met = places.join(nodes, ["tree", "node"]).select("tree", "node", "fp", "chunks", F.pmod(F.xxhash64("fp"), "chunks").alias("chunk"))
    each = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    dealt = met.select("tree", "node", "fp", "chunk", F.explode(each).alias("other"))
    dealt = dealt.select("tree", "node", "fp", "chunk", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))
    groups = ["tree", "node", "x", "y"]

    def first_met(group: pa.Table) -> pa.Table:
        a, b = _pairs(group, depth)
        return group.take(pa.array(np.unique(np.concatenate([a, b])))).select([*groups, "chunk", "fp", "label", "copies"])

    schema = "tree int, node long, x long, y long, chunk long, fp string, label binary, copies long"
    labelled = dealt.join(classes.select("fp", "label", "copies"), "fp").select(*[c.split()[0] for c in schema.split(", ")])
    pairs = written(labelled.groupBy(*groups).applyInArrow(first_met, schema), "neardup")
    wanted = pairs.select("fp").distinct().join(classes.select("fp", F.coalesce("least", F.lit(none)).alias("id")), "fp")
    texts = named.select(F.coalesce("doc_id", F.lit(none)).alias("id"), "text").join(wanted, "id").select("fp", "id", "text")
    # An id may have other texts too: only the text with the class's fingerprint counts.
    texts = texts.select("fp", "text", _signed(1, 1)("text").alias("s")).where("fp = s.fp").select("fp", _shingle_set(F.col("text")).alias("set"))
    sets = texts.groupBy("fp").agg(F.first("set").alias("set"))

    def verified(group: pa.Table) -> pa.Table:
        a, b = _pairs(group, depth)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        possible = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
        a, b = a[possible], b[possible]
        both = _shared(sets, a, b)
        # In whole numbers as far as they go: both / union >= threshold.
        linked = both + 1e-9 >= threshold * (size[a] + size[b] - both)
        a, b = a[linked], b[linked]
        copies = group.column("copies").to_numpy()
        links = np.bincount(a, copies[b], len(sets)) + np.bincount(b, copies[a], len(sets))
        root = np.arange(len(sets))
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links > 0)
        fp = group.column("fp")
        return pa.table({"fp": fp.take(pa.array(some)), "links": pa.array(links[some].astype(np.int64)), "root": fp.take(pa.array(root[some]))})

    found = pairs.join(sets, "fp").groupBy(*groups).applyInArrow(verified, "fp string, links long, root string")
    return rows, classes, written(found, "neardup")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, n_links (other rows linked to it), component_id (least id of its component), kept, fp, root.

    Links are between rows with a similarity of `threshold` or more, copies included. `kept` holds for the rows
    whose id names their component. `fp` tells texts of the same words, `root` components; null without words.
    """
    rows, classes, found = similar_classes(docs, doc_id, text, threshold, trees, recall)
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    parts = parts.join(classes.select(F.col("fp").alias("node"), "least"), "node")
    names = parts.groupBy("component").agg(F.min("least").alias("name"))
    named = parts.join(names, "component").select(F.col("node").alias("fp"), "name", F.col("component").alias("root"))
    by_class = classes.select("fp", "copies", "least").join(links, "fp", "left").join(named, "fp", "left")
    by_class = by_class.select(
        "fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    out = rows.where("fp is not null").select("doc_id", "fp").join(by_class, "fp").select("doc_id", "n_links", "component_id", "fp", "root")
    out = out.union(rows.where("fp is null").select("doc_id", F.lit(0).cast("long"), "doc_id", "fp", "fp"))
    return out.select("doc_id", "n_links", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "fp", "root")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, with the columns it came with; texts without words all stay.

    It is a row of the least id (a row without an id only where no row has one), of its texts the one with the least
    fingerprint, and of equal rows any.
    """
    kept = near_duplicates(docs, doc_id, text, **options).where("kept and fp is not null")
    kept = kept.groupBy("root", F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).agg(F.count("*").alias("_n"))
    kept = kept.groupBy("root").agg(F.min(F.struct("_fp", "_id", "_n")).alias("_k")).select("_k.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("_row"), F.col(doc_id).cast("long").alias("_of"), _signed(1, 1)(F.col(text)).alias("_s"))
    named = written(named.select("_row", "_of", F.col("_s.fp").alias("_print")), "neardup")
    met = named.where("_print is not null").join(kept, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_fp")))
    repeated = met.where("_n > 1").groupBy("_id", "_fp").agg(F.first("_row").alias("_row"))
    return named.where("_print is null").select("_row.*").union(met.where("_n = 1").select("_row.*")).union(repeated.select("_row.*"))
