"""The pipeline, and the registered queries against SQL."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hushframe.llm import language, quality
from hushframe.llm.decontaminate import words
from hushframe.llm.registry import QUERIES, SQL
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, FOLDER, QUERIES, SQL) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, before, FOLDER), name)
        assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in before.collect()}
        kept[name], before = {r["doc_id"]: r["text"] for r in docs.collect()}, docs
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum((d in kept["quality_classifier"]) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)

    def shingles(text):
        w = words((text or "").encode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in kept["language_id"].items()}
    left = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((left[a], left[b]))
                left = {d: low if c == high else c for d, c in left.items()}
    assert set(kept["jaccard_join"]) == set(left.values())
    items = [words(r["text"].encode()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(len(w) - min(10, len(w)) + 1) if w}

    def hit(text):
        w = words(text.encode())
        return any(tuple(w[i : i + m]) in windows for m in {len(x) for x in windows} for i in range(len(w) - m + 1))

    assert set(kept["decontamination"]) == {d for d, t in kept["jaccard_join"].items() if not hit(t)}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {p["doc_id"] for p in pieces} == set(kept["decontamination"]) and given


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op6_quality"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = found.collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    found = QUERIES["op9_language"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    rows = found.collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert quality.THRESHOLD == 0.3 and language.PROBES == 3
