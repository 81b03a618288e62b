"""Steps whose cost must not grow faster than their input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.llm import common, katz
from hushframe.operators import documents as docs
from hushframe.operators import json_docs, metrics
from hushframe.plans import jobs
from hushframe.plans.policy import Detection, PathLabel, Policy
from queries.documents import _summary


def test_leaves_that_were_only_looked_at_are_one_outcome(spark):
    df = spark.createDataFrame([(1, '{"Name":"Ann Lee","tags":["abcd","efgh"],"n":3}')], "id int, doc string")
    policy = Policy(object_id="o:p:d:t", labels=[PathLabel("name", category="names")], detection=Detection())
    got = sorted(tuple(r)[1:] for r in metrics.outcome_rows(df, policy, F.lit("c"), doc_cols=["doc"]).collect())
    want = [("UNSPECIFIED", "field_rule", 4, 0, 0), ("UNSPECIFIED", "recognizer", 3, 0, 0), ("names", "field_rule", 0, 1, 7)]
    assert got == want


def test_a_report_scans_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        seen.add(1)
        return text

    df = spark.createDataFrame([(i, "abcd") for i in range(8)], "id int, t string").select("id", noted("t").alias("t"))
    jobs.masking_report(df, Policy(detection=Detection()), F.lit("c")).collect()
    assert seen.value == 8


def test_equal_leaves_are_counted_before_texts_are_sorted(spark):
    rows = [("p", "k", True, v) for v in ("b", "a", "b", None)]
    got = _summary(spark.createDataFrame(rows, "path string, key string, is_key boolean, value string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate" in first and "value" in first
    assert [tuple(r) for r in got.collect()] == [("p", "k", True, 4, 2, "a", "b", 3)]


def test_a_plain_walk_lists_keys_and_strings(spark):
    found = json_docs.Leaves(plain=True)
    assert found.document({"a": [1, "x", None, True], "b": {"c": "y"}}, "") == ""
    assert list(zip(*found.columns[:4])) == [("", "a", "a", "key"), ("a[]", "a", "x", "string"), ("", "b", "b", "key"), ("b", "c", "c", "key"), ("b.c", "c", "y", "string")]
    df = spark.createDataFrame([(1, r'["\ud800"]'), (2, '["ok"]')], "id int, j string")
    assert [tuple(r) for r in docs.doc_walk(df, "id", "j").collect()] == [(2, "[]", "", "ok", False)]


def test_both_yaml_readers_hide_the_same():
    yaml = pytest.importorskip("yaml")
    loaders = json_docs._yaml_loader()
    if yaml.__with_libyaml__:
        assert issubclass(loaders[0], yaml.CSafeLoader)
    bodies = ["kind: Secret\ndata:\n  k: v 1\n", "kind: >-\n  Secret\ndata: {a: b, c: 'd'}\n---\nkind: x\n", "kind: [Secret\ndata: x\n", "kind: Secret\nkind: x\ndata: {}\n",
              "items:\n- kind: secret\n  stringData: {long: " + "w " * 80 + "}\n- {n: 1.50, t: 2020-01-01, o: 010, y: yes}\n"]
    for body in bodies:
        assert json_docs.hide_secrets(body, loaders) == json_docs.hide_secrets(body, loaders[-1:])


def test_numbers_of_a_block_take_four_bytes():
    b = katz.Block([True, False], [2, 1], np.array([7, 9], np.uint64), np.array([0, 1, 0]), 3)
    assert {x.dtype for x in (*b.number, *b.count, *b.context_number[1:], *b.context[1:])} == {np.dtype(np.int32)}


def test_backoff_weights_are_sent_where_asked_for():
    keys, ones = np.array([5, 9, 12], np.uint64), np.ones(3)
    sums = [ones * 2, ones, ones / 4, np.array([0, 1, 0])]
    row = {"bucket": 0, "block": 3, "order": 3, "data": katz.joined(katz.squeeze(np.diff(keys, prepend=np.uint64(0))), *map(katz.squeeze, sums))}
    divisors, weights = katz.parted(katz._settle(pa.Table.from_pylist([row]))["data"][0].as_py())
    assert katz.expand(divisors, np.float64).tolist() == [2, 2, 2]
    assert katz.expand(weights, np.float64).tolist() == [0.5 / 0.75]


def test_shuffles_leave_with_the_write(spark):
    before = spark.conf.get(common.CLEANUP, None)
    df = common.written(spark.range(1000).repartition(7, "id"), "cleaned")
    assert df.count() == 1000 and spark.conf.get(common.CLEANUP, None) == before
    seen = []
    real = df.sparkSession.conf.set
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.conf), "set", lambda self, k, v: (seen.append((k, v)), real(k, v))[1])
        common.written(spark.range(10).repartition(2, "id"), "cleaned")
    assert (common.CLEANUP, "true") in seen
