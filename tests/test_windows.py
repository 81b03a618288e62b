import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from hushframe.operators import ordered
from hushframe.operators import windows as win
from hushframe.operators.ordered import successors, windows_in_order

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_micros_of_both_timestamp_types(spark):
    df = spark.createDataFrame([(1,)], "i int").select(
        F.expr("TIMESTAMP_NTZ'2024-03-10 02:30:07.179575'").alias("n"),
        F.expr("TIMESTAMP'2024-03-10 02:30:07.179575Z'").alias("t"),
        F.expr("TIMESTAMP_NTZ'1969-12-31 23:59:59.5'").alias("old"),
    )
    row = df.select(win.micros(df, "n"), win.micros(df, "t"), win.micros(df, "old")).first()
    assert row[0] == row[1] == 1710037807179575 and row[2] == -500000


def test_transcript_cap(spark):
    rng = random.Random(5)
    rows = []
    for s in range(6):
        for n in range(rng.choice([1, 30, 200])):
            rows.append((s if s else None, n, "é" * rng.choice([0, 1, 5, 20])))
    df = spark.createDataFrame(rows, "s int, n int, t string")
    got = {(r["s"], r["n"]): (r["seq"], r["kept"], r["truncated"]) for r in win.transcript_cap(df, "s", "n", "t", 700, block_rows=16).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        total, seq, cut, mine = 0, 0, False, [r for r in rows if r[0] == s]
        for _, n, t in mine:
            size = len(t.encode())
            if size == 0:
                want[s, n] = (None, False)
            elif cut or total + size > 700:
                cut = True
                want[s, n] = (None, False)
            else:
                total += size
                want[s, n] = (seq, True)
                seq += 1
        for _, n, _t in mine:
            want[s, n] = (*want[s, n], cut)
    assert got == want


def flags_by_hand(rows, limit, width):
    start, count, out = {}, {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in start or t - start[key] >= width:
            start[key], count[key] = t, 1
        else:
            count[key] += 1
        out[i] = count[key] > limit
    return out


def test_rate_flags_against_a_loop(spark):
    rng = random.Random(7)
    rows, i = [], 0
    for key, n, span in (("hot", 4000, 40_000), ("warm", 300, 50_000), ("cold", 5, 90_000), ("burst", 200, 3)):
        for _ in range(n):
            rows.append((key, rng.randrange(span * 1000) * 1000 - 5_000_000_000, i))
            i += 1
    df = spark.createDataFrame(rows, "k string, us bigint, i int")
    got = {r["i"]: r["flagged"] for r in win.rate_flags(df, "k", "us", 4, 60, tie=["i"]).collect()}
    assert got == flags_by_hand(rows, 4, 60 * win.SECOND)


def test_rate_flags_small_cases(spark):
    rows = [("a", at(s), i) for i, s in enumerate([0, 1, 2, 59, 60, 61, 200])] + [("", at(0), 90), (None, at(0), 91)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    flagged = {r["i"] for r in win.rate_flags(df, "k", "ts", 2).collect() if r["flagged"]}
    assert flagged == {2, 3}
    off = win.rate_flags(df, "k", "ts", 0)
    assert off.filter("flagged").count() == 0 and off.count() == len(rows)
    assert win.rate_flags(df, "k", "ts", 1).count() == len(rows)


def test_windows_cross_blocks(spark):
    rng = random.Random(3)
    for n, widths, group in ((1500, 2, 3), (60, 1, 4), (300, 4, 1), (300, 1, 1), (25, 2, 128)):
        times = sorted(rng.sample(range(-5_000, 20_000), n))
        df = spark.createDataFrame([("k", t) for t in times], "k string, t bigint")
        out = win.anchored_windows(df, ["k"], "t", 100, widths, group)
        want, start = {}, None
        for t in times:
            if start is None or t - start >= 100:
                start = t
            want[t] = start
        assert {r["t"]: r["window_start"] for r in out.collect()} == want


def test_idempotent_dedup(spark):
    rows = [
        (1, "k", "insert 1", at(0)),
        (2, "k", "insert 1", at(100)),
        (3, "k", "insert 2", at(200)),
        (4, "k", "insert 1", at(600)),  # the entry holds at the very end
        (5, "k", "insert 2", at(601)),  # and is gone after it
        (6, "k", "insert 1", at(700)),
        (7, "other", "insert 1", at(0)),
        (8, None, "insert 1", at(0)),
        (9, "", "insert 1", at(0)),
    ]
    df = spark.createDataFrame(rows, "i int, k string, q string, ts timestamp")
    got = {r["i"]: r["status"] for r in win.idempotent_dedup(df, "k", ["q"], "ts", tie=["i"]).collect()}
    assert got == {1: "new", 2: "duplicate", 3: "conflict", 4: "duplicate", 5: "new", 6: "conflict", 7: "new", 8: "new", 9: "new"}


def test_peak_concurrency(spark):
    rng = random.Random(11)
    rows = []
    for org in ("a", "b"):
        for _ in range(200):
            s = rng.randrange(30_000)
            rows.append((org, at(s), at(s + rng.randrange(0, 4000)) if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "org string, s timestamp, e timestamp")
    out = {r["org"]: r for r in win.peak_concurrency(df, "org", "s", "e", cap=10).collect()}
    for org in ("a", "b"):
        marks = sorted([(s, 1) for o, s, e in rows if o == org] + [(e, -1) for o, s, e in rows if o == org and e])
        open_now = peak = 0
        for t, step in marks:
            open_now += step
            peak = max(peak, open_now)
        assert out[org]["peak"] == peak and out[org]["over_cap"] == (peak > 10)


def test_running_total_shuffles_rows_once(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = win.running_total(df, ["k"], [F.col("id")], {"s": F.col("v")}, F.floor(F.col("id") / 100))
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the rows once; the block totals for their sum, per key, and for the join
        assert plan.count("Exchange hashpartitioning") == 4
        rows = {r["id"]: r["s"] for r in out.collect()}
        assert rows[999] == sum(range(0, 1000, 3)) and rows[4] == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def windows_by_hand(rows, width):
    """(start, number in the window, tag of its first row) of rows (key, time, tie, tag) by their tie."""
    state, out = {}, {}
    for key, t, i, tag in sorted(rows, key=lambda r: (r[1], r[2])):
        start, n, first = state.get(key, (None, 0, None))
        if start is None or t - start >= width:
            start, n, first = t, 0, tag
        state[key] = (start, n + 1, first)
        out[i] = state[key]
    return out


@pytest.mark.parametrize("block_rows, partitions", [(1, 7), (2, 3), (5, 40), (64, 1), (64, 9), (1000, 4)])
def test_one_sorted_pass_against_a_loop(spark, block_rows, partitions):
    rng = random.Random(block_rows * 100 + partitions)
    rows = []
    kinds = [("hot", 600, 900), ("dense", 300, 20), ("same", 80, 1), ("sparse", 40, 100_000), *((f"k{i}", 2, 50) for i in range(40))]
    for key, n, span in kinds:
        rows += [(key, rng.randrange(span) - span // 2, len(rows) + j, bytes([rng.randrange(3)])) for j in range(n)]
    df = spark.createDataFrame(rows, "k string, t bigint, i int, g binary").repartition(3)
    out = windows_in_order(df, F.col("k"), F.col("t"), 30, ["i"], F.col("g"), block_rows, partitions).collect()
    assert {r["i"]: (r["_start"], r["_rank"], r["_first_tag"]) for r in out} == windows_by_hand(rows, 30) and len(out) == len(rows)


def test_sorted_pass_odd_rows(spark):
    df = spark.createDataFrame([("a", 5, None), ("a", 5, None), ("a", 5, "x")], "k string, t bigint, note string")
    out = windows_in_order(df, F.col("k"), F.col("t"), 10, block_rows=2, partitions=2).collect()
    assert sorted(r["_rank"] for r in out) == [1, 2, 3] and {r["_start"] for r in out} == {5}
    assert windows_in_order(df.limit(0), F.col("k"), F.col("t"), 10).count() == 0
    # a hot key lies over many tasks, and rows are shuffled once
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    placed = windows_in_order(hot, F.col("k"), F.col("t"), 7, block_rows=500, partitions=8)
    assert placed.where("_start <> t - t % 7 OR _rank <> t % 7 + 1").count() == 0


def test_far_times_do_not_overflow():
    us = np.array([-(1 << 61), 0, 1 << 61, -5, 0, 5], np.int64)
    assert successors(us, np.array([0, 3]), 6).tolist() == [1, 2, 3, 5, 6, 6]


def test_blocks_of_wide_rows_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    note = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda j: F.sha2(F.concat_ws("-", "id", j), 512)))
    rows = spark.range(600).select(F.lit("k").alias("k"), F.col("id").alias("t"), note.alias("note"))
    placed = windows_in_order(rows, F.col("k"), F.col("t"), 7, partitions=1)
    # as many rows as a block may have, but 64 KB each: a block ends by its bytes
    blocks = [pa.ipc.open_stream(r["rows"]).read_all() for r in spark.read.parquet(f"{tmp_path}/ordered").where("block >= 0").collect()]
    assert sum(b.num_rows for b in blocks) == 600 and max(b.nbytes for b in blocks) < 5 << 20
    # a reader takes a group of blocks as one
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("ordered/*.parquet")]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 12 << 20
    # the rows are not shuffled once more to learn what comes into their block
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert placed.where("_start <> t - t % 7 OR _rank <> t % 7 + 1 OR length(note) <> 64000").count() == 0 and placed.count() == 600
