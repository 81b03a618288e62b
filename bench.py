"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local threads. Every query runs twice over the
whole tables and the second run counts; results go to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def build(spark: SparkSession) -> dict[str, tuple[DataFrame | Callable[[], DataFrame], int]]:
    """Query name -> (result, rows of the input)."""
    from hushframe.operators import detect, metrics, sampling, windows
    from hushframe.operators.documents import doc_walk
    from hushframe.plans import jobs
    from hushframe.plans.policy import PathLabel, Policy
    from queries.derived import event_proposals, order_documents
    from hushframe.operators.labels import merge_proposed
    from hushframe.session import shared_folder

    table = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    orders, lineitem, documents = table("orders"), table("lineitem"), table("documents")
    events, conversations = table("events"), table("conversations")
    overlay = Policy(overlay={"o_orderpriority": "[redacted]", "l_returnflag": "[redacted]"})
    both = lambda obj, *labels: Policy(
        object_id=f"org1:spark:tpch:{obj}", overlay=overlay.overlay, labels=[PathLabel(n, p) for n, p in labels]
    )
    # the tables are single row groups: spread long texts before the pattern work
    spread = documents.repartition(int(CPUS))
    # building the documents is not what is measured
    stored = shared_folder(spark, "documents")
    order_documents(spark, FOLDER).repartition(int(CPUS)).write.parquet(stored)
    docs = spark.read.parquet(stored)
    doc_policy = Policy(
        object_id="org1:mongo:shop:orders",
        overlay={"segment": "[redacted]"},
        labels=[PathLabel("customer.name"), PathLabel("lines[].flag", "partial_mask"), PathLabel("total")],
    )
    n = {k: v.count() for k, v in dict(o=orders, l=lineitem, d=documents, e=events, c=conversations).items()}
    return {
        "control_scan_orders": (orders, n["o"]),
        "control_scan_lineitem": (lineitem, n["l"]),
        "mask_orders_overlay": (jobs.mask_table(orders, overlay), n["o"]),
        "mask_lineitem_overlay": (jobs.mask_table(lineitem, overlay), n["l"]),
        "mask_orders_overlay_labels": (
            jobs.mask_table(orders, both("orders", ("o_orderstatus", "partial_mask"), ("o_orderdate", ""))),
            n["o"],
        ),
        "mask_lineitem_overlay_labels": (
            jobs.mask_table(lineitem, both("lineitem", ("l_linestatus", "partial_mask"), ("l_extendedprice", ""))),
            n["l"],
        ),
        "detect_and_anonymize_documents": (
            spread.select("doc_id", detect.mask_text(F.col("text")).alias("text")),
            n["d"],
        ),
        "mask_nested_documents": (jobs.mask_documents(docs, ["doc"], doc_policy), n["o"]),
        "walk_nested_documents": (doc_walk(docs, "doc_id", "doc"), n["o"]),
        "masking_metrics": (
            metrics.masking_metrics(
                metrics.outcome_rows(spread.select("text", "source"), Policy(detection=detect.Detection()), F.lit("spark__r"))
            ),
            n["d"],
        ),
        "merge_proposals": (merge_proposed(event_proposals(spark, FOLDER)), n["e"]),
        "sample_fields": (sampling.sample_fields(orders, "o", 20, ["o_orderkey"]), n["o"]),
        # part of the work runs when the result is asked for: it is built inside the timer
        "rate_flags": (lambda: windows.rate_flags(events, "user_id", "ts", 3, 86_400, ["event_id"]), n["e"]),
        "transcript_cap": (windows.transcript_cap(conversations, "conv_id", "turn", "text", 4000), n["c"]),
    }


def run(made: DataFrame | Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    df = made if isinstance(made, DataFrame) else made()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    seconds, rates = {}, {}
    for name, (df, rows) in build(spark).items():
        run(df)
        best = run(df)
        seconds[name] = round(best, 3)
        rates[name] = round(rows / best)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
