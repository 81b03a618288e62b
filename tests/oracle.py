"""Run registered queries next to their SQL in DuckDB: `python tests/oracle.py [folder] [name part]`."""

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, folder, queries, sql):
    """None when both sides agree, else a short account."""
    df = queries[name](spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if name not in sql:
        return None
    cur = con.execute(sql[name])
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        only_got, only_want = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"rows {len(got[1])} vs {len(want[1])}; spark only {sorted(only_got)[:3]}; sql only {sorted(only_want)[:3]}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = {d[0]: str(d[1]) for d in cur.description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {n: (t, kinds[n]) for n, t in types.items() if t in same and kinds[n] != same[t]}
    return f"types {odd}" if odd else None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    part = sys.argv[2] if len(sys.argv) > 2 else ""
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if not any(p in name for p in part.split(",")):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, folder, queries, sql)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4}{name:32}{time.time() - start:6.1f}s {'' if name in sql else '(no sql) '}{problem or ''}", flush=True)
    print(f"{len(queries)} queries, {len(sql)} with SQL, {bad} problems")


if __name__ == "__main__":
    main()
