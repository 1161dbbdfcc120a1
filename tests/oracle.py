"""Runs registered queries next to their SQL in DuckDB and compares the rows."""

import math
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_integer_ratio"):
        return float(value) if not isinstance(value, int) else value
    return value


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, build, sql, sf):
    frame = build(spark, sf)
    mine = normal([tuple(r) for r in frame.collect()], frame.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = normal(cursor.fetchall(), names)
    if sorted(names) != sorted(frame.columns):
        return f"columns differ: {sorted(frame.columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs):
        if repr(a) != repr(b):
            return f"values differ ({sorted(names)}):\n   {str(a)[:500]}\n   {str(b)[:500]}"
    return None if mine else "both empty"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, build, sqls[name], sf)
            else:
                count = build(spark, sf).count()
                problem = None if count else "no rows"
        except Exception as error:
            problem = str(error)[:1500]
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"@@ {name} [{kind}] {time.time() - start:.1f}s {problem or 'ok'}", flush=True)
    print(f"@@ bad: {bad}")
