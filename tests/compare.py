"""Run queries and their SQL side by side: python tests/compare.py SF_DIR [NAME ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def difference(df, con, sql):
    """None, or what differs."""
    key = lambda r: tuple((x is None, str(round(x, 5) + 0.0) if isinstance(x, float) else str(x)) for x in r)
    mine = sorted(key(r[c] for c in sorted(df.columns)) for r in df.collect())
    rel = con.sql(sql)
    columns = rel.columns
    order = [columns.index(c) for c in sorted(columns)]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    theirs = sorted(key(r[i] for i in order) for r in rel.fetchall())
    if mine != theirs:
        a, b = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        return f"{len(mine)} and {len(theirs)} rows; only here {a}; only in SQL {b}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connection(sys.argv[1]), entry.oracle_sql()
    for name, f in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:] or name not in sql:
            continue
        began = time.time()
        try:
            said = difference(f(spark, sys.argv[1]), con, sql[name])
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(name, round(time.time() - began, 1), said or "equal", flush=True)
