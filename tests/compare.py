"""Compare the registered queries with their SQL; ``python tests/compare.py [name ...]`` prints a table."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")
    if isinstance(value, float) and math.isfinite(value):
        return round(value, 9)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(row[i]) for i in order]) for row in rows)


def of_spark(frame):
    return canonical(frame.columns, frame.collect())


def of_sql(connection, sql):
    result = connection.execute(sql)
    return canonical([column[0] for column in result.description], result.fetchall())


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallyloom.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", {
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, queries, oracle = connect(folder), entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or oracle:
        start = time.time()
        try:
            columns, left = of_spark(queries[name](spark, folder))
            taken = time.time() - start
            names, right = of_sql(connection, oracle[name])
            verdict = "same" if (columns, left) == (names, right) else "DIFFERS"
            print(f"{name:32} {verdict:8} {len(left):8} {len(right):8} {taken:6.2f}s", flush=True)
            if verdict != "same":
                print("  ", columns, names)
                for pair in [(a, b) for a, b in zip(left, right) if a != b][:3]:
                    print("  ", *pair, sep="\n     ")
        except Exception as error:
            print(f"{name:32} ERROR {str(error)[:600]}", flush=True)
