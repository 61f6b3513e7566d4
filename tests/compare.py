"""Compare registered queries with their SQL on the driver tables (also usable from the shell)."""

from __future__ import annotations

import math
import sys
import time

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(item) for item in value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _rows(records, order):
    return sorted((tuple(_cell(record[i]) for i in order) for record in records), key=repr)


def difference(spark, con, folder: str, build, sql: str) -> str | None:
    """None if both sides give the same columns and rows, else a description."""
    df = build(spark, folder)
    names = df.columns
    got = [tuple(row) for row in df.collect()]
    cursor = con.execute(sql)
    want_names = [item[0] for item in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    left = _rows(got, [names.index(name) for name in sorted(names)])
    right = _rows(want, [want_names.index(name) for name in sorted(names)])
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference in {sorted(names)}:\n  spark {a}\n  sql   {b}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from tonearm import build_session

    folder = sys.argv[1]
    chosen = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if chosen and name not in chosen and not any(c.endswith("*") and name.startswith(c[:-1]) for c in chosen):
            continue
        begin = time.time()
        try:
            problem = difference(spark, con, folder, build, oracle[name]) if name in oracle else f"rows only: {len(build(spark, folder).collect())}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        spent = time.time() - begin
        if problem and not problem.startswith("rows only"):
            bad += 1
        print(f"{'OK  ' if problem is None else '----'} {name} {spent:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
