"""Run catalogue queries beside their SQL and compare row by row."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when both sides agree, else what differs."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    kinds = {c[0]: str(c[1]) for c in cur.description}
    wrong = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(t) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    a, b = _bag(df.columns, got), _bag(columns, cur.fetchall())
    if a != b:
        return f"{sum(a.values())} vs {sum(b.values())} rows; {list((a - b).items())[:3]} vs {list((b - a).items())[:3]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    from gladeline.session import local_session
    from __spark_entry__ import queries

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark = local_session(8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            problem = compare(spark, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {n} {time.time() - t:.1f}s {problem}", flush=True)
    print("failed:", bad)
