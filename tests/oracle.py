"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(" ") if hasattr(v, "hour") else v.isoformat()
    return v


def spark_rows(df):
    order = sorted(df.columns)
    return order, Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())


def difference(df, con, sql) -> str | None:
    ours, mine = spark_rows(df)
    theirs, other = duck_rows(con, sql)
    if ours != theirs:
        return f"columns {ours} != {theirs}"
    if mine != other:
        only_mine, only_other = mine - other, other - mine
        return (
            f"{sum(mine.values())} rows against {sum(other.values())}; "
            f"only here {sum(only_mine.values())}: {list(only_mine)[:2]}; only there {sum(only_other.values())}: {list(only_other)[:2]}"
        )
    if not mine:
        return "no rows"
    return None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from qualityspark.session import build_session

    spark = build_session(
        "check", os.environ.get("ORACLE_MASTER", "local[8]"), **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(folder), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                diff = difference(df, con, sql[name])
                n = ""
            else:
                rows = df.count()
                diff, n = (None if rows else "no rows"), f"({rows} rows, no SQL)"
        except Exception as exc:
            diff, n = f"{type(exc).__name__}: {str(exc)[:600]}", ""
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - start:.1f}s {n}{diff or ''}", flush=True)
    print(f"{bad} of {len(names or queries)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
