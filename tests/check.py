"""Compare registered queries with their reference SQL: python -m tests.check [sf dir] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return float(v) if type(v).__name__ == "Decimal" else v


def oracle_connection(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(df, con, sql: str):
    """(spark rows, oracle rows, differences) with columns matched by name."""
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return sum(got.values()), -1, [f"columns {cols} vs {sorted(names)}"]
    idx = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    diff = [("spark only", r, n) for r, n in (got - want).items()] + [("oracle only", r, n) for r, n in (want - got).items()]
    return sum(got.values()), sum(want.values()), diff


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from agentguard.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = oracle_connection(sf), oracle_sql(), []
    for name, run in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            df = run(spark, sf)
            if name in sqls:
                n, m, diff = compare(df, con, sqls[name])
                ok = not diff
            else:
                n, m, diff, ok = df.count(), "-", [], True
        except Exception as e:  # noqa: BLE001
            n, m, diff, ok = "-", "-", [str(e)[:1500]], False
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {n} / {m}  {time.time() - t:.1f}s", flush=True)
        if not ok:
            bad.append(name)
            for d in diff[:4]:
                print("      ", str(d)[:700], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
