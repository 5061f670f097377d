"""Compares registered queries with their comparison SQL: python tests/oracle.py [name ...]"""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder=FOLDER):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return plain(list(value))
    return value


def sort_key(row):
    return [(v is None, str(type(v)), f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else str(v)) for v in row]


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def differences(df, con, sql):
    """Text of the first difference, or None when columns and rows agree."""
    got_rows = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    columns = sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=sort_key)
    got = sorted(([plain(r[c]) for c in columns] for r in got_rows), key=sort_key)
    zeros = [any(isinstance(v, float) and v == 0 and math.copysign(1, v) < 0 for r in side for v in r) for side in (got, want)]
    if any(zeros):
        print(f"  negative zeros: spark {zeros[0]}, sql {zeros[1]}")
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    return f"{len(bad)} of {len(got)} rows differ in {columns}, first {bad[0]}" if bad else None


def main(names):
    from throngcast.plans import load_all
    from throngcast.session import build_session
    spark = build_session("local[8]", 8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(), []
    for name, q in load_all().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if q.sql is None:
                problem, n = None, q.run(spark, FOLDER).count()
                note = f"rows only ({n})"
            else:
                problem, note = differences(q.run(spark, FOLDER), con, q.sql), "ok"
        except Exception as e:  # report and go on
            problem, note = f"{type(e).__name__}: {str(e)[:700]}", ""
        if problem:
            failed.append(name)
        print(f"{name:28s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
