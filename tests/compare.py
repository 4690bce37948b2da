"""Runs queries beside their SQL: python -m tests.compare [SF_DIR] [NAME...]."""

from __future__ import annotations

import glob
import math
import sys
import time
from collections import Counter
from pathlib import Path


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = Path(path).stem
        source = path if Path(path).is_file() else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def cell(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def kinds(rows: list[tuple]) -> list[set[str]]:
    return [{type(x).__name__ for x in col if x is not None} for col in zip(*rows)]


def compare(spark, con, name: str, f, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(cell(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(cell(r[i]) for i in at) for r in rows]
    if kinds(got) != kinds(want):
        return f"types {list(zip(cols, kinds(got), kinds(want)))}"
    a, b = Counter(got), Counter(want)
    if a != b:
        return f"{len(got)} and {len(want)} rows; only Spark {list((a - b).items())[:3]}, only SQL {list((b - a).items())[:3]}"
    return "" if got or "empty" in name else "no rows"


def main(args: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry

    from hubloom.session import session

    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in [a for a in args if "/" not in a] or sql:
        began = time.time()
        try:
            said = compare(spark, con, name, queries[name], sql[name], sf_dir)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:500]}"
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok  '} {name} {time.time() - began:.1f}s {said[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
