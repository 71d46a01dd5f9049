"""Run registered queries against their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as contract  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def views(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else v) for v in row)


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(df, con, sql: str) -> tuple[str, int]:
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    theirs_rel = con.execute(sql)
    names = [d[0] for d in theirs_rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(ours)
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(r[i] for i in at) for r in theirs_rel.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}", len(ours)
    exact = sum(a != b for a, b in zip(ours, theirs))
    off = [(a, b) for a, b in zip(ours, theirs) if not all(map(same, a, b))]
    if off:
        return f"{len(off)} rows differ, e.g. {off[0]}", len(ours)
    return ("ok" if not exact else f"ok, {exact} rows not bit-equal"), len(ours)


def main(sf_dir: str, only: list[str]) -> int:
    from gridcast.functions.scale_out import release
    from tests.conftest import make_session

    spark, con, bad = make_session(), views(sf_dir), 0
    oracle = contract.oracle_sql()
    for name, fn in contract.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracle:
                verdict, n = compare(fn(spark, sf_dir), con, oracle[name])
            else:
                n = len(fn(spark, sf_dir).collect())
                verdict = "rows only"
        except Exception as e:  # noqa: BLE001
            verdict, n = f"{type(e).__name__}: {str(e)[:300]}", -1
        release(spark)
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:28s} {time.time() - start:6.2f}s {n:7d} {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]))
