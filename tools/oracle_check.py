"""Run registered queries on Spark and their oracle SQL on DuckDB over the
same parquet tables and compare row count, column names/types and values.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from hearth.sources.tables import TABLES  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "smallint": "SMALLINT",
                 "float": "FLOAT", "date": "DATE"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    return repr(v)


def compare(name: str, spark, con, sf_dir: str, queries, oracles) -> tuple[bool, str]:
    t0 = time.time()
    sdf = queries[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    stypes = [f.dataType.simpleString() for f in sdf.schema.fields]
    t1 = time.time()
    rel = con.sql(oracles[name])
    ocols = rel.columns
    otypes = [str(t) for t in rel.types]
    orows = rel.fetchall()
    msgs = []
    if sorted(scols) != sorted(ocols):
        return False, f"columns differ: spark={scols} oracle={ocols}"
    idx = [ocols.index(c) for c in scols]
    orows = [tuple(r[i] for i in idx) for r in orows]
    otypes = [otypes[i] for i in idx]
    for c, st, ot in zip(scols, stypes, otypes):
        if SPARK_TO_DUCK.get(st, st) != ot:
            msgs.append(f"type {c}: spark={st} oracle={ot}")
    if len(srows) != len(orows):
        return False, f"rows spark={len(srows)} oracle={len(orows)}; " + "; ".join(msgs)
    a = sorted(tuple(_norm(v) for v in r) for r in srows)
    b = sorted(tuple(_norm(v) for v in r) for r in orows)
    diffs = [(x, y) for x, y in zip(a, b) if x != y]
    if diffs:
        msgs.append(f"{len(diffs)} rows differ, e.g. spark={diffs[0][0]} oracle={diffs[0][1]}")
    ok = not msgs
    return ok, f"{len(srows)} rows, spark {t1 - t0:.1f}s" + ("" if ok else " | " + "; ".join(msgs))


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    from hearth.plans.registry import ORACLES, QUERIES, load_all
    from hearth.session import build_session
    load_all()
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(args.sf)
    names = args.names or sorted(ORACLES)
    bad = 0
    for n in names:
        if n not in ORACLES:
            print(f"-- {n}: no oracle")
            continue
        try:
            ok, msg = compare(n, spark, con, args.sf, QUERIES, ORACLES)
        except Exception as e:  # report and go on
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n}: {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
