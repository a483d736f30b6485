"""Compare registered queries with their SQL twins: ``python -m tests.compare KEY ...``."""

from __future__ import annotations

import argparse
import datetime as dt
import glob
import os
import time

import duckdb

from tickerloom.plans import all_queries
from tickerloom.plans.registry import CASES, oracle, run
from tickerloom.session import local_session


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, dt.datetime) and v.tzinfo is None and v.time() == dt.time(0):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return v if v is None or isinstance(v, (bool, str, dt.date)) else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def _learned(rows):
    """Every model beats the mean of its training rows."""
    train = [r for r in rows if r["split"] == "train"]
    assert train and all(r["r2"] > 0 for r in train), train
    assert {r["split"] for r in rows} >= {"train", "val", "test"}


def _importances(rows):
    assert len(rows) == 4 and all(0 <= r["importance"] <= 1 for r in rows)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def _components(rows):
    assert rows and all(r[f"pc{k}"] is not None for r in rows for k in (1, 2, 3))


def _forecasts(rows):
    names = [f"predicted_return_{h}" for h in (30, 60, 90, 252)]
    assert rows and all(r[n] is None or -1 < r[n] < 10 for r in rows for n in names)
    assert all(any(r[n] is not None for r in rows) for n in names)
    assert len({r["ticker"] for r in rows}) == len(rows)


#: What must hold of the queries that SQL cannot express.
ASSERTED = {
    "M06_forest_importance": _importances, "M07_principal_components": _components, "M09_forest": _learned,
    "M10_boosted_trees": _learned, "M11_ridge": _learned, "M18_direct_forecast": _forecasts,
}


def check(name, spark, con, sf_dir):
    t0 = time.time()
    df = run(name, spark, sf_dir)
    found = df.collect()
    got = [tuple(r) for r in found]
    t1 = time.time()
    sql = oracle(name)
    notes = []
    bad = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    if sql is None:
        try:
            ASSERTED[name](found)  # a query without SQL or assertion is an error
        except AssertionError as e:
            return False, len(got), t1 - t0, 0.0, [f"assertion: {e}"]
        return True, len(got), t1 - t0, 0.0, notes
    if set(bad) != set(CASES[name].doubles):
        notes.append(f"doubles should be: {' '.join(bad)}")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return False, len(got), t1 - t0, t2 - t1, notes + [
            f"columns differ: spark-only {set(df.columns) - set(names)} sql-only {set(names) - set(df.columns)}"
        ]
    for f in df.schema.fields:
        k = _KINDS.get(f.dataType.simpleString())
        if k and kinds[f.name] != k and not (k == "BIGINT" and kinds[f.name] in ("INTEGER", "HUGEINT")):
            notes.append(f"type {f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    ok = a == b
    if not ok:
        notes.append(f"rows {len(a)} vs {len(b)}")
        sa, sb = set(a), set(b)
        notes.append(f"columns {sorted(df.columns)}")
        notes += [f"  spark {r}" for r in [x for x in a if x not in sb][:3]]
        notes += [f"  sql   {r}" for r in [x for x in b if x not in sa][:3]]
    return ok, len(got), t1 - t0, t2 - t1, notes


def main():
    p = argparse.ArgumentParser()
    p.add_argument("keys", nargs="*")
    p.add_argument("--sf", default="0.01")
    args = p.parse_args()
    all_queries.load()
    sf_dir = f"/root/testdata/sf{args.sf}"
    names = [n for n in CASES if not args.keys or any(n.startswith(k) for k in args.keys)]
    spark, con = local_session(), connect(sf_dir)
    failed = []
    for n in names:
        try:
            ok, rows, ts, td, notes = check(n, spark, con, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, rows, ts, td, notes = False, -1, 0.0, 0.0, [f"{type(e).__name__}: {str(e)[:1500]}"]
        if not ok:
            failed.append(n)
        tag = "ok  " if ok else "FAIL"
        print(f"{tag} {n} rows={rows} spark={ts:.2f}s sql={td:.2f}s", flush=True)
        for x in notes:
            print("     ", x[:1200], flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} passed; failed: {failed}")


if __name__ == "__main__":
    main()
