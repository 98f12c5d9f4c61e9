"""Run registered queries next to their checking SQL: ``python check.py [sf] [name part ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

from tableferry import build_session
from tableferry.queries import ORACLES, QUERIES
from tests.compare import database, rows_of


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check", f"local[{os.environ.get('CHECK_CPUS', 8)}]", **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    db = database(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ours = fn(spark, folder).toPandas()
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name} {len(ours)} rows {spent:.2f}s", flush=True)
                continue
            start = time.time()
            theirs = db.sql(ORACLES[name]).df()
            other = time.time() - start
            if sorted(ours.columns) != sorted(theirs.columns):
                bad += 1
                print(f"BAD   {name} columns {sorted(ours.columns)} / {sorted(theirs.columns)}", flush=True)
                continue
            a, b = rows_of(ours), rows_of(theirs)
            if a == b:
                print(f"ok    {name} {len(a)} rows {spent:.2f}s (sql {other:.2f}s)", flush=True)
            else:
                bad += 1
                differing = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print(f"BAD   {name} {len(a)} / {len(b)} rows {sorted(ours.columns)} {differing}"[:1500], flush=True)
            if not a:
                print(f"      {name} is EMPTY")
        except Exception as e:  # noqa: BLE001
            bad += 1
            text = str(e) if os.environ.get("CHECK_TRACE") is None else traceback.format_exc()
            print(f"FAIL  {name} {type(e).__name__} {text.splitlines()[0][:400]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
