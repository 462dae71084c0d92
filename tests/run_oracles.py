"""Run every catalogue query against its DuckDB twin: python tests/run_oracles.py [sf_dir] [names...]"""

from __future__ import annotations

import json
import sys
import time

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

from clickspark.session import build_session  # noqa: E402
from clickspark.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tests.compare import compare, duck  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        if name not in ORACLES:
            n = QUERIES[name](spark, sf_dir).count()
            print(f"ROWS  {name:32s} rows={n} ({time.time() - t0:.1f}s)")
            continue
        try:
            ok, n, detail = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
        except Exception as exc:  # report and continue
            ok, n, detail = False, -1, {"error": str(exc)[:600]}
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {name:32s} rows={n} ({time.time() - t0:.1f}s)")
        if not ok:
            print("      " + json.dumps(detail, default=str)[:1500])
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
