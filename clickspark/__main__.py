"""Run catalogue queries from the command line.

    python -m clickspark list
    python -m clickspark run country_share --sf /root/testdata/sf0.01 [--rows 20] [--explain]
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clickspark")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered queries")
    run = sub.add_parser("run", help="run one registered query")
    run.add_argument("name")
    run.add_argument("--sf", default="/root/testdata/sf0.01", help="folder with the input parquet tables")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    run.add_argument("--explain", action="store_true", help="print the formatted physical plan")
    args = parser.parse_args(argv)

    from clickspark.plans.catalog import ORACLES, QUERIES
    if args.cmd == "list":
        for name in sorted(QUERIES):
            print(f"{name:32s} {'sql-twin' if name in ORACLES else 'rows-only'}")
        return 0
    if args.name not in QUERIES:
        print(f"unknown query {args.name!r}; see `python -m clickspark list`", file=sys.stderr)
        return 2
    from clickspark.session import build_session
    spark = build_session()
    df = QUERIES[args.name](spark, args.sf)
    if args.explain:
        df.explain("formatted")
    df.show(args.rows, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
