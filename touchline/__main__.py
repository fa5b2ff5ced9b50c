"""Command line: ``python -m touchline list | query NAME | marts OUT``.

    python -m touchline list
    python -m touchline query attribution_report --data /root/testdata/sf0.01 --rows 20
    python -m touchline marts /path/on/shared/storage --data /root/testdata/sf0.1
"""

from __future__ import annotations

import argparse


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="touchline")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--data", default="/root/testdata/sf0.01")
    q.add_argument("--rows", type=int, default=20)
    m = sub.add_parser("marts")
    m.add_argument("out")
    m.add_argument("--data", default="/root/testdata/sf0.01")
    m.add_argument("--lookbacks", default="90,180")
    for p in (q, m):
        p.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from touchline.plans.registry import QUERIES
    if args.cmd == "list":
        print("\n".join(sorted(QUERIES)))
        return

    from touchline.session import get_session
    spark = get_session(args.master)
    if args.cmd == "query":
        QUERIES[args.name](spark, args.data).show(args.rows, truncate=False)
    else:
        from touchline.plans import inputs
        from touchline.plans.marts import build_marts, write_marts
        lookbacks = [int(x) for x in args.lookbacks.split(",") if x]
        import os
        stage = os.path.join(args.out, "_typed_events")
        marts = build_marts(inputs.events(spark, args.data), lookbacks, stage_dir=stage)
        paths = write_marts(marts, args.out)
        for name, path in paths.items():
            print(f"{name}\t{path}")
    spark.stop()


if __name__ == "__main__":
    main()
