"""Command-line check: python tests/check_all.py [sf_dir] [query or @module ...]"""

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from mercato.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(**{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        module = build.__module__.rsplit(".", 1)[-1]
        if wanted and name not in wanted and f"@{module}" not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                n, problem = compare(spark, con, build, oracles[name], sf_dir)
            else:
                n, problem = len(build(spark, sf_dir).collect()), ""
        except Exception as error:  # the next query must still run
            n, problem = -1, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += bool(problem)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {kind:6s} {n:8d} {time.time() - start:7.2f}s {problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
