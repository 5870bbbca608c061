"""Run registered queries against their SQL: python tests/check.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from assayer.session import local_session  # noqa: E402
from harness import difference, duck, duck_rows, spark_rows  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = local_session(8)
    con = duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    chosen = [q for q in queries if not names or any(q.startswith(n) for n in names)]
    failed = 0
    for name in chosen:
        started = time.time()
        try:
            got = spark_rows(queries[name](spark, folder))
            took = time.time() - started
            if name not in oracle:
                status = f"rows-only ({len(got[1])})"
            else:
                started = time.time()
                diff = difference(got, duck_rows(con, oracle[name]))
                status = f"ok ({len(got[1])} rows, sql {time.time() - started:.1f}s)" if diff is None else f"FAIL {diff}"
                failed += diff is not None
        except Exception as exc:  # report and go on with the next query
            took, failed = time.time() - started, failed + 1
            text = str(exc)
            status = f"ERROR {type(exc).__name__}: {text[:900]}"
        print(f"{name:28s} {took:6.2f}s {status}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
