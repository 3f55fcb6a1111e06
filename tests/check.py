"""Command line check: python -m tests.check [name-part ...] compares registered queries at SF_DIR."""

from __future__ import annotations

import os
import sys
import time
import traceback

from larkspur.session import build_session
from tests.compare import differences, duck


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    parts = sys.argv[1:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = differences(spark, sf_dir, fn, oracles[name], con)
                note = ""
            else:
                note = f" rows-only {fn(spark, sf_dir).count()}"
                problem = None
        except Exception as exc:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(exc)).strip()[:900]
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s{note if problem is None else ''} {problem or ''}", flush=True)
    print(f"failed {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
