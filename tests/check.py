"""Command line check: python tests/check.py <sf_dir> [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402
from dwellgrid.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            if name in oracles:
                msg = compare(spark, con, fn, oracles[name], sf)
            else:
                msg = None if fn(spark, sf).count() > 0 else "empty result"
        except Exception as e:  # report every query, not just the first failure
            msg = f"{type(e).__name__}: {str(e)[:900]}"
        spent = time.time() - t
        bad += msg is not None
        print(f"{name:28s} {spent:6.2f}s {'ok' if msg is None else 'FAIL ' + msg}", flush=True)
    print("failures:", bad, "queries:", len(queries), "oracles:", len(oracles))


if __name__ == "__main__":
    main()
