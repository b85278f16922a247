"""Compare registered queries with their SQL: ``run_checks.py SF_DIR [name ...]``."""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import __spark_entry__ as contract  # noqa: E402
import compare  # noqa: E402
from cinderview.session import local_session  # noqa: E402


def main(sf_dir, names):
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.connect(sf_dir)
    queries, checks = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in checks:
                result = compare.differences(df, con, checks[name])
                state = "ok" if not result else "DIFF " + result
            else:
                state = f"rows {len(df.collect())}"
        except Exception as e:  # report and go on
            state = "ERROR " + str(e)[:900]
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name}: {state} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
