"""Command line check of registered queries: python tests/check_oracle.py SF_DIR [name or prefix*] …"""

from __future__ import annotations

import fnmatch
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle import connect, differences


def main() -> int:
    sf_dir, patterns = sys.argv[1], sys.argv[2:] or ["*"]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", os.environ.get("COLUMN_CALL_SITES", "false")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if not any(fnmatch.fnmatch(name, p) for p in patterns):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = differences(build(spark, sf_dir), con, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                df = build(spark, sf_dir)
                state = f"rows {len(df.collect())} (no oracle)"
        except Exception as error:
            state = "ERROR " + str(error).split("\n")[0][:300]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += state.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.1f}s  {state[:700]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
