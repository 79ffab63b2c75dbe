"""Run registered queries against their oracles: python tests/check_all.py [sf] [names...]."""

import os
import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, differences  # noqa: E402

from depthline.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    if os.environ.get("PLAIN"):  # a session without any of our settings
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = local_session("check", "8")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                account = differences(df, con, oracles[name]) or "ok"
            else:
                account = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            account = "ERROR " + str(e)[:900]
        failed += account != "ok" and not account.startswith("rows only")
        print(f"{name:28s} {time.time() - began:6.1f}s {account}", flush=True)
    print("failed:", failed)


main()
