"""Command line check of registered queries: python -m tests.check_oracle [sf] [name ...]"""

import sys
import time

import __spark_entry__ as entry_module
from spectraloom.session import local_session
from tests.oracle import connect, differences


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, function in entry_module.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            sql = entry_module.oracle_sql().get(name)
            found = differences(df, con, sql) if sql else ([] if df.count() else ["no rows"])
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'DIFFERS' if found else 'ok':8}{name:28}{time.time() - start:6.1f}s", *found, sep="\n    " if found else " ",
              flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
