"""Run registered queries against their oracle SQL: python -m tests.run_oracle [sf_dir] [name ...]"""
from __future__ import annotations

import sys
import time

from tests.oracle_compare import compare, duck


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from vetolex.session import build_session
    spark = build_session("local[8]", 8, "8g")
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    import os
    selected = names or sorted(qs)
    if os.environ.get("ORACLE_SQL_ONLY"):
        selected = [n for n in selected if n in sql]
    for name in selected:
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sql:
                probs, n = compare(df, con, sql[name])
            else:
                n, probs = df.count(), []
        except Exception as e:  # noqa: BLE001
            probs, n = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1
        tag = "OK " if not probs else "BAD"
        bad += bool(probs)
        kind = "sql " if name in sql else "rows"
        print(f"{tag} {kind} {name:32s} rows={n:<7} {time.time()-t:6.2f}s {'; '.join(probs)[:600]}", flush=True)
    print(f"{len(selected) - bad} ok, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
