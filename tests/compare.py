"""Runs queries against their SQL in DuckDB: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings source_files manifest chunks vectors repos packages eval_items mix_targets".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame) -> list:
    def plain(x):
        if isinstance(x, float) and x != x:
            return "None"
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    mine = query(spark, sf_dir).toPandas()
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    if a != b:
        return f"{len(a)} and {len(b)} rows; only mine {[x for x in a if x not in set(b)][:2]}; only SQL {[x for x in b if x not in set(a)][:2]}"
    return ""


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from tests.conftest import session

    spark, con = session(), duck(sys.argv[1])
    queries, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sorted(sqls):
        began = time.time()
        try:
            wrong = compare(spark, con, queries[name], sqls[name], sys.argv[1])
        except Exception as x:  # noqa: BLE001
            wrong = f"{type(x).__name__}: {str(x)[:600]}"
        print(name, "ok" if not wrong else f"WRONG {wrong[:900]}", f"{time.time() - began:.1f}s", flush=True)
