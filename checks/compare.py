"""Run queries next to their SQL and compare all values.

``python -m checks.compare [sf_dir] [name prefix ...]``
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from . import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql: str):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], Counter(tuple(_plain(r[k]) for k in order) for r in result.fetchall())


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    names, mine = rows_of_spark(catalog.QUERIES[name](spark, sf_dir))
    if name not in catalog.ORACLE:
        return None if mine else "no rows"
    other_names, theirs = rows_of_sql(con, catalog.ORACLE[name])
    if names != other_names:
        return f"columns {names} against {other_names}"
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        return f"{sum(extra.values())} extra {list(extra)[:3]} {sum(missing.values())} missing {list(missing)[:3]} of {sum(theirs.values())}"
    return None if mine else "no rows"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = tuple(sys.argv[2:]) or ("",)
    from .session import local_session

    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name in catalog.QUERIES:
        if not name.startswith(wanted):
            continue
        begun = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as error:  # shown, and counted as a failure
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begun:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
