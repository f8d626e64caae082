"""Compare registered queries with their SQL twins: python -m tests.oracle_check [dir] [name ...]."""

from __future__ import annotations

import decimal
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    names = sorted(df.columns)
    problems = []
    if names != sorted(rel.columns):
        return [f"columns {names} != {sorted(rel.columns)}"]
    types = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if _TYPES.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    mine = Counter(tuple(_norm(r[n]) for n in names) for r in df.collect())
    at = {n: i for i, n in enumerate(rel.columns)}
    theirs = Counter(tuple(_norm(r[at[n]]) for n in names) for r in rel.fetchall())
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        problems.append(
            f"rows {sum(mine.values())} vs {sum(theirs.values())}; only in Spark {list(extra)[:2]}; "
            f"only in SQL {list(missing)[:2]}"
        )
    if not mine:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from tests.conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark, con = make_session(), connect(sf_dir)
    sqls, bad = e.oracle_sql(), 0
    for name, q in e.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problems = compare(spark, con, q, sqls[name], sf_dir) if name in sqls else ["no SQL"]
        except Exception as err:  # report and go on with the next query
            problems = [f"{type(err).__name__}: {str(err)[:600]}"]
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - start:.2f}s", *problems, sep="\n    " if problems else " ", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
