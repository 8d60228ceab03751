"""Compare registered queries with their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(row[i] for i in order) for row in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both return the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    ours = as_rows(df.columns, df.collect())
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    theirs = as_rows(columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{str(a)[:300]} and {str(b)[:300]}"
    return None


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as registry

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(registry.queries())
    spark, con, sql = make_session(), duck(sf_dir), registry.oracle_sql()
    for name in names:
        started = time.time()
        if name not in sql:
            result = f"no SQL, {registry.queries()[name](spark, sf_dir).count()} rows"
        else:
            try:
                found = differences(spark, con, registry.queries()[name], sql[name], sf_dir)
                result = "same" if found is None else f"DIFFERS: {found}"
            except Exception as error:
                result = f"FAILED: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - started:6.2f}s  {result}", flush=True)


if __name__ == "__main__":
    main()
