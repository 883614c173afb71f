"""Run catalogue queries beside their SQL and compare: ``python tests/check.py FOLDER [KEY...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path
from typing import Any

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _sorted(columns: list[str], rows: list[Any]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df: Any) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _sorted(columns, cursor.fetchall())


def compare(left: tuple[list[str], list[tuple]], right: tuple[list[str], list[tuple]]) -> str | None:
    if left[0] != right[0]:
        return f"columns differ: {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"row counts differ: {len(left[1])} / {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"rows differ: {str(a)[:400]} / {str(b)[:400]}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from mcqflow.session import local_session

    folder, keys = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    sql, failed = oracle_sql(), 0
    for key, fn in queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, folder))
            took = time.time() - start
            wrong = compare(got, duck_rows(folder, sql[key])) if key in sql else "no SQL"
            note = f"{len(got[1])} rows" if wrong is None else wrong
        except Exception as error:  # noqa: BLE001
            took, wrong, note = time.time() - start, "error", f"{type(error).__name__}: {str(error)[:600]}"
        failed += wrong is not None
        print(f"{'ok  ' if wrong is None else 'FAIL'} {key} {took:.2f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
