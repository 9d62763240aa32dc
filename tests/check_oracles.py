"""Run registered queries against their DuckDB oracles: python -m tests.check_oracles [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
import pyarrow as pa

from plinth.plans import catalog
from plinth.plans.standins import BASE_TABLES
from plinth.session import local_session


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def canonical(table: pa.Table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_cell(v) for v in row) for row in zip(*columns)]
    return names, sorted(rows, key=repr)


def schema_of(table: pa.Table) -> dict[str, str]:
    alias = {"large_string": "string", "decimal128(38, 0)": "hugeint"}
    return {n: alias.get(str(table.schema.field(n).type), str(table.schema.field(n).type)) for n in table.column_names}


def compare(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    left_names, left = canonical(spark_table)
    right_names, right = canonical(duck_table)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference\n   spark {a}\n   duck  {b}"
    a, b = schema_of(spark_table), schema_of(duck_table)
    if a != b:
        return f"types {[(n, a[n], b[n]) for n in a if a[n] != b[n]]}"
    return None


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check-oracles", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, entry in catalog().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            result = entry.run(spark, sf_dir).toArrow()
            took = time.time() - start
            if entry.sql is None:
                print(f"rows-only {name} rows={result.num_rows} {took:.1f}s", flush=True)
                continue
            start = time.time()
            expected = con.execute(entry.sql).to_arrow_table()
            problem = compare(result, expected)
            note = f"rows={result.num_rows} {took:.1f}s duck={time.time() - start:.1f}s"
            print(("ok   " if problem is None else "FAIL ") + f"{name} {note} {problem or ''}", flush=True)
            bad += problem is not None
        except Exception as error:  # report and go on to the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            if "-v" in argv:
                traceback.print_exc()
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
