"""Run a named query in Spark and its SQL in DuckDB, and compare schema and values.

As a script: ``python tests/compare.py SF_DIR [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_FAMILY = {
    "tinyint": "i8", "smallint": "i16", "int": "i32", "bigint": "i64",
    "double": "f64", "string": "str", "boolean": "bool",
    "TINYINT": "i8", "SMALLINT": "i16", "INTEGER": "i32", "BIGINT": "i64",
    "DOUBLE": "f64", "VARCHAR": "str", "BOOLEAN": "bool",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(rows, order):
    rows = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])


def compare(spark, con, run, sql, sf_dir) -> list[str]:
    """Differences, empty when the results agree."""
    df = run(spark, sf_dir)
    rel = con.sql(sql)
    problems = []
    names, sql_names = list(df.columns), list(rel.columns)
    if sorted(names) != sorted(sql_names):
        return [f"columns {sorted(names)} != {sorted(sql_names)}"]
    types = {n: _FAMILY.get(t, t) for n, t in df.dtypes}
    sql_types = {n: _FAMILY.get(str(t), str(t)) for n, t in zip(sql_names, rel.types)}
    if types != sql_types:
        diff = {n: (types[n], sql_types[n]) for n in names if types[n] != sql_types[n]}
        problems.append(f"types {diff}")
    ordered = sorted(names)
    left = _sorted(df.collect(), [names.index(n) for n in ordered])
    right = _sorted(rel.fetchall(), [sql_names.index(n) for n in ordered])
    if not left:
        problems.append("no rows")
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return problems


def main(argv: list[str]) -> int:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from churnloom.session import build_session

    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g"
    )
    sf_dir, wanted = argv[0], argv[1:]
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    failed = 0
    for name in wanted or queries:
        start = time.time()
        try:
            if name in oracle:
                problems = compare(spark, con, queries[name], oracle[name], sf_dir)
                kind = "sql"
            else:
                rows = queries[name](spark, sf_dir).collect()
                kind, problems = f"rows={len(rows)}", [] if rows else ["no rows"]
        except Exception as error:  # report and go on with the next query
            kind, problems = "error", [str(error)[:1500]]
        failed += bool(problems)
        print(f"{name:28s} {kind:8s} {time.time() - start:6.2f}s {'; '.join(problems) or 'ok'}", flush=True)
    spark.stop()
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
