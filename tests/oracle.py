"""Compare Spark queries with their SQL twins in DuckDB.

Run as a script to check chosen queries (or all) on one folder:
    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"] + [
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    table = spark_df.toArrow()
    left_names = table.column_names
    left = _rows(left_names, zip(*[c.to_pylist() for c in table.columns]) if table.num_columns else [])
    result = con.execute(sql).to_arrow_table()
    right_names = result.column_names
    right = _rows(right_names, zip(*[c.to_pylist() for c in result.columns]))
    if sorted(left_names) != sorted(right_names):
        return f"columns {sorted(left_names)} != {sorted(right_names)}"
    kinds = {n: (str(table.schema.field(n).type), str(result.schema.field(n).type)) for n in left_names}
    odd = {n: k for n, k in kinds.items() if k[0].replace("large_", "") != k[1].replace("large_", "")}
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    names = sorted(left_names)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        where = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        return f"{len(bad)} of {len(left)} rows differ, first: key={a[:3]} {where[:4]} types={odd}"
    return f"TYPES {odd}" if odd else None


def main() -> int:
    from barloom.registry import catalogue
    from barloom.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, failed = local_session(8), connect(sf_dir), []
    for name, query in catalogue().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query.run(spark, sf_dir)
            if query.sql is None:
                n = df.count()
                print(f"rows  {name}: {n} ({time.time() - start:.1f}s)", flush=True)
                continue
            problem = compare(df, con, query.sql)
        except Exception as error:  # noqa: BLE001 - a report over all queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem and not problem.startswith("TYPES"):
            failed.append(name)
        print(f"{'ok   ' if not problem else 'DIFF '} {name} ({time.time() - start:.1f}s) {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
