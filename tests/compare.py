"""Compare a Spark result with the DuckDB result of its oracle, order aside."""

from __future__ import annotations

import glob
import os


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells)


def _cell(v) -> str:
    return f"{type(v).__name__}:{v!r}"


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    want = canonical([c[0] for c in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lost = [r for r in want[1] if r not in set(got[1])][:2]
        return f"{len(got[1])} rows vs {len(want[1])}; extra {extra}; missing {lost}"
    return None
