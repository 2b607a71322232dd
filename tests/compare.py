"""Run a registered query and its DuckDB SQL and compare all rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def difference(spark_rows, duck) -> str:
    """Empty when both hold the same rows under the same column names."""
    names = sorted(spark_rows.columns)
    if names != sorted(duck.columns):
        return f"columns {names} against {sorted(duck.columns)}"
    mine = Counter(tuple(row[name] for name in names) for row in spark_rows.collect())
    order = [duck.columns.index(name) for name in names]
    theirs = Counter(tuple(row[at] for at in order) for row in duck.fetchall())
    if mine == theirs:
        return ""
    extra, missing = mine - theirs, theirs - mine
    return (
        f"{sum(mine.values())} rows against {sum(theirs.values())}; only here "
        f"{list(extra)[:2]}; only there {list(missing)[:2]}"
    )
