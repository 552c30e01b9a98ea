"""Runs registered queries against their SQL and reports differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import all_sql
from checks.queries import all_queries

TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearwave")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(r) for r in df.select(*columns).collect()), key=_sortable)


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple], dict[str, str]]:
    relation = con.sql(sql)
    columns = sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types)))
    quoted = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted(relation.select(quoted).fetchall(), key=_sortable), types


def _sortable(row: tuple) -> tuple:
    return tuple((v is None, v if v is not None else 0) for v in row)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Rows compared, and the first difference if there is one."""
    columns, rows = spark_rows(df)
    sql_columns, expected, types = sql_rows(con, sql)
    if columns != sql_columns:
        return len(rows), f"columns {columns} and {sql_columns}"
    for name, kind in df.dtypes:
        if TYPE_NAMES.get(kind) != types[name]:
            return len(rows), f"type of {name}: {kind} and {types[name]}"
    if len(rows) != len(expected):
        return len(rows), f"{len(rows)} rows and {len(expected)}"
    for got, want in zip(rows, expected):
        if got != want:
            return len(rows), f"{got} and {want}"
    return len(rows), None


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(all_queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = database(sf_dir), all_sql()
    failed = 0
    for name in names:
        start = time.time()
        try:
            n, problem = difference(all_queries()[name](spark, sf_dir), con, sql[name])
        except Exception as error:  # report and go on with the next query
            n, problem = 0, f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {n} rows {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
