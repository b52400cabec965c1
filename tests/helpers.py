"""Sessions and comparisons that tests share."""

from __future__ import annotations

import math
from collections.abc import Callable
from pathlib import Path

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(checkpoints: str) -> SparkSession:
    conf = {
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.checkpoint.dir": checkpoints, "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value: object) -> object:
    """A value that sorts and compares: floats to nine digits, nested values as tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sorted_rows(table: pa.Table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*columns)), key=repr)


def rows_of(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted_rows(df.toArrow())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    return sorted_rows(con.sql(sql).to_arrow_table())


def same_as_sql(spark: SparkSession, query: Callable[[SparkSession, str], DataFrame], sql: str, sf_dir: str) -> int:
    """Fails unless the query's rows are those of the SQL; the number of rows."""
    names, mine = rows_of(query(spark, sf_dir))
    with views(sf_dir) as con:
        other_names, theirs = sql_rows(con, sql)
    assert names == other_names
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, (len(wrong), str(wrong[:2])[:1000])
    return len(mine)
