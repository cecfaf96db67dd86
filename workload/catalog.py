"""Query registry and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderlog.operators.parsing import parse_lines
from cinderlog.session import configure

from .demo_log import DUCK_LOG, demo_lines, written_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def log_sql(body: str, *ctes: str) -> str:
    """A query over the derived logs."""
    return "WITH " + ",\n".join([DUCK_LOG.strip(), *ctes]) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(demo_lines(spark, sf_dir, "raw_access"), "nginx")


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(demo_lines(spark, sf_dir, "raw_json"), "json")


def stored_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once and written, for jobs that read their records several times."""
    return written_once(spark, sf_dir, "access", lambda: access(spark, sf_dir))


def stored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, sf_dir, "jsonlog", lambda: json_records(spark, sf_dir))


def stamp(col: str | Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def duck_stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def flag(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def r6(col: str | Column) -> Column:
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), 6)


def joined(col: str | Column, sep: str = "|") -> Column:
    return F.array_join(col, sep)
