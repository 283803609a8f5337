"""Registering queries, and reading the tables they are bound to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name, with the SQL that gives the same rows if there is one."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def second_of_day(ts: str = "ts") -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


#: The same in DuckDB.
DAY = "strftime(ts, '%Y-%m-%d')"
SECOND = "cast(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) AS BIGINT)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their day, second of day x, and value in whole hundredths v."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", day().alias("day"), second_of_day().alias("x"), F.round(F.col("value") * 100).cast("long").alias("v"))


EVENTS = f"events_x AS (SELECT event_id, user_id, event_type, value, ts, {DAY} AS day, {SECOND} AS x, cast(round(value * 100) AS BIGINT) AS v FROM events)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of their order: x, y from part and supplier, w, h from quantity and line number; row: place in the file."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 5).cast("double").alias("h"), F.col("_metadata.row_index").alias("row")
    )


BOXES = "boxes AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, cast(l_partkey % 100 AS DOUBLE) AS x, cast(l_suppkey % 50 AS DOUBLE) AS y, l_quantity AS w, cast(l_linenumber * 5 AS DOUBLE) AS h FROM lineitem)"
