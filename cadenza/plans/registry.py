"""How queries are registered, and the views of the driver tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Six hours in microseconds: the matching tolerance on the events table's scale.
TOL = 6 * 3600 * 1_000_000
HOUR = 3600 * 1_000_000


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Spark 4.1 zips the sides of a union that are partitioned alike and fails if AQE has coalesced one of them more
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Score series: film = user, i = step within the film, score = value."""
    e = table(spark, sf_dir, "events")
    step = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("film"), step.alias("i"), F.col("value").alias("score"), *more)


def marks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Event times of one kind: film, t in microseconds."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("film"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


SIG = "sig AS (SELECT user_id AS film, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS score, event_type FROM events)"


def marks_sql(name: str, kind: str) -> str:
    return f"{name} AS (SELECT user_id AS film, epoch_us(ts) AS t FROM events WHERE event_type = '{kind}')"


def thin_sql(xs: str, gap: str, compare: str = ">=") -> str:
    """Greedy thinning of a sorted list expression."""
    return f"list_reduce(list_transform({xs}, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] {compare} {gap} THEN list_concat(a, x) ELSE a END)"
