"""Series tables derived from the TPC-H-style test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per embedding; half of the values are negative."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def _quarter(date: str) -> Column:
    return F.year(date) * 4 + F.quarter(date)


def _cumulated_by_quarter(spark: SparkSession, sf_dir: str, measure: Column) -> DataFrame:
    """Per customer the running sum of a measure at each quarter seen in the table.

    All sums are taken in one hash aggregation, so a customer with a large share of the
    orders is reduced to one row per task before the shuffle.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    quarters = sorted(r[0] for r in orders.select(_quarter("o_orderdate")).distinct().collect())
    running = [
        F.sum(F.when(F.col("q") <= q, F.col("m")).otherwise(F.lit(0))).alias(f"s{i}")
        for i, q in enumerate(quarters)
    ]
    return (
        orders.select(F.col("o_custkey").alias("id"), _quarter("o_orderdate").alias("q"), measure.alias("m"))
        .groupBy("id")
        .agg(*running)
        .select("id", F.array(*[f"s{i}" for i in range(len(quarters))]).cast("array<double>").alias("v"))
    )


def cumulative_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the running sum of order cents by quarter."""
    return _cumulated_by_quarter(spark, sf_dir, _cents("o_totalprice"))


def cumulative_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the running number of orders by quarter."""
    return _cumulated_by_quarter(spark, sf_dir, F.lit(1).cast("bigint"))


def spend_since_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running spend from the first quarter with an order: series of unequal length."""
    return cumulative_spend(spark, sf_dir).select("id", F.filter("v", lambda x: x > 0).alias("v"))


def daily_values(spark: SparkSession, sf_dir: str, above: float | None = None) -> DataFrame:
    """Per user and event type the cents per day of the table's date range; 0 = missing.

    ``above`` counts only values larger than it, which leaves some series without any.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.to_date("ts")
    first, last = events.agg(F.min(day), F.max(day)).first()
    n_days = (last - first).days + 1
    measure = _cents("value")
    if above is not None:
        measure = F.when(F.col("value") > above, measure).otherwise(F.lit(0))
    kind = F.coalesce(
        F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")), F.lit(0)
    )
    per_day = [
        F.sum(F.when(F.col("d") == d, F.col("m")).otherwise(F.lit(0))).alias(f"s{d}")
        for d in range(n_days)
    ]
    return (
        events.select(
            (F.col("user_id") * 8 + kind).alias("id"),
            F.datediff(day, F.lit(first)).alias("d"),
            measure.alias("m"),
        )
        .groupBy("id")
        .agg(*per_day)
        .select("id", F.array(*[f"s{d}" for d in range(n_days)]).cast("array<double>").alias("v"))
    )
