"""Traffic-like long series made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridcast.functions.scale_out import div


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _total(value: Column) -> Column:
    """Sum of whole cents: the same value whatever the order of the rows."""
    return (F.sum(F.round(value * 100).cast("bigint")) / F.lit(100.0)).alias("v")


def event_traffic(spark: SparkSession, sf_dir: str, minutes: int = 45) -> DataFrame:
    """Cell = event type, slot = ``minutes`` since 2024-01-01, value = summed ``value``."""
    began = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    slot = div(F.timestamp_diff("MINUTE", began, F.col("ts").cast("timestamp_ntz")), minutes)
    return _table(spark, sf_dir, "events") \
        .groupBy(F.col("event_type").alias("cell_id"), slot.alias("t")).agg(_total(F.col("value")))


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell = nation of the customer, slot = day since 1995-01-01, value = order totals."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")) \
        .groupBy(F.col("c_nationkey").cast("string").alias("cell_id"), day.alias("t")) \
        .agg(_total(F.col("o_totalprice")))


def supplier_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell = supplier, slot = week since 1995-01-01, value = shipped quantity.

    The number of cells grows with the scale factor.
    """
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    return _table(spark, sf_dir, "lineitem") \
        .groupBy("l_suppkey", div(day, 7).alias("t")).agg(_total(F.col("l_quantity"))) \
        .select(F.col("l_suppkey").cast("string").alias("cell_id"), "t", "v")


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up place per nation: ``(lon, lat)`` on a regular raster."""
    k = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(
        "n_nationkey", (F.lit(118.70) + F.lit(0.0123457) * k).alias("lon"),
        (F.lit(32.01) + F.lit(0.0034569) * k).alias("lat"))
