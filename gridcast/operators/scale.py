"""Scaling and scalar maths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gridcast.functions.exprs import sigmoid, tanh_score, unit_range
from gridcast.functions.scale_out import div, lookup_join, rows_for


def minmax_scale(df: DataFrame) -> DataFrame:
    """Per cell (v-min)/(max-min), fitted on the whole series; a constant cell gives 0."""
    stats = df.groupBy("cell_id").agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    return lookup_join(df, stats, "cell_id") \
        .select("cell_id", "t", unit_range(F.col("v"), F.col("_low"), F.col("_high")).alias("v"))


def tanh_scale_columns(df: DataFrame) -> DataFrame:
    stats = df.groupBy("cell_id").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return lookup_join(df, stats, "cell_id") \
        .select("cell_id", "t", tanh_score(F.col("v"), F.col("_m"), F.col("_s")).alias("v"))


def tanh_scale_global(df: DataFrame) -> DataFrame:
    stats = df.agg(F.struct(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).alias("st")).scalar()
    return df.select("cell_id", "t", tanh_score(F.col("v"), stats["m"], stats["s"]).alias("v"))


def first_difference(df: DataFrame, size: int = 4096) -> DataFrame:
    """v - previous v by position, NULL in the first row.

    Differences are taken inside blocks of ``size`` slots; the first row of a block takes
    the last row of the nearest earlier block that has any, so no whole series is sorted.
    """
    block = F.coalesce(div("t", size), F.lit(0).cast("bigint"))
    rows = df.filter(F.col("cell_id").isNotNull()).select("cell_id", "t", "v", block.alias("_b")).repartition("cell_id", "_b")
    inner = W.partitionBy("cell_id", "_b").orderBy("t")
    blocks = W.partitionBy("cell_id").orderBy("_b")                       # one row per block
    last = rows.groupBy("cell_id", "_b").agg(F.max_by("v", "t").alias("_last")) \
        .select("cell_id", "_b", F.lag("_last").over(blocks).alias("_last"))
    inside = rows.withColumn("_at", F.row_number().over(inner)).withColumn("_lag", F.lag("v").over(inner))
    before = F.when(F.col("_at") == 1, F.col("_last")).otherwise(F.col("_lag"))
    return inside.join(last.hint("merge"), ["cell_id", "_b"]).select("cell_id", "t", (F.col("v") - before).alias("v"))


def affine_sums(df: DataFrame, weights: DataFrame, units: int) -> DataFrame:
    """``(t, s_0..s_{units-1})`` with ``s_j = sum over cells of v * w[j]``.

    ``weights`` is ``(cell_id, w ARRAY<DOUBLE>)``; one sum per unit, so rows are not
    repeated per unit and combine before the shuffle.
    """
    joined = lookup_join(df, weights.select("cell_id", "w"), "cell_id", max_rows=rows_for(units))
    return joined.groupBy("t").agg(
        *[F.sum(F.col("v") * F.col("w")[j]).alias(f"s_{j}") for j in range(units)])


def sigmoid_affine(df: DataFrame, weights: DataFrame, bias: Sequence[float]) -> DataFrame:
    """``(t, z ARRAY<DOUBLE>)``: sigmoid(x.W + b) of the row of all cells at ``t``."""
    sums = affine_sums(df, weights, len(bias))
    return sums.select("t", F.array(*[sigmoid(F.col(f"s_{j}") + F.lit(float(b)))
                                      for j, b in enumerate(bias)]).alias("z"))
