"""Positional joins, splits, supervised windows and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.scale_out import div
from gridcast.sources.tables import last_slot

FEATURES = ("y", "z1", "z2")


def column_stack(target: DataFrame, latent: DataFrame) -> DataFrame:
    """``(t, y, latent columns)``."""
    return target.select("t", F.col("v").alias("y")).join(latent, "t")


def train_test_split(df: DataFrame, n: int | Column) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("t") < n), df.filter(F.col("t") >= n)


def batch_slices(df: DataFrame, size: int, batches: int) -> DataFrame:
    """Contiguous batches of rows; rows past the last batch are left out."""
    return df.filter(F.col("t") < size * batches).withColumn("batch_id", div("t", size))


def supervised_windows(features: DataFrame, steps: int, pad: str = "drop",
                       names: Sequence[str] = FEATURES) -> DataFrame:
    """``(window_id, step, features, target)``: rows [i, i+T) and target rows [i+T, i+2T).

    The target is joined once per slot, before the windows are unrolled, so nothing
    ``steps`` times as large is shuffled. ``pad="zeros"`` adds the all-zero windows at
    the end.
    """
    n = last_slot(features) + 1
    ahead = features.select((F.col("t") - steps).alias("t"), F.col("y").alias("target"))
    rows = features.select("t", *names).join(ahead, "t")
    windows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))) \
        .withColumn("window_id", F.col("t") - F.col("step")) \
        .filter((F.col("window_id") >= 0) & (F.col("window_id") < n - 2 * steps))
    out = windows.select("window_id", "step", *names, "target")
    if pad == "zeros":
        zero = F.lit(0.0)
        padded = features.filter((F.col("t") >= n - 2 * steps) & (F.col("t") < n - steps)) \
            .select(F.col("t").alias("window_id"),
                    F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"),
                    *[zero.alias(c) for c in names], zero.alias("target"))
        out = out.unionByName(padded)
    return out


def windows_at(features: DataFrame, steps: int, selected: Column,
               names: Sequence[str] = FEATURES, pad: str = "drop") -> DataFrame:
    """Only the windows whose ``window_id`` meets ``selected``, without unrolling the rest.

    ``pad="zeros"`` adds those of the selected windows that start too late to have targets, up to
    ``steps`` of them, as all zeros.
    """
    n = last_slot(features) + 1
    starts = features.select(F.col("t").alias("window_id")) \
        .filter(F.col("window_id") < n - 2 * steps).filter(selected)
    slots = starts.select("window_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")) \
        .withColumn("t", F.col("window_id") + F.col("step"))
    ahead = features.select((F.col("t") - steps).alias("t"), F.col("y").alias("target"))
    out = slots.join(features.select("t", *names).join(ahead, "t"), "t") \
        .select("window_id", "step", *names, "target")
    if pad == "zeros":
        late = features.filter((F.col("t") >= n - 2 * steps) & (F.col("t") < n - steps)) \
            .select(F.col("t").alias("window_id")).filter(selected)
        blank = late.select("window_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"),
                            *[F.lit(0.0).alias(c) for c in (*names, "target")])
        out = out.unionByName(blank)
    return out


def window_batches(windows: DataFrame, size: int, batches: int) -> DataFrame:
    """Add ``batch_id`` and ``lane``; windows past the last batch are left out."""
    w = F.col("window_id")
    return windows.filter(w < size * batches) \
        .withColumn("batch_id", div("window_id", size)) \
        .withColumn("lane", F.pmod(w, F.lit(size)))


def strided(window_id: Column, a: int, b: int, s: int, s2: int) -> Column:
    """Window ids a:b:s, of these every s2-th."""
    k = window_id - a
    return (k >= 0) & (window_id < b) & (F.pmod(k, F.lit(s)) == 0) & (F.pmod(k, F.lit(s * s2)) == 0)


def eval_windows(windows: DataFrame, a: int, b: int, s: int, s2: int) -> DataFrame:
    return windows.filter(strided(F.col("window_id"), a, b, s, s2))


def lane_chains(batches: DataFrame, size: int) -> DataFrame:
    """Which window's final state seeds which: lane j of batch k-1 seeds lane j of batch k.

    Windows are numbered without gaps, so the predecessor is known by arithmetic.
    """
    return batches.filter(F.col("step") == 0).select(
        "batch_id", "lane", "window_id",
        F.when(F.col("batch_id") > 0, F.col("window_id") - size).alias("prev_window_id"))
