"""Scores and the aligned series behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _paired(actual: DataFrame, pred: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every actual value, with a NULL where it was not forecast."""
    return actual.select(*on, "y").join(pred.select(*on, "yhat"), list(on), "left")


def mse(actual: DataFrame, pred: DataFrame, on: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    d = F.col("y") - F.col("yhat")
    return _paired(actual, pred, on).groupBy(*by).agg(F.avg(d * d).alias("mse"))


def mae(actual: DataFrame, pred: DataFrame, on: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return _paired(actual, pred, on).groupBy(*by).agg(
        F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))


def scores(actual: DataFrame, pred: DataFrame, on: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Both scores from one join, of how many values, and how many had no forecast."""
    d = F.col("y") - F.col("yhat")
    return _paired(actual, pred, on).groupBy(*by).agg(
        F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count("yhat").alias("n"),
        F.count_if(F.col("yhat").isNull()).alias("n_missing"))


def actual_vs_forecast(actual: DataFrame, pred: DataFrame, on: Sequence[str]) -> DataFrame:
    """Both series side by side, in the order of ``on``."""
    return _paired(actual, pred, on).orderBy(*on)
