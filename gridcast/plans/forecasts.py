"""The two end-to-end day-ahead forecasts and the order search, over a long traffic frame."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from gridcast.config import GRID_START, Granularity
from gridcast.functions.scale_out import settle
from gridcast.operators import arma, clean, latent, metrics, sequence, windows
from gridcast.sources.tables import attach_time, only_cells, select_target


def load_series(traffic: DataFrame, thresh: int, cells: DataFrame | None = None,
                side_by_side: bool = False) -> DataFrame:
    """Keep the listed cells, drop sparse ones, interpolate, scale, trim; settled.

    Each cell starts at its own first known slot, or with ``side_by_side`` all start where
    nearly all are known (``clean.usual_start``), as the compressor needs every cell of a slot.
    """
    rows = traffic if cells is None else only_cells(traffic, cells)
    return settle(clean.prepare(rows, thresh, start=clean.usual_start(rows) if side_by_side else None))


@dataclass
class ArmaForecast:
    fits: DataFrame        # one model per cell
    fitted: DataFrame      # (cell_id, p, q, t, yhat) on the training slots
    forecast: DataFrame    # the same on the test slots
    scores: DataFrame      # (cell_id, mse, mae, n, n_missing)


def configured_orders(series: DataFrame, cfg: Granularity) -> DataFrame:
    """The best order per cell over the whole configured grid, fitted on the training slots."""
    return arma.arma_order_search(windows.train_test_split(series, cfg.train)[0], cfg.max_lag, cfg.max_lag)


def arma_day_forecast(series: DataFrame, train: int, order: tuple[int, int] | None = None,
                      max_lag: int | None = None) -> ArmaForecast:
    """Fit on slots below ``train`` (given order, or the best below ``max_lag``), forecast the rest.

    Serves one target cell as well as all cells at once.
    """
    if order is None and max_lag is None:
        raise ValueError("name an order, or max_lag such as the configured one")
    known, rest = windows.train_test_split(series, train)
    fits = settle(arma.arma_fit(known, [order]) if order else
                  arma.arma_order_search(known, max_lag, max_lag))
    params = fits.select("cell_id", "p", "q", "mu", "phi", "theta")
    horizon = rest.agg(F.max("t")).first()[0] - train + 1
    ahead = settle(arma.arma_forecast(known, params, horizon))
    actual = rest.withColumnRenamed("v", "y")
    on = ["cell_id", "t"]
    scores = metrics.scores(actual, ahead, on, ["cell_id"])
    return ArmaForecast(fits, arma.arma_predict_in_sample(known, params), ahead, scores)


def slot_of(label: str, minutes: int, begin: str = GRID_START) -> int:
    """The slot that starts at a time label; ValueError if none does."""
    passed = datetime.fromisoformat(label) - datetime.fromisoformat(begin)
    if passed % timedelta(minutes=minutes):
        raise ValueError(f"no slot starts at {label}")
    return passed // timedelta(minutes=minutes)


def arma_forecast_between(known: DataFrame, params: DataFrame, minutes: int, start: str, end: str,
                          begin: str = GRID_START) -> DataFrame:
    """``(cell_id, p, q, t, ts, yhat)`` for the slots labelled ``start`` to ``end``, both included,
    that come after a cell's last known one."""
    first, last = slot_of(start, minutes, begin), slot_of(end, minutes, begin)
    ends = known.groupBy("cell_id").agg(F.max("t").alias("t")).agg(F.min("t")).first()[0]
    horizon = max(last - (last if ends is None else ends), 1)
    ahead = arma.arma_forecast(known, params, horizon).filter(F.col("t").between(first, last))
    return attach_time(ahead, begin, minutes).select("cell_id", "p", "q", "t", "ts", "yhat")


@dataclass
class CompressedForecast:
    latent_model: latent.LatentModel
    model: sequence.SequenceModel
    actual_vs_forecast: DataFrame    # (window_id, step, y, yhat), in window order
    scores: DataFrame                # (mse, mae, n, n_missing)


def compressed_features(series: DataFrame, target: str, model: latent.LatentModel,
                        mask_seed: int | None = None) -> DataFrame:
    """``(t, y, z1, z2)``: the target beside the compressed row of all cells."""
    return windows.column_stack(select_target(series, target), model.encode(series, mask_seed))


def compressed_day_forecast(series: DataFrame, target: str, cfg: Granularity,
                            latent_epochs: int | None = None, epochs: int | None = None,
                            init: str = "seeded", mask_at_encode: bool = False,
                            seed: int = 0, pad: str = "drop") -> CompressedForecast:
    """Compress the cells, train the forecaster, score it on the strided test windows (with
    ``pad="zeros"`` also on the empty ones at the end).

    The features are made once and reused by every epoch.
    """
    squeezed = latent.latent_fit(series, (2,), cfg.latent_lr,
                                 cfg.latent_epochs if latent_epochs is None else latent_epochs,
                                 cfg.latent_batch, None, init, seed)
    features = settle(compressed_features(series, target, squeezed,
                                          seed if mask_at_encode else None))
    model = sequence.sequence_fit(features, cfg, epochs, seed=seed)
    chosen = settle(windows.windows_at(features, cfg.day,
                                       windows.strided(F.col("window_id"), *cfg.evaluate), pad=pad))
    pred = settle(model.forecast(chosen))
    actual = chosen.select("window_id", "step", F.col("target").alias("y"))
    on = ["window_id", "step"]
    scores = metrics.scores(actual, pred, on)
    return CompressedForecast(squeezed, model, metrics.actual_vs_forecast(actual, pred, on), scores)
