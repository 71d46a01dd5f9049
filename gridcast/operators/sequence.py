"""The recurrent day-ahead forecaster over windows.

Training keeps windows rolled up: a slab holds the ``group + 2 * steps`` feature rows that all
windows of one (batch, lane group) are cut from, so rows are not repeated per window. Slabs are
dealt once, each batch to partitions of its own, and held. A step is one short Spark job over
the partitions of its batch alone: every lane group gives its gradient, they are summed, and
Adam moves the 891 weights. The result is that of sequential training, whatever the number of
lane groups. State carried between batches is data; no gradient flows through. A lost partition
is dealt again from the settled slabs.

Steps follow one another, so what counts is their latency: a barrier stage with an ``allGather``
per step was slower (at least one second each, as the call waits in whole seconds).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from gridcast.config import Granularity
from gridcast.functions.recurrent import Shape, adam, forward, gradient, initial
from gridcast.functions.scale_out import div, settle, spread
from gridcast.operators.windows import FEATURES


def sequence_forecast(windows: DataFrame, weights: np.ndarray, shape: Shape = Shape(),
                      names: Sequence[str] = FEATURES) -> DataFrame:
    """``(window_id, step, yhat)`` from a zero state; a batch of windows runs as one."""
    packed = spread(windows.select("window_id", "step", *names), "window_id").groupBy("window_id").agg(
        F.sort_array(F.collect_list(F.struct("step", *names))).alias("p")) \
        .select("window_id", *[F.col(f"p.{c}").alias(c) for c in names])

    def predict(batches):
        p = shape.split(np.asarray(weights, float))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.stack(pdf[c].to_numpy()) for c in names], axis=-1)
            state = np.zeros((len(x), shape.cell))
            out = forward(p, x, state, state)[0][:, :, 0]
            yield pd.DataFrame({"window_id": np.repeat(pdf["window_id"].to_numpy(), x.shape[1]),
                                "step": np.tile(np.arange(x.shape[1]), len(x)),
                                "yhat": out.ravel()})

    return packed.mapInPandas(predict, "window_id BIGINT, step INT, yhat DOUBLE")


def sequence_cost(pred: DataFrame, actual: DataFrame) -> DataFrame:
    """sum((yhat - target)^2) / number of windows."""
    d = F.col("yhat") - F.col("target")
    return actual.join(pred, ["window_id", "step"]).agg(
        (F.sum(d * d) / F.count(F.when(F.col("step") == 0, 1))).alias("cost"))


@dataclass
class SequenceModel:
    weights: np.ndarray
    shape: Shape
    costs: list[tuple[int, float]]      # (epoch, mean batch cost)

    def forecast(self, windows: DataFrame) -> DataFrame:
        return sequence_forecast(windows, self.weights, self.shape)


def slabs(features: DataFrame, steps: int, lanes: int, group: int, windows: int,
          names: Sequence[str] = FEATURES) -> DataFrame:
    """``(batch, grp, n, rows)``: the feature rows that the ``n`` windows of each lane group of a
    batch are cut from, in order. The last batch may lack lanes."""
    if lanes % group:
        raise ValueError("lanes must be a multiple of the lane group")
    t, per_batch = F.col("t"), lanes // group
    low = F.greatest(F.lit(0), div(t - (2 * steps - 1), group)).cast("bigint")
    high = F.least(div("t", group), F.lit((windows - 1) // group)).cast("bigint")
    rows = features.select("t", F.array(*names).alias("f"), F.explode(F.sequence(low, F.greatest(low, high))).alias("slab")) \
        .filter((F.col("slab") <= high) & (t < (F.col("slab") + 1) * group + 2 * steps - 1))
    packed = rows.groupBy("slab").agg(F.sort_array(F.collect_list(F.struct("t", "f"))).alias("p"))
    n = F.least(F.lit(group), F.lit(windows) - F.col("slab") * group)
    return packed.select(div("slab", per_batch).alias("batch"), F.pmod("slab", F.lit(per_batch)).alias("grp"),
                         n.cast("int").alias("n"), F.col("p.f").alias("rows"))


def sequence_fit(features: DataFrame, cfg: Granularity, epochs: int | None = None,
                 group: int | None = None, batches: int | None = None, seed: int = 0,
                 names: Sequence[str] = FEATURES) -> SequenceModel:
    """Train on all windows of gapless ``(t, y, z1, z2)``, or on the first ``batches`` batches.

    ``group`` lanes share a slab (default: as many as give each core one, but 64 if there are).
    """
    steps, lanes, spark = cfg.day, cfg.lanes, features.sparkSession
    cores = spark.sparkContext.defaultParallelism
    group = group or next(g for g in range(max(min(lanes, 64), -(-lanes // cores)), lanes + 1) if lanes % g == 0)
    windows = (features.agg(F.max("t")).first()[0] or 0) + 1 - 2 * steps
    if windows < 1:
        raise ValueError("the series is shorter than one window")
    windows = windows if batches is None else min(windows, batches * lanes)
    shape = Shape(len(names), cfg.cell_size)
    w, m, v = initial(shape, *cfg.init, cfg.bias, seed), np.zeros(shape.size), np.zeros(shape.size)
    n_batches, shares, costs, taken = -(-windows // lanes), min(lanes // group, cores), [], 0
    packed = settle(slabs(features, steps, lanes, group, windows, names))
    held = packed.rdd.map(lambda r: (r["batch"] * shares + r["grp"] % shares, (r["grp"], r["n"], np.array(r["rows"])))) \
        .partitionBy(n_batches * shares, int).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for epoch in range(cfg.epochs if epochs is None else epochs):
            state = {g: np.zeros((2, group, shape.cell)) for g in range(lanes // group)}
            total = 0.0
            for k in range(n_batches):
                work = _gradients(w, state, shape, steps, lanes)
                # Only the partitions of this batch run.
                parts = sorted(spark.sparkContext.runJob(held, work, range(k * shares, (k + 1) * shares)), key=lambda p: p[0])
                taken += 1
                adam(w, np.sum([g for _, _, g, _ in parts], axis=0), m, v, taken, cfg.lr)
                total += sum(cost for _, cost, _, _ in parts)
                state |= {grp: after for grp, _, _, after in parts}
            costs.append((epoch + 1, total / n_batches))
    finally:
        held.unpersist()
    return SequenceModel(w, shape, costs)


def _gradients(w: np.ndarray, state: dict, shape: Shape, steps: int, lanes: int):
    """Per lane group of a batch: its number, cost, gradient and the lanes' new state."""
    def run(slabs_):
        p = shape.split(w)
        for _, (grp, n, rows) in slabs_:
            cut = np.lib.stride_tricks.sliding_window_view(rows, 2 * steps, axis=0)[:n].transpose(0, 2, 1)
            c, h = state[grp][:, :n]
            cost, g, c, h = gradient(p, cut[:, :steps], cut[:, steps:, :1], c, h)
            share = n / lanes                          # a group's mean over its lanes, as part of the batch's
            yield grp, cost * share, shape.join(g) * share, np.stack([c, h])

    return run
