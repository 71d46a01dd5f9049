"""Compression of the row of all cells at a slot into a few units (denoising, tied weights).

Encoding, decoding, cost and gradient are column expressions. Training takes its mini-batch
steps inside barrier stages, over tiles of batches and cells, through all tied layers at once.
The result does not depend on how the rows are partitioned or cells are split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.barrier import dealt, slots, summed
from gridcast.functions.exprs import sigmoid
from gridcast.functions.scale_out import div, lookup_join, rows_for, settle
from gridcast.functions.tied import Stack, from_small, mask_bits
from gridcast.operators.scale import sigmoid_affine


def corrupt_mask(df: DataFrame, seed: int, prob: float = 1.0, bit: Column | None = None) -> DataFrame:
    """Multiply by a 0/1 mask with weight ``prob``; the mask is a hash, so a rerun repeats it."""
    if bit is None:
        bit = F.pmod(F.xxhash64(F.lit(seed), "cell_id", "t"), F.lit(2))
    v = F.col("v")
    return df.select("cell_id", "t", (v * bit * F.lit(prob) + v * F.lit(1.0 - prob)).alias("v"))


def _dense(z: Column, w, b) -> Column:
    """sigmoid(z.W + b) of an array column with small constant weights."""
    return F.array(*[sigmoid(sum((z[i] * F.lit(float(w[i][j])) for i in range(len(w))),
                                 F.lit(float(b[j])))) for j in range(len(b))])


def encode_arrays(df: DataFrame, weights: DataFrame, bias: Sequence[float], deeper=()) -> DataFrame:
    z = sigmoid_affine(df, weights, bias)
    for w, b in deeper:
        z = z.select("t", _dense(F.col("z"), w, b).alias("z"))
    return z


def latent_encode(df: DataFrame, weights: DataFrame, bias: Sequence[float], deeper=()) -> DataFrame:
    """``(t, unit, z)``; ``weights`` is ``(cell_id, w ARRAY<DOUBLE>)``, ``deeper`` further (W, b)."""
    return encode_arrays(df, weights, bias, deeper).select("t", F.posexplode("z").alias("unit", "z"))


def latent_decode(z: DataFrame, weights: DataFrame, grid: DataFrame, deeper=()) -> DataFrame:
    """``(t, cell_id, y)`` for the ``(cell_id, t)`` of ``grid``.

    ``weights`` is ``(cell_id, w, c)`` with the encoder's ``w`` and the cell's own bias
    ``c``; ``deeper`` holds the (encoder W, decoder bias) of further layers, innermost first.
    """
    zs = z.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("unit", "z"))).alias("p")) \
        .select("t", F.col("p.z").alias("z"))
    for w, c in deeper:
        zs = zs.select("t", _dense(F.col("z"), np.asarray(w).T, c).alias("z"))
    weights = settle(weights)
    bound = rows_for(weights.agg(F.max(F.size("w"))).first()[0] or 0)
    rows = lookup_join(grid.select("cell_id", "t"), weights, "cell_id", max_rows=bound, settled=True)
    z_dot_w = F.aggregate(F.zip_with("z", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return lookup_join(rows, zs, "t", salt_by="cell_id", max_rows=bound) \
        .select("t", "cell_id", sigmoid(z_dot_w + F.col("c")).alias("y"))


def reconstruction_cost(df: DataFrame, y: DataFrame) -> DataFrame:
    d = F.col("y") - F.col("v")
    return df.join(y, ["cell_id", "t"]).agg(F.sum(d * d).alias("cost"))


def latent_gradient(df: DataFrame, weights: DataFrame, bias: Sequence[float],
                    mask: Column | None = None) -> DataFrame:
    """``(param, cell_id, unit, g)``: gradient of the reconstruction cost over all rows.

    ``param`` is ``w`` (per cell and unit), ``c`` (per cell) ``b`` (per unit) or
    ``cost`` (the cost itself).

    Sums over the cells of a slot, and over the slots of a cell, combine before they are
    shuffled; the per-slot results come back by ``lookup_join``. The rows themselves are
    read three times and never moved while the slots fit a broadcast.
    """
    units = range(len(bias))
    v, w, c = F.col("v"), F.col("w"), F.col("c")
    bound = rows_for(len(bias))
    rows = lookup_join(df, weights, "cell_id", max_rows=bound).withColumn("xm", v * mask if mask is not None else v)
    hidden = rows.groupBy("t").agg(F.array(*[
        sigmoid(F.sum(F.col("xm") * w[j]) + F.lit(float(bias[j]))) for j in units]).alias("h"))
    rows = lookup_join(rows, hidden, "t", salt_by="cell_id", max_rows=bound)
    h = F.col("h")
    rows = rows.withColumn("y", sigmoid(sum((h[j] * w[j] for j in units), c)))
    y = F.col("y")
    rows = rows.withColumn("dy", F.lit(2.0) * (y - v) * y * (F.lit(1.0) - y))
    back = settle(rows.groupBy("t").agg(F.array(*[
        F.sum(F.col("dy") * w[j]) * F.first(h[j]) * (F.lit(1.0) - F.first(h[j]))
        for j in units]).alias("dh"), F.sum((y - v) * (y - v)).alias("cost")))
    rows = lookup_join(rows, back.select("t", "dh"), "t", salt_by="cell_id", max_rows=bound, settled=True)
    dh = F.col("dh")
    cells = rows.groupBy("cell_id").agg(
        F.array(*[F.sum(F.col("xm") * dh[j] + F.col("dy") * h[j]) for j in units]).alias("gw"),
        F.sum("dy").alias("gc"))
    slots = back.agg(F.array(*[F.sum(dh[j]) for j in units]).alias("gb"), F.sum("cost").alias("cost"))
    each = F.array(*[F.struct(F.lit("w").alias("param"), F.lit(j).alias("unit"),
                              F.col("gw")[j].alias("g")) for j in units],
                   F.struct(F.lit("c").alias("param"), F.lit(0).alias("unit"), F.col("gc").alias("g")))
    return cells.select("cell_id", F.explode(each).alias("e")) \
        .select("e.param", "cell_id", "e.unit", "e.g") \
        .unionByName(slots.select(F.lit("b").alias("param"), F.lit("").alias("cell_id"),
                                  F.posexplode("gb").alias("unit", "g"))) \
        .unionByName(slots.select(F.lit("cost").alias("param"), F.lit("").alias("cell_id"), F.lit(0).alias("unit"),
                                  F.col("cost").alias("g")))


# --- training --------------------------------------------------------------------------


@dataclass
class LatentModel:
    """Fitted weights: ``weights`` is ``(cell_id, w, c)``, the rest is small."""
    weights: DataFrame
    bias: list[float]
    deeper: list = field(default_factory=list)        # encoder (W, b) of further layers
    decode_deeper: list = field(default_factory=list)  # (W, decoder bias), innermost first
    costs: list[tuple[int, float]] = field(default_factory=list)

    def encode(self, df: DataFrame, mask_seed: int | None = None) -> DataFrame:
        """``(t, z1, z2, ...)``; with ``mask_seed`` the input is masked, as in training."""
        rows = df if mask_seed is None else corrupt_mask(df, mask_seed)
        z = encode_arrays(rows, self.weights.select("cell_id", "w"), self.bias, self.deeper)
        k = len(self.deeper[-1][1]) if self.deeper else len(self.bias)
        return z.select("t", *[F.col("z")[j].alias(f"z{j + 1}") for j in range(k)])


CELLS_A_TASK = 16_384               # a sum over tasks takes a second or two, a step on so many cells far less
TILES_A_JOB = 64 << 20              # bytes of tiles that all epochs of one job stream


def latent_fit(df: DataFrame, units: Sequence[int] = (2,), lr: float = 0.008, epochs: int = 40,
               batch: int = 128, batches: int | None = None, init: str = "zeros", seed: int = 0,
               prob: float = 1.0, mask: Column | None = None,
               start: tuple | None = None, cells_a_task: int = CELLS_A_TASK) -> LatentModel:
    """Train on gapless, scaled series that stand side by side.

    An epoch takes a step along the summed gradient of each batch of ``batch`` slots, in order,
    through all layers of ``units`` at once. ``batches`` keeps only so many batches, as an
    explicit cut. ``init="zeros"`` keeps all units of a layer equal for good; ``"seeded"`` breaks
    the tie, by a hash of the cell. ``mask`` is a 0/1 column in place of the hash of seed, epoch,
    cell and slot; ``start`` gives ``(cell_id, w, c)``, the units' bias and, for further layers, the
    ``deeper`` and ``decode_deeper`` of a :class:`LatentModel` to begin with.

    Many cells are split over tasks; a row of data is the tile of a batch and a task's cells. The
    steps of an epoch are taken in one barrier stage, in which tasks sum ``batch x units``
    numbers twice a step; a job runs as many epochs as keep its stream of tiles small, one if
    they are large.
    """
    spark, units = df.sparkSession, list(units)
    rows = settle(df if batches is None else df.filter(F.col("t") < batch * batches))
    names, n = rows.agg(F.count_distinct("cell_id"), F.count("v")).first()
    steps = rows.groupBy(div("t", batch).alias("b")).agg(F.count_distinct("t").alias("n"))
    n_batches, slots_, low = steps.agg(F.count("*"), F.sum("n"), F.min("b")).first()
    if n != names * (slots_ or 0):
        raise ValueError("every slot needs a value of every cell; see clean.prepare(start=...)")
    weights, small = _initial(rows, units, init, seed, start)
    model = LatentModel(settle(weights), [])
    if not n:
        return _with_small(model, small, units)
    tasks = max(1, min(slots(spark), names // cells_a_task))
    tiles = _tiles(rows, batch, tasks, mask)
    together = max(1, min(epochs, TILES_A_JOB * tasks // (8 * n * (1 if mask is None else 2))))
    if together > 1:
        tiles = tiles.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(together - 1))))
    tiles = tiles.sortWithinPartitions("task", "round", "batch").persist()
    try:
        for first in range(0, epochs, together):
            run = _descent(small, units, lr, prob, first, min(together, epochs - first), n_batches, tasks)
            own = dealt(model.weights.withColumn("_key", F.xxhash64(F.lit(seed), "cell_id")), _share(tasks), tasks) \
                .groupBy("task").agg(F.sort_array(F.collect_list(F.struct("cell_id", "w", "c", "_key"))).alias("p"))
            opening = (F.col("round") == 0) & (F.col("batch") == low)
            fed = tiles.join(own, "task").select("round", "batch", "t", "x", "bit", *[
                F.when(opening, F.col(f"p.{c}")).alias(c) for c in ("cell_id", "w", "c", "_key")])
            told = settle(fed.mapInPandas(run, "cell_id STRING, w ARRAY<DOUBLE>, c DOUBLE, costs ARRAY<DOUBLE>", barrier=True))
            model.weights = told.filter("costs IS NULL").select("cell_id", "w", "c")
            shared = told.filter("costs IS NOT NULL").first()
            small = np.array(shared["w"])
            model.costs += [(first + i + 1, c) for i, c in enumerate(shared["costs"])]
    finally:
        tiles.unpersist()
    return _with_small(model, small, units)


def _initial(rows: DataFrame, units: list[int], init: str, seed: int, start: tuple | None) -> tuple[DataFrame, np.ndarray]:
    """``(cell_id, w, c)``, and the shared parameters as one array."""
    if start:
        inner = [(w, b, start[3][-1 - i][1]) for i, (w, b) in enumerate(start[2])] if len(start) > 2 else []
        return start[0].select("cell_id", "w", "c"), np.concatenate(
            [np.asarray(start[1], float), *[np.ravel(np.asarray(p, float)) for layer in inner for p in layer]])
    first = [F.lit(0.0) if init == "zeros" else
             (F.pmod(F.xxhash64(F.lit(seed), "cell_id", F.lit(j)), F.lit(2001)) - 1000) / F.lit(4000.0)
             for j in range(units[0])]
    rng = np.random.default_rng(seed)
    draw = np.zeros if init == "zeros" else lambda shape: rng.uniform(-0.25, 0.25, shape)
    inner = [p.ravel() for n, k in zip(units, units[1:]) for p in (draw((n, k)), np.zeros(k), np.zeros(n))]
    weights = rows.select("cell_id").distinct().select("cell_id", F.array(*first).alias("w"), F.lit(0.0).alias("c"))
    return weights, np.concatenate([np.zeros(units[0]), *inner])


def _with_small(model: LatentModel, small: np.ndarray, units: list[int]) -> LatentModel:
    b, inner = from_small(small, units)
    model.bias = [float(x) for x in b]
    model.deeper = [(w, e) for w, e, _ in inner]
    model.decode_deeper = [(w, c) for w, _, c in reversed(inner)]
    return model


def _share(tasks: int) -> Column:
    return F.pmod(F.xxhash64("cell_id"), F.lit(tasks))


def _tiles(rows: DataFrame, batch: int, tasks: int, mask: Column | None) -> DataFrame:
    """``(task, round, batch, t, x, bit)``: a task's cells by a batch's slots, cell after cell."""
    bit = F.lit(None).cast("double") if mask is None else mask.cast("double")
    points = rows.select("cell_id", "t", "v", bit.alias("bit"), div("t", batch).alias("batch"))
    packed = dealt(points, _share(tasks), tasks).groupBy("task", "batch") \
        .agg(F.sort_array(F.collect_list(F.struct("cell_id", "t", "v", "bit"))).alias("p"))
    held = packed.select("task", F.lit(0).alias("round"), "batch", F.array_distinct("p.t").alias("t"), F.col("p.v").alias("x"),
                         F.lit(None).cast("array<double>").alias("bit") if mask is None else F.col("p.bit").alias("bit"))
    return settle(held).repartition(tasks, "task")


def _descent(small: np.ndarray, units: list[int], lr: float, prob: float, first: int, epochs: int, n_batches: int, tasks: int):
    """The epochs of one job, over tiles in order."""
    def run(frames):
        context = BarrierTaskContext.get()
        turns = (row for pdf in frames for row in pdf.itertuples(index=False))
        b, inner = from_small(small, units)
        net, cells, costs, spot = None, None, [], (-1, -1)
        for epoch in range(epochs):
            cost = 0.0
            for _ in range(n_batches):
                tile = next(turns, None)
                if tile is not None and (tile.round, tile.batch) < spot:
                    raise RuntimeError("tiles out of order")
                spot = (tile.round, tile.batch) if tile is not None else spot
                if tile is None:                               # no cell fell to this task
                    summed(context, None, tasks)
                    summed(context, None, tasks)
                    continue
                if net is None:
                    cells, keys = list(tile.cell_id), np.asarray(tile[-1], np.int64)
                    net = Stack(np.stack(tile.w), np.asarray(tile.c), b, inner)
                t = np.asarray(tile.t, np.int64)
                x = np.asarray(tile.x).reshape(len(cells), len(t)).T
                bit = mask_bits(keys, t, first + epoch) if tile.bit is None else np.asarray(tile.bit).reshape(x.T.shape).T
                cost += net.step(x, x * bit * prob + x * (1.0 - prob), lr, lambda part: summed(context, part, tasks))
            costs.append(cost)
        if net is not None:
            yield pd.DataFrame({"cell_id": cells, "w": list(net.w), "c": net.c, "costs": [None] * len(cells)})
        told = [int(x) for x in context.allGather(str(context.partitionId()) if net is not None else "") if x]
        if context.partitionId() == min(told):
            yield pd.DataFrame({"cell_id": [None], "w": [net.small()], "c": [0.0], "costs": [costs]})

    return run
