"""Correlation across cells and lags, and the unit root test.

Everything over lags rests on one pass: ``lagged_sums`` turns packed blocks into pair
sums per lag, which combine before and after the shuffle. A series of any length thus
shrinks to a few numbers per lag before anything is solved.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from gridcast.functions import solvers, spectral
from gridcast.functions.exprs import pearson
from gridcast.functions.scale_out import (BLOCK, div, fits_broadcast, lookup_join, map_rows, pack_blocks, rows_for,
                                          settle, spread, spread_out)
from gridcast.functions.spectral import POINTS, Split
from gridcast.operators import sketch
from gridcast.operators.tiles import HELD, SUMS, PairSums, close_rows, group_cells, pairs_of_tiles

SUM_TYPES = "n BIGINT, sx DOUBLE, sy DOUBLE, sxx DOUBLE, syy DOUBLE, sxy DOUBLE"


def _total(sums=SUMS):
    return [F.sum(c).alias(c) for c in sums]


def _pearson():
    return pearson(*[F.col(c) for c in SUMS])


def spatial_corr(df: DataFrame, group: int = 128, size: int = BLOCK, min_abs_r: float | None = None,
                 held: int = HELD) -> DataFrame:
    """``(cell_a, cell_b, r, n)``: Pearson over the slots both cells know; NULL if constant.

    All pairs are the result unless ``min_abs_r`` keeps the correlated ones only. Then pairs of complete
    cells that cannot reach it are never multiplied out (see ``sketch``); the rows are those of the
    full product, filtered.

    A blocked X'X: packed rows (one cell, ``size`` slots) meet by pair of cell groups, a tile. A group
    has as many cells as a task can hold, so each cell is copied few times; a task multiplies its two
    groups in pieces of ``group`` cells and gives the pairs finished, in both orders, so nothing of
    the size of the result is shuffled. What is copied are rows closed up in few bytes, not yet less
    their mean, as measured values are shorter. Series too long to be held are walked block by block. Only
    where there are fewer tiles than cores are the blocks of a tile shared out and their sums
    shuffled. No task holds more than twice ``held`` bytes of values and, when walking, about as much
    again of sums.
    """
    known = F.when(F.col("v").isNotNull(), F.col("t"))
    stats = settle(df.groupBy("cell_id").agg(F.avg("v").alias("_m"), F.count(known).alias("n"),
                                             F.min(known).alias("first"), F.max(known).alias("last")))
    means = stats.select("cell_id", F.col("_m").alias("m"))
    cells, first, last = stats.filter("n > 0").agg(F.count("*"), F.min("first"), F.max("last")).first()
    slots, blocks = (last - first + 1, last // size - first // size + 1) if cells else (1, 1)
    cores = df.sparkSession.sparkContext.defaultParallelism
    many, may = group_cells(cells, slots, cores, group, held), None
    if min_abs_r is not None and min_abs_r > 0:
        packed = settle(pack_blocks(lookup_join(df, means, "cell_id", settled=True)
                                    .select("cell_id", "t", (F.col("v") - F.col("m")).alias("v")), size))
        taken, sketches = sketch.seats_and_sketches(packed, stats, min_abs_r, many, size)
        tiles = max(1, taken.select("_ga", "_gb").distinct().count())
        if sketches is not None:               # a task skips the pieces that the bound rules out
            may = sketch.within(min_abs_r)
        closed = _closed(packed)
        if sketches is not None:
            closed = closed.join(F.broadcast(sketches) if fits_broadcast(sketches, rows_for(sketch.KEPT)) else sketches,
                                 "cell_id", "left")
        pairs = lookup_join(closed, taken, "cell_id", salt_by="blk", settled=True)
    else:
        groups = max(1, math.ceil(cells / many))
        tiles = groups * (groups + 1) // 2
        own = F.pmod(F.xxhash64("cell_id"), F.lit(groups))
        closed = settle(_closed(pack_blocks(df, size)))
        pairs = lookup_join(closed, means, "cell_id", salt_by="blk", settled=True).withColumn("_g", own) \
            .withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) \
            .withColumn("_ga", F.least("_g", "_h")).withColumn("_gb", F.greatest("_g", "_h"))
    shares = max(1, min(blocks, math.ceil(4 * cores / tiles)))
    whole = shares == 1 and 8 * many * slots <= max(held, 8 * group * size)
    shared = shares > 1
    pairs = pairs.withColumn("_s", F.pmod("blk", F.lit(shares)))
    key = ["_ga", "_gb", "_s"]
    half = spread(pairs, *key).sortWithinPartitions(*key, "blk").mapInArrow(
        lambda batches: pairs_of_tiles(batches, group, size, whole, shared, min_abs_r, may),
        f"cell_a STRING, cell_b STRING, {SUM_TYPES if shared else 'r DOUBLE, n BIGINT'}")
    if not shared:
        return half
    half = half.groupBy("cell_a", "cell_b").agg(*_total()).select("cell_a", "cell_b", _pearson().alias("r"), "n")
    if min_abs_r is not None:
        half = half.filter(F.abs("r") >= min_abs_r)
    both = F.when(F.col("cell_a") == F.col("cell_b"), F.array(F.lit(False))) \
        .otherwise(F.array(F.lit(False), F.lit(True)))
    return half.withColumn("_swap", F.explode(both)).select(
        F.when(F.col("_swap"), F.col("cell_b")).otherwise(F.col("cell_a")).alias("cell_a"),
        F.when(F.col("_swap"), F.col("cell_a")).otherwise(F.col("cell_b")).alias("cell_b"), "r", "n")


def _closed(packed: DataFrame) -> DataFrame:
    return packed.select("cell_id", "blk", "off", "x").mapInArrow(close_rows, "cell_id STRING, blk BIGINT, z BINARY")


def centres(df: DataFrame) -> DataFrame:
    """``(cell_id, centre)``, settled."""
    return settle(df.groupBy("cell_id").agg(F.avg("v").alias("centre")))


def centred(df: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """``v`` less about its cell's mean. Sums of squares then keep their digits however large the
    mean is."""
    means = centres(df) if means is None else means
    return lookup_join(df, means, "cell_id", settled=True).select("cell_id", "t", (F.col("v") - F.col("centre")).alias("v"))


MANY_LAGS, POINT_BITS = 256, POINTS.bit_length() - 1


def lagged_sums(df: DataFrame, lags: int, size: int = BLOCK) -> DataFrame:
    """``(cell_id, lag, n, sx, ...)`` of the centred pairs (x_t, x_{t-lag}), lag 0..lags.

    Few lags are counted block by block, at a cost of slots times lags; more than ``MANY_LAGS`` by
    Fourier transforms, at a cost that hardly depends on the lags.
    """
    if lags > MANY_LAGS:
        return _spectral_sums(df, lags)
    size = max(size, lags, 1)

    def sums(row):
        x = spread_out(row.off, row.x, size + lags)
        for r in solvers.lag_products(x, lags, lags):
            if r[1]:
                yield (row.cell_id, *r)

    return map_rows(pack_blocks(centred(df), size, lags), sums, f"cell_id STRING, lag BIGINT, {SUM_TYPES}") \
        .groupBy("cell_id", "lag").agg(*_total())


def _spectral_sums(df: DataFrame, lags: int) -> DataFrame:
    """:func:`lagged_sums` by :mod:`spectral`. A row is a share of a series, a few megabytes."""
    points = 1 << POINT_BITS
    known = settle(centred(df.filter("cell_id IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL")))
    ends = known.groupBy("cell_id").agg(F.max("t").alias("_last"))
    bits = F.ceil(F.log2(F.col("_last") + F.least(F.col("_last"), F.lit(lags)) + 1 + F.lit(0.5))).cast("int")
    dealt = lookup_join(known, ends.select("cell_id", bits.alias("bits")), "cell_id")
    n2 = F.col("bits") - F.when(F.col("bits") <= POINT_BITS, F.col("bits")).otherwise(F.floor(F.col("bits") / 2))
    n1 = F.col("bits") - n2
    columns = F.least(n2, F.lit(POINT_BITS) - n1).cast("int")                # all as powers of two
    chunk = F.floor(F.pmod("t", F.pow(F.lit(2.0), n2)) / F.pow(F.lit(2.0), F.greatest(columns, F.lit(0)))).cast("int")
    first = spread(dealt.select("cell_id", "bits", chunk.alias("chunk"), "t", "v"), "cell_id", "chunk") \
        .groupBy("cell_id", "bits", "chunk").agg(F.collect_list(F.struct("t", "v")).alias("p")) \
        .select("cell_id", "bits", "chunk", F.col("p.t").alias("t"), F.col("p.v").alias("v"))

    def to_rows(row):
        split = Split(int(row.bits), points)
        x = spectral.down(split, int(row.chunk), np.asarray(row.t, np.int64), np.asarray(row.v))
        for to, part in enumerate(spectral.pieces(x, 1, split.rows)):
            yield row.cell_id, row.bits, to, row.chunk, part

    def to_columns(row):
        split = Split(int(row.bits), points)
        parts, blank = dict(zip(row.frm, row.x)), np.zeros(6 * split.rows * split.columns)
        x = spectral.joined([parts.get(i, blank) for i in range(split.n2 // split.columns)], (split.rows, split.columns), 2)
        back = spectral.across(split, int(row.chunk), x)
        for to, part in enumerate(spectral.pieces(back, 2, split.columns)):
            if to * split.columns <= lags:
                yield row.cell_id, row.bits, to, row.chunk, part

    def to_lags(row):
        split = Split(int(row.bits), points)
        parts = dict(zip(row.frm, row.x))
        x = spectral.joined([parts[i] for i in range(split.n1 // split.rows)], (split.rows, split.columns), 1)
        at, sums = spectral.up(split, int(row.chunk), x, lags)
        for lag, (n, *rest) in zip(at.tolist(), sums.tolist()):
            if n > 0.5:
                yield row.cell_id, lag, round(n), *rest

    def met(pieces: DataFrame) -> DataFrame:
        return spread(pieces, "cell_id", "chunk").groupBy("cell_id", "bits", "chunk") \
            .agg(F.collect_list(F.struct("frm", "x")).alias("p")) \
            .select("cell_id", "bits", "chunk", F.col("p.frm").alias("frm"), F.col("p.x").alias("x"))

    piece = "cell_id STRING, bits INT, chunk INT, frm INT, x ARRAY<DOUBLE>"
    rows = met(map_rows(first, to_rows, piece, 4))
    back = met(map_rows(rows, to_columns, piece, 4))
    return map_rows(back, to_lags, f"cell_id STRING, lag BIGINT, {SUM_TYPES}", 4)


def autocorrelation(df: DataFrame, lags: int, size: int = BLOCK) -> DataFrame:
    """``(cell_id, lag, r)``, each of the two slices with its own mean and deviation."""
    return lagged_sums(df, lags, size).filter(F.col("lag") > 0) \
        .select("cell_id", "lag", _pearson().alias("r"))


def acf(df: DataFrame, n_lags: int, size: int = BLOCK) -> DataFrame:
    """``(cell_id, lag, r, band)``: one mean for all lags, 1/n form, Bartlett 95% band."""
    sums = lagged_sums(df, n_lags, size)
    sums = settle(sums) if n_lags > MANY_LAGS else sums
    m, cell = F.col("_m"), W.partitionBy("cell_id")
    if n_lags > MANY_LAGS:                                # a cell's lags outgrow a task
        zero = sums.filter("lag = 0").select("cell_id", F.col("n").alias("_n"), (F.col("sx") / F.col("n")).alias("_m"), F.col("sxx").alias("_c0"))
        sums = lookup_join(sums, zero, "cell_id", salt_by="lag").withColumn("_c0", F.col("_c0") - F.col("_n") * m * m)
    else:
        at0 = lambda c: F.max(F.when(F.col("lag") == 0, F.col(c))).over(cell)
        sums = sums.withColumn("_n", at0("n")).withColumn("_m", at0("sx") / F.col("_n")) \
            .withColumn("_c0", at0("sxx") - F.col("_n") * m * m)
    r = F.try_divide(F.col("sxy") - m * (F.col("sx") + F.col("sy")) + F.col("n") * m * m, F.col("_c0"))
    rows = sums.select("cell_id", "lag", r.alias("r"), "_n")
    square = F.when(F.col("lag") > 0, F.col("r") * F.col("r"))
    upto = lambda w: F.coalesce(F.sum(square).over(w.orderBy("lag").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    if n_lags > MANY_LAGS:
        rows = settle(rows.withColumn("_b", F.coalesce(div("lag", 4096), F.lit(0).cast("bigint"))))
        blocks = cell.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        before = rows.groupBy("cell_id", "_b").agg(F.sum(square).alias("_q")) \
            .select("cell_id", "_b", F.coalesce(F.sum("_q").over(blocks), F.lit(0.0)).alias("_before"))
        rows = rows.withColumn("_here", upto(W.partitionBy("cell_id", "_b"))).join(before.hint("merge"), ["cell_id", "_b"])
        squares = F.col("_before") + F.col("_here")
    else:
        squares = upto(cell)
    band = F.when(F.col("lag") == 0, F.lit(0.0)) \
        .otherwise(F.lit(1.96) * F.sqrt((F.lit(1.0) + F.lit(2.0) * squares) / F.col("_n")))
    return rows.withColumn("band", band).select("cell_id", "lag", "r", "band")


def pacf(df: DataFrame, n_lags: int, size: int = BLOCK) -> DataFrame:
    """``(cell_id, lag, r)`` by Durbin-Levinson on the 1/n autocorrelations."""
    rows = acf(df, n_lags, size).groupBy("cell_id").agg(
        F.sort_array(F.collect_list(F.struct("lag", "r"))).alias("p")) \
        .select("cell_id", F.col("p.r").alias("r"))

    def solve(row):
        r = [float(v) for v in row.r if v is not None]
        solved = solvers.partial_from_acf(r) if len(r) == len(row.r) else [None] * len(row.r)   # NULL: a constant cell
        for lag, value in enumerate(solved):
            yield row.cell_id, lag, value

    return map_rows(rows, solve, "cell_id STRING, lag BIGINT, r DOUBLE")


def series_summary(df: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """``(cell_id, n, total, cross, head, tail, centre)`` of gapless, trimmed series.

    All but ``centre`` is of the series less its ``centre``. ``cross[d]`` sums x_t x_{t-d};
    head and tail are the first and last ``k`` values.
    From these the Gram matrix of all lags up to ``k`` follows (``centred_gram``), so a
    regression on lags needs one pass over the data, not one per model. Each block
    offers its head and tail; the first and the last block's are kept.
    """
    size = max(size, k, 1)

    def summarise(row):
        x = spread_out(row.off, row.x, size + k)
        sums = solvers.lag_products(x, k, k)
        if not sums[0][1]:
            return
        known = np.asarray(row.x, float)
        body = np.asarray(row.off) >= k
        yield (row.cell_id, row.blk, sums[0][1], sums[0][2], [r[-1] for r in sums],
               known[body][:k] if row.blk == 0 else None, known[max(len(known) - k, 0):])

    means = centres(df)
    blocks = map_rows(pack_blocks(centred(df, means), size, k), summarise,
                      "cell_id STRING, blk BIGINT, n BIGINT, total DOUBLE, cross ARRAY<DOUBLE>, "
                      "head ARRAY<DOUBLE>, tail ARRAY<DOUBLE>")
    sums = blocks.groupBy("cell_id").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.array(*[F.sum(F.col("cross")[d]) for d in range(k + 1)]).alias("cross"),
        F.min_by("head", "blk").alias("head"), F.max_by("tail", "blk").alias("tail"))
    return lookup_join(sums, means, "cell_id", salt_by="n", settled=True)


ADF_SCHEMA = ("cell_id STRING, stat DOUBLE, p_value DOUBLE, used_lag BIGINT, n_obs BIGINT, "
              "crit_1 DOUBLE, crit_5 DOUBLE, crit_10 DOUBLE")


def adf_lags(n: int) -> int:
    """The usual greatest number of lagged differences for ``n`` slots."""
    return max(min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2), 0)


def adf_test(df: DataFrame, max_lag: int | None = None, size: int = BLOCK) -> DataFrame:
    """Augmented Dickey-Fuller with constant; lag count by AIC, up to ``max_lag`` or what is usual
    for each cell's own length."""
    most = max_lag
    if most is None:
        last = df.agg(F.max("t")).first()[0]
        most = adf_lags(0 if last is None else last + 1)

    def solve(row):
        lags = adf_lags(int(row.n)) if max_lag is None else max_lag
        if row.n > 2 * lags + 3:
            yield (row.cell_id, *solvers.adf(int(row.n), row.total, row.cross[:lags + 2], row.head[:lags + 1],
                                             row.tail[-(lags + 1):], lags))
        else:                                  # too short for so many lags
            yield (row.cell_id, None, None, None, int(row.n), None, None, None)

    return map_rows(spread(series_summary(df, most + 1, size), "cell_id"), solve, ADF_SCHEMA)


def adf_lag0(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """The test without lagged differences, in closed form from the lag-1 sums."""
    s = lagged_sums(df, 1, size).filter(F.col("lag") == 1)
    n = F.col("n")
    # x = y_{t-1} (columns sy, syy), d = y_t - y_{t-1}
    sxx = F.col("syy") - F.col("sy") * F.col("sy") / n
    sd = F.col("sx") - F.col("sy")
    sxd = F.col("sxy") - F.col("syy") - F.col("sy") * sd / n
    sdd = F.col("sxx") - F.lit(2.0) * F.col("sxy") + F.col("syy") - sd * sd / n
    slope = F.try_divide(sxd, sxx)
    se = F.sqrt(F.try_divide((sdd - slope * sxd) / (n - 2), sxx))
    return s.select("cell_id", F.try_divide(slope, se).alias("stat"), n.alias("n_obs"))
