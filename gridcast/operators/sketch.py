"""Which cells can correlate at all: exact pruning by a short Fourier sketch.

A complete cell, less its mean and of length one, is a unit vector; the correlation of two is their
product. An orthonormal transform keeps products, so with the kept coefficients ``a``, ``b`` and the
lengths ``s``, ``t`` of what was left out, ``|r| <= |a.b| + s t``. And ``r >= m`` means that the
vectors, hence any coefficients of theirs, lie within ``sqrt(2 - 2 m)``; for ``r <= -m`` the same
holds with one of them mirrored. Cells are put on a grid of that width by their strongest
coefficients, groups of neighbouring grid cells meet by an equi-join, and the bound then names the
cells of two groups that need the exact product. No pair above ``m`` is ever lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridcast.functions.scale_out import lookup_join, map_rows, settle, spread, spread_out

FREQUENCIES = 128          # transformed; the strongest coefficients over all cells are kept
KEPT = 32
DIMS = 3                   # of the grid
PORTION = 256              # cells of a group compared with another group at once
SLACK = 1e-6               # far above the rounding of sums, far below any threshold of use


def _fourier_sums(packed: DataFrame, first: int, n: int, size: int) -> DataFrame:
    """``(cell_id, z)``: sum of squares, sum, then real and imaginary parts per frequency."""
    freq = np.arange(1, min(FREQUENCIES, (n - 1) // 2) + 1)

    def sums(frames):
        waves = np.exp(-2j * np.pi * (np.outer(np.arange(size), freq) % n) / n)
        for pdf in frames:
            if pdf.empty:
                continue
            x = np.nan_to_num([spread_out(o, v, size) for o, v in zip(pdf["off"], pdf["x"])])
            began = pdf["blk"].to_numpy(np.int64) * size - first
            turned = (x @ waves) * np.exp(-2j * np.pi * (np.outer(began, freq) % n) / n)
            z = np.column_stack([(x * x).sum(axis=1), x.sum(axis=1), turned.real, turned.imag])
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "z": list(z)})

    return packed.select("cell_id", "blk", "off", "x").mapInPandas(sums, "cell_id STRING, z ARRAY<DOUBLE>") \
        .select("cell_id", F.posexplode("z").alias("pos", "z")) \
        .groupBy("cell_id", "pos").agg(F.sum("z").alias("z")) \
        .groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("pos", "z"))).alias("_p")) \
        .select("cell_id", F.col("_p.z").alias("z"))


def _sketches(packed: DataFrame, first: int, n: int, size: int) -> DataFrame:
    """``(cell_id, c, rest)``: kept coefficients, strongest first, and the length of the others.
    Cells that do not vary have none."""
    sums = settle(_fourier_sums(packed, first, n, size))
    left = F.col("z")[0] - F.col("z")[1] * F.col("z")[1] / F.lit(n)
    unit = sums.filter(left > F.lit(1e-13) * F.col("z")[0]).select(
        "cell_id", F.transform(F.slice("z", 3, 2 * FREQUENCIES), lambda c: c * F.sqrt(F.try_divide(F.lit(2.0 / n), left))).alias("c"))
    strong = unit.select(F.posexplode("c").alias("pos", "c")).groupBy("pos").agg(F.sum(F.col("c") * F.col("c")).alias("e")) \
        .orderBy(F.desc("e"), "pos").limit(KEPT).collect()
    kept = unit.select("cell_id", F.array(*[F.col("c")[r["pos"]] for r in strong]).cast("array<double>").alias("c"))
    power = F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)
    return settle(kept.withColumn("rest", F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - power))))


def _linked_groups(buckets: DataFrame, dims: int) -> DataFrame:
    """``(_ga, _gb)``: groups of the same or neighbouring grid cells, the grid of one side also
    mirrored; each couple once. ``buckets`` has ``(b, key, parts)``."""
    def reach(low: Callable[[Column], Column], high: Callable[[Column], Column]) -> DataFrame:
        out = buckets
        for j in range(dims):
            b = F.col("b")[j]
            out = out.withColumn(f"_{j}", F.explode(F.sequence(low(b), high(b))))
        return out.select("key", "parts", F.concat_ws(",", *[F.col(f"_{j}").cast("string") for j in range(dims)]).alias("near"))

    met = reach(lambda b: b - 1, lambda b: b + 1).unionByName(reach(lambda b: -b - 2, lambda b: -b + 1))
    other = buckets.select(F.col("key").alias("near"), F.col("parts").alias("near_parts"))
    couples = met.join(other, "near").filter("key <= near").dropDuplicates(["key", "near"])
    tiles = couples.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .withColumn("_j", F.explode(F.sequence(F.when(F.col("key") == F.col("near"), F.col("_i")).otherwise(F.lit(0)),
                                               F.col("near_parts") - 1)))
    return tiles.select(_group("key", "_i").alias("_ga"), _group("near", "_j").alias("_gb"))


def _group(key: str, part: str) -> Column:
    return F.concat_ws("#", F.col(key), F.col(part).cast("string"))


def _close(sketches: DataFrame, min_abs_r: float, group: int) -> DataFrame:
    """Seats of complete cells in the tiles where the bound allows ``min_abs_r``."""
    dims = min(DIMS, sketches.select(F.max(F.size("c"))).first()[0] or 0)
    if not dims:
        return sketches.sparkSession.createDataFrame([], "cell_id STRING, _g STRING, _ga STRING, _gb STRING")
    width = math.sqrt(max(2 - 2 * min_abs_r, 0)) + SLACK
    spots = sketches.withColumn("b", F.array(*[F.floor(F.col("c")[j] / F.lit(width)) for j in range(dims)])) \
        .withColumn("key", F.concat_ws(",", F.col("b").cast("array<string>")))
    buckets = settle(spots.groupBy("key").agg(F.first("b").alias("b"), F.ceil(F.count("*") / group).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("cell_id"), F.col("parts"))
    members = settle(lookup_join(spots.drop("b"), buckets.select("key", "parts"), "key", salt_by="cell_id", settled=True)
                     .withColumn("_i", part).groupBy(_group("key", "_i").alias("g"))
                     .agg(F.collect_list(F.struct("cell_id", "c", "rest")).alias("m"))
                     .select("g", F.struct(F.col("m.cell_id").alias("ids"), F.flatten("m.c").alias("c"), F.col("m.rest").alias("rest")).alias("cells")))
    links = settle(_linked_groups(buckets, dims))
    tiles = links.join(members.select(F.col("g").alias("ga"), *[F.col(f"cells.{c}").alias(f"{c}_a") for c in ("ids", "c", "rest")]),
                       F.col("_ga") == F.col("ga")) \
        .join(members.select(F.col("g").alias("gb"), *[F.col(f"cells.{c}").alias(f"{c}_b") for c in ("ids", "c", "rest")]),
              F.col("_gb") == F.col("gb")).drop("_ga", "_gb")

    def allowed(row):
        a, b = np.asarray(row.c_a).reshape(len(row.ids_a), -1), np.asarray(row.c_b).reshape(len(row.ids_b), -1)
        s, t = np.asarray(row.rest_a), np.asarray(row.rest_b)
        rows, cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for at in range(0, len(a), PORTION):
            hit = reachable(a[at:at + PORTION], s[at:at + PORTION], b, t, min_abs_r)
            rows[at:at + PORTION] |= hit.any(axis=1)
            cols |= hit.any(axis=0)
        if row.ga == row.gb:
            rows |= cols
        sides = [(row.ga, row.ids_a, rows), (row.gb, row.ids_b, cols)]
        for g, ids, need in sides[:1 if row.ga == row.gb else 2]:
            for i in np.flatnonzero(need):
                yield ids[i], g, row.ga, row.gb

    return map_rows(spread(tiles, "ga", "gb"), allowed, "cell_id STRING, _g STRING, _ga STRING, _gb STRING", every=1)


def reachable(a: np.ndarray, s: np.ndarray, b: np.ndarray, t: np.ndarray, min_abs_r: float) -> np.ndarray:
    """The pairs of sketches whose bound allows ``min_abs_r``; no bound (NaN) allows it."""
    return ~(np.abs(a @ b.T) + np.outer(s, t) < min_abs_r - SLACK)


def _everyone(whole: DataFrame, gappy: DataFrame, groups: int, gappy_groups: int) -> DataFrame:
    """Seats of cells with gaps: they meet all cells, as each pair has slots of its own."""
    def name(kind: str, k: Column) -> Column:
        return F.concat(F.lit(kind), k.cast("string"))

    def numbers(k: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    own = F.xxhash64("cell_id")
    gappy = gappy.select("cell_id", name("r", F.pmod(own, F.lit(gappy_groups))).alias("_g"))
    among = gappy.withColumn("_o", numbers(gappy_groups)).withColumn("_o", name("r", F.col("_o"))) \
        .select("cell_id", "_g", F.least("_g", "_o").alias("_ga"), F.greatest("_g", "_o").alias("_gb"))
    if not groups:
        return among
    left = whole.select("cell_id", name("c", F.pmod(own, F.lit(groups))).alias("_g")).withColumn("_o", numbers(gappy_groups)) \
        .select("cell_id", "_g", F.col("_g").alias("_ga"), name("r", F.col("_o")).alias("_gb"))
    right = gappy.withColumn("_o", numbers(groups)) \
        .select("cell_id", "_g", name("c", F.col("_o")).alias("_ga"), F.col("_g").alias("_gb"))
    return among.unionByName(left).unionByName(right)


def seats(packed: DataFrame, stats: DataFrame, min_abs_r: float, group: int, size: int) -> DataFrame:
    """``(cell_id, _g, _ga, _gb)``, settled: the cell takes part in tile ``(_ga, _gb)`` as one of ``_g``."""
    return seats_and_sketches(packed, stats, min_abs_r, group, size)[0]


def seats_and_sketches(packed: DataFrame, stats: DataFrame, min_abs_r: float, group: int, size: int) \
        -> tuple[DataFrame, DataFrame | None]:
    """:func:`seats`, and ``(cell_id, c, rest)`` of the cells that have a sketch (None if no cell has).

    ``packed`` holds centred blocks, ``stats`` per cell ``n``, ``first`` and ``last`` of the known
    slots. Cells that know every slot of the most frequent range are pruned by their sketch; all
    others meet everyone. Cells that do not vary have no seat among the first, as they have no
    correlation.
    """
    full = stats.filter("n = last - first + 1 AND n > 8")
    usual = full.groupBy("first", "last").agg(F.count("*").alias("cells")).orderBy(F.desc("cells"), "first", "last").first()
    everyone = stats.filter("n > 0 AND cell_id IS NOT NULL")
    if usual is None:
        return settle(_everyone(everyone, everyone, 0, max(1, math.ceil(everyone.count() / group)))), None
    first, last = int(usual["first"]), int(usual["last"])
    inside = (F.col("first") == first) & (F.col("last") == last) & (F.col("n") == last - first + 1)
    whole, gappy = everyone.filter(inside).select("cell_id"), everyone.filter(~inside).select("cell_id")
    blocks = lookup_join(packed, settle(whole), "cell_id", "left_semi", salt_by="blk", settled=True)
    sketches = _sketches(blocks, first, last - first + 1, size)
    taken = _close(sketches, min_abs_r, group)
    others = gappy.count()
    if others:
        taken = taken.unionByName(_everyone(sketches.select("cell_id"), gappy, math.ceil(sketches.count() / group),
                                            math.ceil(others / group)))
    return settle(taken), sketches


def within(min_abs_r: float):
    """Tells for rows ``(c, rest)`` of two sides which pairs can reach ``min_abs_r``; cells without a
    sketch (None) can."""
    def may(left, right):
        width = max((len(c) for c, _ in (*left, *right) if c is not None), default=0)
        (a, s), (b, t) = [(np.array([np.full(width, np.nan) if c is None else c for c, _ in side]).reshape(len(side), width),
                           np.array([np.nan if c is None else rest for c, rest in side], float)) for side in (left, right)]
        return reachable(a, s, b, t, min_abs_r)

    return may


def pairs_examined(taken: DataFrame) -> int:
    """How many pairs of cells the tiles of ``taken`` multiply out, each cell with itself included."""
    left, right = (F.count(F.when(F.col("_g") == F.col(side), 1)) for side in ("_ga", "_gb"))
    tiles = taken.groupBy("_ga", "_gb").agg(left.alias("l"), right.alias("r"))
    pairs = F.when(F.col("_ga") == F.col("_gb"), F.col("l") * (F.col("l") + 1) / 2).otherwise(F.col("l") * F.col("r"))
    return int(tiles.agg(F.sum(pairs)).first()[0] or 0)
