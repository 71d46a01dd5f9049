"""Dropping sparse cells and filling gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from gridcast.functions.exprs import unit_range
from gridcast.functions.scale_out import div, lookup_join, settle, span

FAN = 4096


def cell_profile(df: DataFrame) -> DataFrame:
    """Per cell, in one pass: known values, range, first known slot."""
    return df.groupBy("cell_id").agg(
        F.count("v").alias("n_known"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.min(F.when(F.col("v").isNotNull(), F.col("t"))).alias("t_first"),
        F.max("t").alias("t_last"))


def drop_sparse_cells(df: DataFrame, thresh: int) -> DataFrame:
    """Keep a cell iff it has at least ``thresh`` known values."""
    kept = df.groupBy("cell_id").agg(F.count("v").alias("n")) \
        .filter(F.col("n") >= thresh).select("cell_id")
    return lookup_join(df, kept, "cell_id", "left_semi")


def with_next_known(points: DataFrame, width: int = FAN, levels: int = 2) -> DataFrame:
    """Add ``nt, nv``, the next known point of the cell.

    Looked up inside blocks of ``width`` slots; what lies past the end of a block comes
    from the heads of the later blocks, which are searched the same way, in blocks
    ``width`` times as wide. No task ever sorts a whole long series.
    """
    if levels == 0:
        w = W.partitionBy("cell_id").orderBy("t")
        return points.select("cell_id", "t", "v", F.lead("t").over(w).alias("nt"),
                             F.lead("v").over(w).alias("nv"))
    # Keys that cannot be NULL keep the two uses of the shuffle below alike, so Spark
    # runs it (and the scan under it) once.
    block = F.coalesce(div("t", width), F.lit(0).cast("bigint"))
    p = points.filter(F.col("cell_id").isNotNull() & F.col("t").isNotNull()) \
        .select("cell_id", "t", "v", block.alias("_b")).repartition("cell_id", "_b")
    w = W.partitionBy("cell_id", "_b").orderBy("t")
    inner = p.select("*", F.lead("t").over(w).alias("nt"), F.lead("v").over(w).alias("nv"))
    heads = p.groupBy("cell_id", "_b").agg(F.min("t").alias("t"), F.min_by("v", "t").alias("v"))
    later = with_next_known(heads, width * FAN, levels - 1).select(
        "cell_id", block.alias("_b"), F.col("nt").alias("_nt"), F.col("nv").alias("_nv"))
    # Both sides are partitioned (and the left one sorted) by the join keys already.
    return inner.join(later.hint("merge"), ["cell_id", "_b"]).select(
        "cell_id", "t", "v", F.coalesce("nt", "_nt").alias("nt"),
        F.coalesce("nv", "_nv").alias("nv"))


def interpolate_linear(df: DataFrame, periods: int | None = None, width: int = FAN) -> DataFrame:
    """Fill every slot ``0..periods-1`` of every cell, linearly by position.

    Gaps after the last value repeat it, gaps before the first stay NULL. Points at or past
    ``periods`` give no row, but the slope towards the first of them counts. Only the known
    points are shuffled; filled rows are generated between them.
    """
    profile = settle(cell_profile(df))
    n = periods or (profile.agg(F.max("t_last")).first()[0] or 0) + 1
    return _after_first(df, n, width).unionByName(_before_first(profile, n))


def levels_for(slots: int, width: int = FAN) -> int:
    """Fewest levels of blocks that keep every sort below ``width`` points of a cell."""
    return 0 if slots <= width else 1 if slots <= width * FAN else 2


def _after_first(df: DataFrame, n: int, width: int = FAN) -> DataFrame:
    points = with_next_known(df.filter(F.col("v").isNotNull()), width, levels_for(n, width))
    blocks, slots = span(F.col("_from"), F.col("_to"))
    v0, v1, t0, t1 = F.col("v"), F.col("nv"), F.col("_from"), F.col("nt")
    value = F.when(t1.isNull() | (F.col("t") == t0), v0) \
        .otherwise(v0 + (v1 - v0) * (F.col("t") - t0) / (t1 - t0))
    end = F.lit(n).cast("bigint")
    return points.filter(F.col("t") < n).select(
        "cell_id", F.col("t").alias("_from"), "v", "nt", "nv", (F.least(F.coalesce("nt", end), end) - 1).alias("_to")) \
        .withColumn("_blk", F.explode(blocks)).withColumn("t", F.explode(slots())) \
        .select("cell_id", "t", value.alias("v"))


def _before_first(profile: DataFrame, n: int) -> DataFrame:
    blocks, slots = span(F.lit(0).cast("bigint"), F.col("_to"))
    end = F.lit(n).cast("bigint")
    return profile.select("cell_id", (F.least(F.coalesce("t_first", end), end) - 1).alias("_to")) \
        .withColumn("_blk", F.explode(blocks)).withColumn("t", F.explode(slots())) \
        .select("cell_id", "t", F.lit(None).cast("double").alias("v"))


def trim_leading(df: DataFrame) -> DataFrame:
    """Start each cell at its own first known slot and count ``t`` from there."""
    first = df.filter(F.col("v").isNotNull()).groupBy("cell_id").agg(F.min("t").alias("_first"))
    return lookup_join(df, first, "cell_id").filter(F.col("t") >= F.col("_first")) \
        .select("cell_id", (F.col("t") - F.col("_first")).alias("t"), "v")


def usual_start(df: DataFrame, share: float = 0.9) -> int:
    """The slot by which ``share`` of the cells are known."""
    first = df.filter(F.col("v").isNotNull()).groupBy("cell_id").agg(F.min("t").alias("f"))
    return first.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY f)")).first()[0] or 0


def late_cells(df: DataFrame, start: int) -> DataFrame:
    """``(cell_id, t_first)`` of the cells that ``prepare(start=start)`` leaves out as not yet known."""
    return cell_profile(df).filter(F.col("t_first") > start).select("cell_id", "t_first")


def prepare(df: DataFrame, thresh: int = 1, periods: int | None = None,
            scaled: bool = True, start: int | None = None) -> DataFrame:
    """Drop sparse cells, interpolate, scale to [0, 1], trim: one profile pass, one fill.

    Each cell starts at its own first known slot, so no cell depends on another, and counts
    ``t`` from there. Where all cells are needed side by side, ``start`` gives them one common
    start instead; cells not known by then are left out (see ``late_cells``).
    """
    profile = settle(cell_profile(df))
    keep = F.col("n_known") >= max(thresh, 1)
    if start is not None:
        keep = keep & (F.col("t_first") <= start)
    n = periods or (profile.agg(F.max("t_last")).first()[0] or 0) + 1
    begin = F.col("t_first") if start is None else F.lit(start).cast("bigint")
    limits = profile.filter(keep).select("cell_id", "low", "high", begin.alias("_begin"))
    filled = lookup_join(_after_first(df, n), limits, "cell_id", settled=True).filter(F.col("t") >= F.col("_begin"))
    v = unit_range(F.col("v"), F.col("low"), F.col("high")) if scaled else F.col("v")
    return filled.select("cell_id", (F.col("t") - F.col("_begin")).alias("t"), v.alias("v"))
