"""Readers, writers and changes of shape (wide frame <-> long frame)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridcast.functions.exprs import cell_key, known
from gridcast.functions.scale_out import fits_broadcast, lookup_join, settle, span


def _with_ordinal(df: DataFrame, name: str) -> DataFrame:
    """Row position in file order.

    Ids rise within a file split, so a row's position is its distance from the split's least
    id plus the rows of the splits before. Only one small row per split is gathered, a hundred
    bytes for every 128 MB read; the rows themselves stay where they are read, unless there are
    so many splits that these no longer fit a broadcast.
    """
    cols = df.columns
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_split"),
                     F.monotonically_increasing_id().alias("_id"))
    ends = rows.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    before = W.orderBy("_file", "_split").rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select("_file", "_split", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    offsets = settle(offsets)
    return rows.join(F.broadcast(offsets) if fits_broadcast(offsets) else offsets, ["_file", "_split"]) \
        .select((F.col("_before") + F.col("_id") - F.col("_low")).alias(name), *cols)


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """Headerless cell list (longitude, latitude) -> ``(ord, lon, lat, cell_id)``."""
    raw = spark.read.csv(path, header=False, schema="lon DOUBLE, lat DOUBLE")
    return _with_ordinal(raw, "ord").select(
        F.col("ord").cast("int").alias("ord"), "lon", "lat",
        cell_key(F.col("lat"), F.col("lon")).alias("cell_id"))


def scan_traffic_wide(spark: SparkSession, path: str, cells: Sequence[str] | None = None,
                      fmt: str = "csv") -> DataFrame:
    """Wide traffic table: ``t`` = row position, one DOUBLE column per cell.

    CSV columns are typed from the header line alone; a Parquet file must carry ``t``.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        header = spark.read.csv(path, header=True).columns
        schema = ", ".join(f"`{c}` DOUBLE" for c in header)
        df = _with_ordinal(spark.read.csv(path, header=True, schema=schema), "t")
    keep = [c for c in df.columns if c != "t" and (cells is None or c in set(cells))]
    return df.select(F.col("t").cast("bigint").alias("t"),
                     *[known(F.col(f"`{c}`")).alias(c) for c in keep])


def wide_to_long(wide: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    keys = [c for c in wide.columns if c != "t"] if keys is None else list(keys)
    return wide.unpivot(["t"], [F.col(f"`{k}`") for k in keys], "cell_id", "v") \
        .select("cell_id", "t", "v")


def long_to_wide(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column per key; the explicit list saves the pass that would look for keys."""
    return df.groupBy("t").pivot("cell_id", list(keys)).agg(F.first("v"))


def last_slot(df: DataFrame) -> Column:
    return df.agg(F.max("t").alias("m")).scalar()


def reindex_cells(df: DataFrame, cells: DataFrame, periods: int | Column | None = None) -> DataFrame:
    """Keep the listed cells, in a full grid; a cell without data is all NULL.

    A key listed twice counts once. The list is filtered by a semi-join, so unlisted
    rows never reach the shuffle; the grid comes from the list by ``explode``.
    """
    end = (last_slot(df) if periods is None else
           F.lit(periods) - 1 if isinstance(periods, int) else periods - 1).cast("bigint")
    listed = cells.select("cell_id").distinct()
    blocks, slots = span(F.lit(0).cast("bigint"), F.col("_end"))
    # Blocks are spread before they are widened, so a short list still fills the cluster.
    grid = listed.withColumn("_end", end).withColumn("_blk", F.explode(blocks)) \
        .repartition("cell_id", "_blk") \
        .select("cell_id", F.explode(slots()).alias("t"))
    return grid.join(only_cells(df, listed).select("cell_id", "t", "v"), ["cell_id", "t"], "left")


def only_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of the listed cells; unlisted rows go before anything is shuffled."""
    return lookup_join(df, cells.select("cell_id").distinct(), "cell_id", "left_semi")


def reindex_wide(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The wide form: an unknown key becomes an all-NULL column."""
    have = set(wide.columns)
    return wide.select("t", *[F.col(f"`{k}`") if k in have else
                              F.lit(None).cast("double").alias(k) for k in dict.fromkeys(keys)])


def time_grid(spark: SparkSession, start: str, minutes: int, periods: int) -> DataFrame:
    return attach_time(spark.range(periods).select(F.col("id").alias("t")), start, minutes)


def attach_time(df: DataFrame, start: str, minutes: int) -> DataFrame:
    """Add ``ts``, the start of slot ``t``."""
    begin = F.lit(start).cast("timestamp_ntz")
    return df.withColumn("ts", F.timestamp_add("MINUTE", F.col("t") * minutes, begin))


def select_target(df: DataFrame, cell_id: str) -> DataFrame:
    """The target's rows; KeyError if it is not (or no longer) there."""
    target = df.filter(F.col("cell_id") == cell_id)
    if target.isEmpty():
        raise KeyError(cell_id)
    return target


def write_series(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)
