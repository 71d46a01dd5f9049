"""Helpers that keep plans safe at size: settled tables, sized joins, packed blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20 # of strings and arrays
HOT_ROWS = 1_000_000       # rows of one key in one task
BLOCK = 1024               # slots per packed block
FAN_IN = 1024              # blocks folded by one task of a carry
_paths: list[str] = []     # written to the shared folder in this process


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master gets one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridcast-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, dropped by :func:`release`."""
    _paths.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def release(spark: SparkSession) -> None:
    """Delete what was written for results that nobody reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _paths:
        at = jvm.org.apache.hadoop.fs.Path(_paths.pop())
        at.getFileSystem(conf).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: no lineage, pruned columns."""
    df.write.option("compression", "zstd").parquet(path := scratch_path(df.sparkSession, "settled"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Few rows, and strings and arrays of few bytes."""
    wide = [f.name for f in side.schema if not isinstance(f.dataType, T.NumericType)]
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in wide), F.lit(0))
    n, total = side.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return n <= max_rows and (total or 0) <= BROADCAST_BYTES


def rows_for(width: int) -> int:
    """How many rows with an array of ``width`` doubles are still broadcast."""
    return 4 * BROADCAST_ROWS // (width + 4)


def lookup_join(df: DataFrame, side: DataFrame, on: str, how: str = "inner",
                salt_by: str = "t", max_rows: int = BROADCAST_ROWS,
                settled: bool = False) -> DataFrame:
    """Join a large frame with a table that has one row per ``on``.

    The side is settled and counted. Small: broadcast, so ``df`` does not move.
    Otherwise: a shuffle join in which every key holding more than HOT_ROWS rows is dealt
    over as many salts as it has such portions.
    """
    side = side if settled else settle(side)
    if fits_broadcast(side, max_rows):
        return df.join(F.broadcast(side), on, how)
    portions = F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_salts")
    hot = settle(df.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select(on, portions))
    if hot.isEmpty():
        return df.join(side, on, how)
    # At most one hot key per HOT_ROWS rows, so this side stays small beside the others.
    one = F.coalesce(F.col("_salts"), F.lit(1))
    salted = _with_salts(df, hot, on).withColumn("_salt", F.pmod(F.xxhash64(salt_by), one).cast("int")).drop("_salts")
    repeated = _with_salts(side, hot, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return salted.join(repeated, [on, "_salt"], how).drop("_salt")


def _with_salts(df: DataFrame, hot: DataFrame, on: str) -> DataFrame:
    return df.join(F.broadcast(hot) if fits_broadcast(hot) else hot, on, "left")


def _partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def span(first: Column, last: Column, size: int = BLOCK) -> tuple[Column, Callable[[], Column]]:
    """Two short arrays in place of one long ``sequence(first, last)``.

    Returns the block sequence to explode as ``_blk`` and a function giving the
    slots of that block, so no array outgrows ``size``. ``last < first`` gives none.
    """
    blocks = F.when(last >= first, F.sequence(_div(first, size), _div(last, size))) \
        .otherwise(F.array().cast("array<bigint>"))

    def slots() -> Column:
        lo = F.col("_blk") * F.lit(size)
        return F.sequence(F.greatest(first, lo), F.least(last, lo + F.lit(size - 1)))

    return blocks, slots


def _div(c: Column, size: int) -> Column:
    """Floor division of a non-negative BIGINT, without a detour over DOUBLE."""
    return ((c - F.pmod(c, F.lit(size))) / F.lit(size)).cast("bigint")


def div(c: Column | str, size: int) -> Column:
    return _div(F.col(c) if isinstance(c, str) else c, size)


def pack_blocks(df: DataFrame, size: int = BLOCK, halo: int = 0) -> DataFrame:
    """``(cell_id, blk, off, x)``: the known values of slots ``[blk*size, (blk+1)*size)``.

    ``off`` counts from ``halo`` slots before the block, and those slots come along,
    so a block can be worked on without its neighbours. Groups never outgrow
    ``size + halo`` rows, however long a series is; a long series becomes many blocks.
    """
    size = max(size, halo, 1)
    # Keys that cannot be NULL: a later join on them adds no filter of its own, so all
    # users of the packed blocks share one shuffle.
    own = F.coalesce(div("t", size), F.lit(0).cast("bigint"))
    homes = F.array(own)
    if halo:
        homes = F.when(F.pmod("t", F.lit(size)) >= size - halo, F.array(own, own + 1)) \
            .otherwise(homes)
    rows = df.filter(F.col("v").isNotNull() & F.col("cell_id").isNotNull() & F.col("t").isNotNull()) \
        .select("cell_id", "t", "v", F.explode(homes).alias("blk"))
    off = (F.col("t") - F.col("blk") * size + halo).cast("int")
    packed = rows.groupBy("cell_id", "blk").agg(
        F.sort_array(F.collect_list(F.struct(off.alias("off"), F.col("v")))).alias("pts"))
    return packed.select("cell_id", "blk", F.col("pts.off").alias("off"),
                         F.col("pts.v").alias("x"))


def spread_out(off, x, width: int) -> np.ndarray:
    """Packed values on their slots, NaN where nothing is known."""
    out = np.full(width, np.nan)
    out[np.asarray(off, dtype=np.int64)] = x
    return out


def spread(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Shuffle by ``keys`` into the session's number of partitions, or ``most`` if that is less.

    A fixed number keeps adaptive execution from merging partitions that are small in
    bytes but long in computing.
    """
    return df.repartition(min(_partitions(df), most or _partitions(df)), *keys)


def map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, every: int | None = None) -> DataFrame:
    """``mapInPandas`` with one small function per (packed) row; results leave after ``every``
    rows where these are large."""
    names = T._parse_datatype_string(schema).fieldNames()

    def run(batches):
        for whole in batches:
            step = every or max(len(whole), 1)
            for pdf in (whole.iloc[i:i + step] for i in range(0, len(whole), step)):
                out = [r for row in pdf.itertuples(index=False) for r in fn(row)]
                yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def row_groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterable[pd.DataFrame]:
    """The rows of each key, from frames sorted by key."""
    held = None
    for pdf in frames:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        parts = [g for _, g in held.groupby(keys, sort=False, dropna=False)]
        yield from parts[:-1]
        held = parts[-1] if parts else None
    if held is not None:
        yield held
