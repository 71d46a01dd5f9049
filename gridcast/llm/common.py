"""What the corpus operators share: tables, word patterns, settled frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; NULL as an empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each are about ``size`` bytes; a longer text stands alone."""
    for batch in batches:
        col = batch.column(name)
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        group = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def joined(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All words in one list, and where each text's words begin and end in it."""
    ends = np.cumsum([0, *map(len, words)], dtype=np.int64)
    return [w for ws in words for w in ws], ends



def map_texts(df: DataFrame, fn, fields: T.StructType, keep: list[str] | None = None,
              size: int = 8 << 20, text: str = "text", uses: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns that ``fn(batch)`` gives, one list or array per field.

    ``keep`` names the input columns to carry on (default all); one named like a new field
    gives way to it. ``uses`` names further columns that ``fn`` reads and that end here. Texts
    pass in slices of about ``size`` bytes.
    """
    new = {f.name.lower() for f in fields}
    carried = [f for f in df.schema if f.name.lower() not in new and f.name not in uses and (keep is None or f.name in keep)]
    names = [f.name for f in carried]
    given = [n for n in df.columns if n in (*names, *uses, text)]
    plain = {n: f"c{i}" for i, n in enumerate(given)}                # mapInArrow takes no dots in names
    made = T.StructType([T.StructField(plain[f.name], f.dataType, f.nullable) for f in carried] +
                        [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(fields)])
    schema = to_arrow_schema(made)
    types = list(schema.types)[len(names):]

    def run(batches):
        named = (pa.RecordBatch.from_arrays(batch.columns, given) for batch in batches)
        for batch in slices(named, text, size):
            results = [pa.array(x, t, from_pandas=False) for x, t in zip(fn(batch), types)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + results, schema.names)

    read = df.select(*[F.col(quoted(n)).alias(plain[n]) for n in given])
    return read.mapInArrow(run, made).toDF(*names, *fields.names)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


BOX = "_gc_row"


def box(docs: DataFrame, names: list[str]) -> Column:
    """``names`` in one struct with fields of plain names, so that no column of the user's meets one
    of an operator's."""
    return F.struct(*[F.col(quoted(n)).alias(f"c{i}") for i, n in enumerate(names)], F.lit(0).alias("c")).alias(BOX)


def unbox(names: list[str]) -> list[Column]:
    return [F.col(BOX).getField(f"c{i}").alias(n) for i, n in enumerate(names)]
