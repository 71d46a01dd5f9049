"""Whitening of embeddings along the leading eigenvectors of their covariance.

Entries become whole numbers, ``floor(64 c) + 1000000``. One pass counts vectors and sums each
dimension exactly, one sums the products of centred entries, both per task first; what reaches
the driver is of the size of the dimension, whatever the number of vectors. There
:mod:`spectrum` slices the spectrum. A third pass sums the products of whitened entries, which
tell how far their covariance is from the identity; a fourth gives the rows.

Defined results: a vector that is NULL, or holds a NULL, a non-finite entry or one of size
``2**55`` or more, is dropped, as are vectors that have not the most frequent length (ties: the
longer). Long vectors cost the square of their length in a task and on the driver. Equal rows
are whitened alike and all count. Directions without variance, so too a single vector or an
empty table, give no component and so no row. Equal eigenvalues share a space, of which some
orthonormal basis is taken. The carried columns are held as one struct until the end, so any
names are fine; one named like a result gives way to it. ``deviation`` is DECIMAL(38, 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridcast.functions.scale_out import settle
from gridcast.llm import spectrum
from gridcast.llm.common import quoted

COMPONENTS, SCALE, OFFSET = 32, 64.0, 1_000_000
LARGEST = 2.0 ** 55
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


@dataclass
class Whitening:
    """Fitted: ``n`` vectors with integer ``sums``, eigenvalues and eigenvectors (columns)."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, with the whole part of the mean taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 of each row, exact."""
        sums = np.array(self.sums, object)
        peak = self.n * float(np.abs(x).max(initial=0)) + max((abs(float(s)) for s in self.sums), default=0.0)
        spread = self.n * float(np.abs(self.centred(x)).max(initial=0)) + 1
        if peak < 2.0 ** 62 and spread * spread * max(len(self.sums), 1) < 2.0 ** 62:
            off = self.n * x - sums.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        off = x.astype(object) * self.n - sums
        return [sum(v * v for v in row) for row in off]


def whole_vectors(col: pa.Array, d: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, x)`` for each length (or for ``d``): which rows are kept, and their entries."""
    col = pa.array(col) if not isinstance(col, (pa.Array, pa.ChunkedArray)) else col
    lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(col).cast(pa.float64())
    entries, owner = flat.to_numpy(zero_copy_only=False), pc.list_parent_indices(col).to_numpy()
    good = lengths >= 0
    good[owner[~(np.abs(entries) < LARGEST) | pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False
    for length in np.unique(lengths[good]) if d is None else (d,):
        rows = np.flatnonzero(good & (lengths == length))
        wanted = np.zeros(len(lengths), bool)
        wanted[rows] = True
        x = entries[wanted[owner]].reshape(len(rows), int(length))
        yield rows, np.floor(SCALE * x).astype(np.int64) + OFFSET


def _counts(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """How many vectors there are of the most frequent length, and their sums."""
    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            for rows, x in whole_vectors(batch.column(0)):
                if len(rows):
                    n, sums = totals.get(x.shape[1], (0, 0))
                    part = x.sum(axis=0) if np.abs(x).max(initial=0) < 2 ** 62 / len(x) else x.astype(object).sum(axis=0)
                    totals[x.shape[1]] = [n + len(rows), sums + part.astype(object)]
        for d, (n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d]), pa.array([n]), pa.array([[Decimal(int(s)) for s in sums]], pa.list_(pa.decimal128(38, 0)))],
                ["d", "n", "sums"])

    parts = settle(vectors.select(quoted(column)).mapInArrow(run, "d bigint, n bigint, sums array<decimal(38,0)>"))
    lengths = parts.groupBy("d").agg(F.sum("n").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return 0, []
    sums = parts.filter(F.col("d") == top["d"]).select(F.posexplode("sums").alias("i", "s")) \
        .groupBy("i").agg(F.sum("s").alias("s")).collect()             # one row per dimension
    return top["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]


def _products(vectors: DataFrame, column: str, d: int, rows_of) -> np.ndarray:
    """Sum over vectors of the outer product of ``rows_of(x)`` with itself."""
    def run(batches):
        total = None
        for batch in batches:
            for rows, x in whole_vectors(batch.column(0), d):
                for z in (rows_of(x[i:i + 4096]) for i in range(0, len(x), 4096)):
                    total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                             ["i", "row"])

    parts = vectors.select(quoted(column)).mapInArrow(run, "i int, row array<double>")
    found = parts.select("i", F.posexplode("row").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    out = np.zeros((max((r["i"] for r in found), default=-1) + 1,) * 2)
    for r in found:                                                    # one row per pair of dimensions
        out[r["i"], r["j"]] = r["g"]
    return out


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    n, sums = _counts(vectors, column)
    d = len(sums)
    blank = Whitening(n, sums, np.empty(0), np.empty((d, 0)), 0.0)
    if not d:
        return blank
    covariance = _products(vectors, column, d, blank.centred) / n
    values, axes = spectrum.leading(covariance, components)
    return Whitening(n, sums, values, axes, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """Largest entry, in size, of the whitened vectors' covariance minus the identity."""
    if not len(model.values):
        return 0.0
    found = _products(vectors, column, len(model.sums), model.whitened) / model.n
    return float(np.abs(found - np.eye(len(found))).max())


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """One row per kept vector and component: ``keep``'s columns, ``component, n, deviation,
    whitened, explained, identity_error``."""
    names = [c for c in (vectors.columns if keep is None else keep) if c.lower() not in RESULTS]
    if not len(model.values):
        none = {"component": "int", "n": "bigint", "deviation": "decimal(38,0)"} | {c: "double" for c in RESULTS[3:]}
        return vectors.limit(0).select(*[F.col(quoted(c)) for c in names], *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    error = identity_error(vectors, model, column)
    read = vectors.select(F.struct(*[F.col(quoted(c)) for c in names], F.lit(0).alias("_gridcast")).alias("kept"),
                          F.col(quoted(column)).alias("x"))
    schema = T.StructType([read.schema["kept"], T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("z", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    d = len(model.sums)

    def run(batches):
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1), d):
                made = [pa.array([Decimal(v) for v in model.deviation(x)], pa.decimal128(38, 0)),
                        pa.array(list(model.whitened(x)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *made], schema=arrow)

    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = read.mapInArrow(run, schema).select("kept", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(*[F.col("kept").getField(c).alias(c) for c in names], (F.col("at") + 1).alias("component"),
                      F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                      F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
