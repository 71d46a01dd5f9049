"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cell_key(lat: Column, lon: Column) -> Column:
    """``lat_lon``, both rounded to 5 places, shortest decimal text, latitude first."""
    def text(c: Column) -> Column:
        return F.regexp_replace(F.round(c, 5).cast("decimal(9,5)").cast("string"),
                                r"(\.\d+?)0+$", "$1")
    return F.concat_ws("_", text(lat), text(lon))


def known(c: Column) -> Column:
    """NULL in place of NaN."""
    return F.when(~F.isnan(c), c)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tanh_score(v: Column, mean: Column, std: Column) -> Column:
    return F.lit(0.5) * (F.tanh(F.try_divide(F.lit(0.01) * (v - mean), std)) + F.lit(1.0))


def unit_range(v: Column, low: Column, high: Column) -> Column:
    """(v-low)/(high-low); 0 where the range is empty; NULL stays NULL."""
    return F.when(v.isNull(), F.lit(None).cast("double")) \
        .when(high == low, F.lit(0.0)).otherwise((v - low) / (high - low))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from plain sums; NULL where a side does not vary."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    # Rounding leaves a constant side with about 1e-16 of its sum of squares.
    varies = (n > 1) & (vx > F.lit(1e-13) * sxx) & (vy > F.lit(1e-13) * syy)
    return F.when(varies, (sxy - sx * sy / n) / F.sqrt(vx * vy))
