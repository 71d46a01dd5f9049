import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.functions import scale_out
from gridcast.operators import clean, scale
from gridcast.sources import tables

LONG = "cell_id STRING, t BIGINT, v DOUBLE"


def long(spark, **series):
    rows = [(c, t, v) for c, vs in series.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, LONG)


def values(df, cell):
    return [r.v for r in df.filter(F.col("cell_id") == cell).orderBy("t").collect()]


def test_cell_key_and_file_order(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("118.779654,32.052781\n118.7,32.5\n118.7796512,32.0\n")
    rows = tables.scan_cells(spark, str(tmp_path / "cells.csv")).orderBy("ord").collect()
    assert [r.cell_id for r in rows] == ["32.05278_118.77965", "32.5_118.7", "32.0_118.77965"]
    assert [r.ord for r in rows] == [0, 1, 2]


def test_ordinals_follow_files_and_splits(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text(
            "a,b\n" + "".join(f"{part * 2000 + i},\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        wide = tables.scan_traffic_wide(spark, str(tmp_path))
        rows = wide.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 6000
    assert all(r.t == r.a and r.b is None for r in rows)


def test_nan_text_is_missing(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a,b\n1.5,NaN\n,2\n")
    rows = tables.scan_traffic_wide(spark, str(tmp_path / "w.csv"), ["b"]).orderBy("t").collect()
    assert [r.asDict() for r in rows] == [{"t": 0, "b": None}, {"t": 1, "b": 2.0}]


def test_reindex(spark):
    df = long(spark, a=[1.0, 2.0], b=[3.0, 4.0])
    cells = spark.createDataFrame([("a",), ("zz",), ("a",)], "cell_id STRING")
    out = tables.reindex_cells(df, cells)
    assert values(out, "a") == [1.0, 2.0]
    assert values(out, "zz") == [None, None]
    assert out.count() == 4
    wide = tables.reindex_wide(tables.long_to_wide(df, ["a", "b"]), ["a", "zz"])
    assert wide.columns == ["t", "a", "zz"]
    assert [r.zz for r in wide.collect()] == [None, None]


def test_wide_and_long_are_inverse(spark):
    df = long(spark, a=[1.0, None, 3.0], b=[4.0, 5.0, None])
    back = tables.wide_to_long(tables.long_to_wide(df, ["a", "b"]))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("minutes,periods,last", [
    (5, 8594, "2014-06-30 20:05"), (15, 2861, "2014-06-30 19:00"),
    (30, 1427, "2014-06-30 17:00"), (45, 946, "2014-06-30 12:45")])
def test_time_grid(spark, minutes, periods, last):
    grid = tables.time_grid(spark, "2014-06-01 00:00:00", minutes, periods)
    row = grid.agg(F.count("*").alias("n"), F.max("ts").alias("ts")).first()
    assert (row.n, row.ts.strftime("%Y-%m-%d %H:%M")) == (periods, last)


def test_select_target_needs_the_cell(spark):
    df = long(spark, a=[1.0])
    assert tables.select_target(df, "a").count() == 1
    with pytest.raises(KeyError):
        tables.select_target(df, "b")


def test_write_series(spark, tmp_path):
    df = tables.attach_time(long(spark, a=[1.0, 2.5]), "2014-06-01 00:00:00", 15).select("ts", "v")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        tables.write_series(df, path, fmt)
        back = spark.read.csv(path, header=True, schema="ts TIMESTAMP_NTZ, v DOUBLE") \
            if fmt == "csv" else spark.read.parquet(path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_drop_sparse_boundary(spark):
    df = long(spark, a=[1.0, None, 3.0], b=[1.0, 2.0, 3.0])
    assert {r.cell_id for r in clean.drop_sparse_cells(df, 3).collect()} == {"b"}
    assert {r.cell_id for r in clean.drop_sparse_cells(df, 2).collect()} == {"a", "b"}


def test_interpolation_golden(spark):
    df = long(spark, a=[None, 1.0, None, None, 4.0, None], none=[None] * 6)
    out = clean.interpolate_linear(df)
    assert values(out, "a") == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert values(out, "none") == [None] * 6


@pytest.mark.parametrize("width,fan", [(2, 4096), (3, 3), (16, 16), (4096, 4096)])
def test_interpolation_across_blocks(spark, monkeypatch, width, fan):
    """Blocks of any width, gaps over several blocks included, give pandas' result."""
    monkeypatch.setattr(clean, "FAN", fan)
    assert clean.levels_for(120, width) == {2: 1, 3: 2, 16: 1, 4096: 0}[width]
    rng = np.random.default_rng(width)
    frame = pd.DataFrame(rng.random((120, 3)), columns=list("abc"))
    frame = frame.mask(rng.random(frame.shape) < 0.6)
    frame.loc[20:80, "b"] = np.nan
    frame.iloc[-1, 0] = 1.0
    rows = [(c, int(t), float(v)) for c in frame for t, v in frame[c].items() if v == v]
    out = clean.interpolate_linear(spark.createDataFrame(rows, LONG), width=width).toPandas()
    got = out.pivot(index="t", columns="cell_id", values="v")[list("abc")]
    np.testing.assert_allclose(got.to_numpy(), frame.interpolate().to_numpy(), atol=1e-12)


def test_prepare_trims_each_cell(spark):
    df = long(spark, a=[None, None, 2.0, None, 6.0], b=[0.0, 1.0, None, 3.0, 4.0], c=[None] * 5)
    out = clean.prepare(df)
    assert values(out, "a") == [0.0, 0.5, 1.0]
    assert values(out, "b") == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert values(out, "c") == []
    plain = clean.trim_leading(clean.interpolate_linear(df.filter("cell_id <> 'c'")))
    assert values(plain, "a") == [2.0, 4.0, 6.0] and values(plain, "b") == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_a_late_cell_changes_no_other(spark):
    rng = np.random.default_rng(4)
    cells = {c: [None] * i + rng.random(60 - i).tolist() for i, c in enumerate("abc")}
    late = cells | {"z": [None] * 58 + [1.0, 2.0]}
    few, more = (clean.prepare(long(spark, **x)).toPandas().sort_values(["cell_id", "t"]) for x in (cells, late))
    assert few.to_numpy().tolist() == more[more["cell_id"] != "z"].to_numpy().tolist()
    frame = long(spark, **late)
    start = clean.usual_start(frame, 0.75)
    assert start == 2 and [tuple(r) for r in clean.late_cells(frame, start).collect()] == [("z", 58)]
    common = clean.prepare(frame, start=start).groupBy("cell_id").count().collect()
    assert sorted(tuple(r) for r in common) == [("a", 58), ("b", 58), ("c", 58)]


def test_periods_cut_rows_and_not_slopes(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 5, 5.0), ("a", 8, 8.0), ("b", 4, 1.0)], LONG)
    out = clean.interpolate_linear(df, periods=3)
    assert values(out, "a") == [0.0, 1.0, 2.0] and values(out, "b") == [None] * 3


@pytest.mark.parametrize("size", [2, 3, 4, 4096])
def test_first_difference_over_gaps(spark, size):
    df = spark.createDataFrame([("a", t, float(t * t)) for t in (0, 1, 2, 4, 13)] + [("b", 7, 1.0)], LONG)
    assert values(scale.first_difference(df, size), "a") == [None, 1.0, 3.0, 12.0, 153.0]
    assert values(scale.first_difference(df, size), "b") == [None]


def test_reading_moves_no_rows(spark, tmp_path):
    spark.createDataFrame([(float(i), 1.0) for i in range(50)], "a double, b double").repartition(4).write.csv(f"{tmp_path}/x", header=True)
    wide = tables.scan_traffic_wide(spark, f"{tmp_path}/x")
    assert sorted(r["t"] for r in wide.collect()) == list(range(50))
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rightHint=(strategy=broadcast)" in plan


def test_reindex_drops_unlisted_rows_first(spark):
    df = long(spark, a=[1.0, 2.0], b=[3.0, 4.0])
    out = tables.reindex_cells(df, spark.createDataFrame([("a",), ("q",), ("a",)], "cell_id string"))
    assert values(out, "a") == [1.0, 2.0] and values(out, "q") == [None, None] and values(out, "b") == []
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_minmax(spark):
    df = scale.minmax_scale(long(spark, a=[5.0, 5.0, None], b=[1.0, 3.0, 2.0]))
    assert values(df, "a") == [0.0, 0.0, None]
    assert values(df, "b") == [0.0, 1.0, 0.5]


def test_tanh_scales(spark):
    x = np.array([1.0, 4.0, 2.0, 9.0])
    df = long(spark, a=x.tolist(), b=(2 * x).tolist())
    score = lambda v, all_: 0.5 * (np.tanh(0.01 * (v - all_.mean()) / all_.std()) + 1)
    np.testing.assert_allclose(values(scale.tanh_scale_columns(df), "a"), score(x, x))
    both = np.concatenate([x, 2 * x])
    np.testing.assert_allclose(values(scale.tanh_scale_global(df), "b"), score(2 * x, both))
    assert values(scale.tanh_scale_columns(long(spark, a=[1.0, 1.0])), "a") == [None, None]


def test_first_difference_across_blocks(spark):
    x = np.arange(50.0) ** 2
    for size in (1, 7, 4096):
        got = values(scale.first_difference(long(spark, a=x.tolist()), size), "a")
        assert got[0] is None and got[1:] == np.diff(x).tolist()


def test_lookup_join_past_the_broadcast_bound(spark):
    df = long(spark, hot=[float(i) for i in range(500)], a=[1.0])
    side = spark.createDataFrame([("hot", 2.0), ("a", 3.0), ("b", 4.0)], "cell_id STRING, k DOUBLE")
    small = scale_out.lookup_join(df, side, "cell_id")
    large = scale_out.lookup_join(df, side, "cell_id", max_rows=1)
    assert sorted(map(tuple, large.select(*small.columns).collect())) == \
        sorted(map(tuple, small.collect()))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    kept = scale_out.lookup_join(df, side.filter("cell_id = 'a'").select("cell_id"), "cell_id",
                                 "left_semi", max_rows=0)
    assert kept.columns == ["cell_id", "t", "v"] and kept.count() == 1


def test_filling_scans_once(spark):
    """Both uses of the known points share one shuffle."""
    path = scale_out.scratch_path(spark, "points")
    long(spark, a=[1.0, None, 3.0]).write.parquet(path)
    df = clean.with_next_known(spark.read.parquet(path), levels=2)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Initial Plan")]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_hot_key_past_the_bound_is_salted(spark):
    rows = [("hot", i, float(i)) for i in range(400)] + [(f"c{i}", 0, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, LONG)
    side = spark.createDataFrame([("hot", 1.0)] + [(f"c{i}", 2.0) for i in range(300)],
                                 "cell_id STRING, k DOUBLE")
    out = scale_out.lookup_join(df, side, "cell_id", max_rows=10)
    assert out.columns == ["cell_id", "t", "v", "k"]
    assert out.count() == 700 and out.filter("k = 1").count() == 400
