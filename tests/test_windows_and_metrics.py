import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.config import GRANULARITIES
from gridcast.operators import metrics, windows
from tests.test_sources_and_cleaning import long


def features(spark, n):
    return spark.range(n).select(
        F.col("id").alias("t"), (F.col("id") + 1).cast("double").alias("y"),
        (F.col("id") * 2 + 1).cast("double").alias("z1"), (-F.col("id") - 1).cast("double").alias("z2"))


@pytest.mark.parametrize("pad", ["drop", "zeros"])
def test_windows_match_a_plain_loop(spark, pad):
    n, steps = 23, 4
    y = np.arange(n) + 1.0
    got = {}
    for r in windows.supervised_windows(features(spark, n), steps, pad).collect():
        got[r.window_id, r.step] = (r.y, r.z1, r.z2, r.target)
    want = {}
    for i in range(n - steps):
        for s in range(steps):
            if i < n - 2 * steps:
                want[i, s] = (y[i + s], 2 * (i + s) + 1.0, -y[i + s], y[i + s + steps])
            elif pad == "zeros":
                want[i, s] = (0.0, 0.0, 0.0, 0.0)
    assert got == want


def test_windows_at_equals_filtering(spark):
    f = features(spark, 60)
    pick = windows.strided(F.col("window_id"), 3, 40, 2, 3)
    some = windows.windows_at(f, 5, pick)
    every = windows.supervised_windows(f, 5).filter(pick)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))
    assert sorted({r.window_id for r in some.collect()}) == list(range(3, 40, 2))[::3]


def test_padded_windows_at_equal_filtering(spark):
    f = features(spark, 23)
    pick = F.col("window_id").isin(3, 13, 14, 18, 20, 40)
    order = ["window_id", "step"]
    want = windows.supervised_windows(f, 4, "zeros").filter(pick).orderBy(*order).collect()
    assert windows.windows_at(f, 4, pick, pad="zeros").orderBy(*order).collect() == want and want[-1].target == 0.0



@pytest.mark.parametrize("minutes,allocated,filled,scored,zero", [
    (5, 8306, 8018, 8, 0), (15, 2765, 2669, 9, 1), (30, 1379, 1331, 8, 1), (45, 914, 882, 7, 0)])
def test_window_counts_of_each_granularity(spark, minutes, allocated, filled, scored, zero):
    cfg = GRANULARITIES[minutes]
    assert (cfg.rows - cfg.day, cfg.rows - 2 * cfg.day) == (allocated, filled)
    ids = spark.range(allocated).select(F.col("id").alias("window_id"))
    got = [r.window_id for r in windows.eval_windows(ids, *cfg.evaluate).collect()]
    assert len(got) == scored and sum(w >= filled for w in got) == zero
    assert cfg.rows - cfg.latent_batch * cfg.latent_batches == {5: 94, 15: 45, 30: 19, 45: 6}[minutes]


def test_batches_and_chains(spark):
    w = windows.window_batches(windows.supervised_windows(features(spark, 40), 3), 5, 4)
    assert {r.window_id for r in w.collect()} == set(range(20))
    chain = {r.window_id: r.prev_window_id for r in windows.lane_chains(w, 5).collect()}
    assert chain == {i: (i - 5 if i >= 5 else None) for i in range(20)}
    df = windows.batch_slices(long(spark, a=[float(i) for i in range(11)]), 3, 3)
    assert sorted((r.t, r.batch_id) for r in df.collect()) == [(i, i // 3) for i in range(9)]


def test_split(spark):
    train, test = windows.train_test_split(long(spark, a=[0.0] * 946), GRANULARITIES[45].train)
    assert (train.count(), test.count()) == (700, 246)


def test_scores(spark):
    actual = long(spark, a=[1.0, 2.0], b=[0.0, 4.0]).withColumnRenamed("v", "y")
    pred = long(spark, a=[2.0, 2.0], b=[0.0, 1.0]).withColumnRenamed("v", "yhat")
    on = ["cell_id", "t"]
    assert metrics.mse(actual, pred, on).first().mse == 2.5
    assert metrics.mae(actual, pred, on).first().mae == 1.0
    assert {r.cell_id: (r.mse, r.mae) for r in metrics.scores(actual, pred, on, ["cell_id"]).collect()} \
        == {"a": (0.5, 0.5), "b": (4.5, 1.5)}
    assert [(r.cell_id, r.t) for r in metrics.actual_vs_forecast(actual, pred, on).collect()] == \
        [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
