import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.config import GRANULARITIES
from gridcast.functions import recurrent, tied
from gridcast.operators import latent, sequence, windows
from gridcast.plans import forecasts
from tests.test_sources_and_cleaning import LONG, long, values

CELLS = list("abcd")


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(0).random((96, 4))


@pytest.fixture(scope="module")
def df(spark, matrix):
    return long(spark, **{c: matrix[:, i].tolist() for i, c in enumerate(CELLS)}).repartition(3).cache()


def frame(spark, w, c):
    return spark.createDataFrame([(k, w[i].tolist(), float(c[i])) for i, k in enumerate(CELLS)],
                                 "cell_id STRING, w ARRAY<DOUBLE>, c DOUBLE")


def test_mask_is_repeatable_and_fair(df):
    once, again = (values(latent.corrupt_mask(df, 3), "a") for _ in range(2))
    assert once == again != values(latent.corrupt_mask(df, 4), "a")
    plain = values(df, "a")
    assert all(m in (0.0, v) for m, v in zip(once, plain)) and 20 < sum(m == 0 for m in once) < 76
    assert values(latent.corrupt_mask(df, 3, 0.0), "a") == plain


def plain_gradient(x, w, b, c):
    """Cost and gradient of the tied-weight layer, without a mask."""
    sig = lambda a: 1 / (1 + np.exp(-a))
    h = sig(x @ w + b)
    y = sig(h @ w.T + c)
    dy = 2 * (y - x) * y * (1 - y)
    dh = (dy @ w) * h * (1 - h)
    return ((y - x) ** 2).sum(), x.T @ dh + dy.T @ h, dh.sum(0), dy.sum(0)


def test_plain_gradient_by_differences(matrix):
    rng = np.random.default_rng(2)
    at = [rng.normal(size=(4, 2)), rng.normal(size=2), rng.normal(size=4)]
    for part, grad in zip(at, plain_gradient(matrix, *at)[1:]):
        for k in np.ndindex(part.shape):
            before, costs = part[k], []
            for step in (1e-6, -1e-6):
                part[k] = before + step
                costs.append(plain_gradient(matrix, *at)[0])
            part[k] = before
            assert math.isclose(grad[k], (costs[0] - costs[1]) / 2e-6, rel_tol=1e-4, abs_tol=1e-5)


def test_single_step_and_numpy_agree(spark, df, matrix):
    rng = np.random.default_rng(1)
    w, b, c = rng.normal(size=(4, 2)), rng.normal(size=2), rng.normal(size=4)
    weights = frame(spark, w, c)
    cost, gw, gb, gc = plain_gradient(matrix, w, b, c)
    z = latent.latent_encode(df, weights, b)
    y = latent.latent_decode(z, weights, df)
    assert math.isclose(latent.reconstruction_cost(df, y).first().cost, cost, rel_tol=1e-9)
    g = {(r.param, r.cell_id, r.unit): r.g for r in latent.latent_gradient(df, weights, b).collect()}
    assert math.isclose(g["cost", "", 0], cost, rel_tol=1e-9)
    for i, k in enumerate(CELLS):
        assert math.isclose(g["c", k, 0], gc[i], rel_tol=1e-8)
        for j in range(2):
            assert math.isclose(g["w", k, j], gw[i, j], rel_tol=1e-8, abs_tol=1e-9)
    for j in range(2):
        assert math.isclose(g["b", "", j], gb[j], rel_tol=1e-8)


def test_gradient_at_zero_weights_in_closed_form(spark, df, matrix):
    g = {(r.param, r.cell_id, r.unit): r.g for r in
         latent.latent_gradient(df, frame(spark, np.zeros((4, 2)), np.zeros(4)), [0.0, 0.0]).collect()}
    for i, k in enumerate(CELLS):
        s = (0.5 - matrix[:, i]).sum()
        assert math.isclose(g["w", k, 0], 0.25 * s, abs_tol=1e-9) and g["w", k, 0] == g["w", k, 1]
        assert math.isclose(g["c", k, 0], 0.5 * s, abs_tol=1e-9)
    assert g["b", "", 0] == g["b", "", 1] == 0.0


def plain_descent(x, w, lr, epochs, batch):
    """Mini-batch descent from given weights, batch after batch."""
    b, c, costs = np.zeros(w.shape[1]), np.zeros(len(w)), []
    for _ in range(epochs):
        costs.append(0.0)
        for at in range(0, len(x), batch):
            cost, gw, gb, gc = plain_gradient(x[at:at + batch], w, b, c)
            costs[-1] += cost
            w, b, c = w - lr * gw, b - lr * gb, c - lr * gc
    return w, b, c, costs


@pytest.mark.parametrize("parts,cells_a_task,tiles", [(1, 64, 1 << 20), (7, 1, 1 << 20), (3, 4, 1)])
def test_training_is_plain_descent(spark, df, matrix, monkeypatch, parts, cells_a_task, tiles):
    monkeypatch.setattr(latent, "TILES_A_JOB", tiles)             # all epochs in one job, or each in its own
    w0 = np.random.default_rng(5).normal(0.0, 0.5, (4, 2))
    start = spark.createDataFrame([(k, w0[i].tolist(), 0.0) for i, k in enumerate(CELLS)], "cell_id STRING, w ARRAY<DOUBLE>, c DOUBLE")
    model = latent.latent_fit(df.repartition(parts), (2,), 0.05, 2, 40, mask=F.lit(1), start=(start, [0.0, 0.0]), cells_a_task=cells_a_task)
    w, b, c, costs = plain_descent(matrix, w0, 0.05, 2, 40)
    np.testing.assert_allclose([v for _, v in model.costs], costs, rtol=1e-9)
    rows = model.weights.orderBy("cell_id").collect()
    np.testing.assert_allclose([r.w for r in rows], w, atol=1e-9)
    np.testing.assert_allclose([r.c for r in rows], c, atol=1e-9)
    np.testing.assert_allclose(model.bias, b, atol=1e-9)
    z = model.encode(df).orderBy("t").collect()
    np.testing.assert_allclose([(r.z1, r.z2) for r in z], 1 / (1 + np.exp(-(matrix @ w + b))), atol=1e-9)


def test_stack_gradient_by_differences():
    rng = np.random.default_rng(8)
    x, shown = rng.random((7, 5)), rng.random((7, 5))
    make = lambda p: tied.Stack(p[:20].reshape(5, 4), p[20:25], *tied.from_small(p[25:], [4, 2]))
    at = rng.normal(size=25 + 4 + 8 + 2 + 4)
    cost = lambda p: make(p).step(x, shown, 0.0, lambda part: part)
    net = make(at.copy())
    net.step(x, shown, 1.0, lambda part: part)
    moved = at - np.concatenate([net.w.ravel(), net.c, net.small()])
    for k in range(len(at)):
        step = np.eye(len(at))[k] * 1e-6
        assert math.isclose(moved[k], (cost(at + step) - cost(at - step)) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)


def test_random_masks_do_not_depend_on_the_split(df):
    one, four = (latent.latent_fit(df, (3, 2), 0.05, 2, 48, init="seeded", seed=4, cells_a_task=n) for n in (64, 1))
    for a, b in zip(one.weights.orderBy("cell_id").collect(), four.weights.orderBy("cell_id").collect()):
        np.testing.assert_allclose(a.w, b.w, atol=1e-9)
    np.testing.assert_allclose([c for _, c in one.costs], [c for _, c in four.costs], rtol=1e-9)
    np.testing.assert_allclose(one.deeper[0][0], four.deeper[0][0], atol=1e-9)


def test_mask_bits_are_fair_and_change_with_epoch():
    keys = np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 50)
    a, b = (tied.mask_bits(keys, np.arange(400), e) for e in (0, 1))
    assert set(np.unique(a)) == {0.0, 1.0} and abs(a.mean() - 0.5) < 0.02 and abs((a == b).mean() - 0.5) < 0.02


def test_zero_start_keeps_units_equal(df):
    model = latent.latent_fit(df, (2,), 0.05, 2, 16, 6)
    assert all(r.w[0] == r.w[1] for r in model.weights.collect())
    assert all(r.z1 == r.z2 for r in model.encode(df).collect())


def test_seeded_training_lowers_the_cost(df):
    model = latent.latent_fit(df, (2,), 0.02, 4, 96, init="seeded", prob=0.0)
    assert model.costs[-1][1] < model.costs[0][1] and len(model.costs) == 4


def test_a_slot_without_all_cells_is_refused(df):
    with pytest.raises(ValueError):
        latent.latent_fit(df.filter("NOT (cell_id = 'a' AND t = 3)"), epochs=1)


def test_deeper_stack(df):
    model = latent.latent_fit(df, (3, 2), 0.02, 4, 96, init="seeded", prob=0.0)
    assert model.encode(df).columns == ["t", "z1", "z2"]
    y = latent.latent_decode(latent.latent_encode(df, model.weights.select("cell_id", "w"), model.bias,
                                                  model.deeper), model.weights, df, model.decode_deeper)
    assert y.count() == 96 * 4 and latent.reconstruction_cost(df, y).first().cost < model.costs[0][1]


# --- sequence ----------------------------------------------------------------------------


def naive_cell(flat, x):
    """One window, one step at a time."""
    p = recurrent.Shape().split(flat)
    sig = lambda a: 1 / (1 + np.exp(-a))
    c = h = np.zeros(10)
    out = []
    for row in x:
        g = np.concatenate([row @ p["w_in"] + p["b_in"], h]) @ p["k"] + p["b"]
        i, j, f, o = np.split(g, 4)
        c = c * sig(f + 1.0) + sig(i) * np.tanh(j)
        h = sig(o) * np.tanh(c)
        out.append(float((h @ p["w_out"] + p["b_out"])[0]))
    return out


CFG = dataclasses.replace(GRANULARITIES[45], day=4, lanes=6, batches=3, epochs=3)


@pytest.fixture(scope="module")
def feats(spark):
    x = np.random.default_rng(3).random((60, 3))
    rows = [(t, *map(float, r)) for t, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "t BIGINT, y DOUBLE, z1 DOUBLE, z2 DOUBLE").repartition(4).cache()


def test_forecast_equals_a_plain_loop(feats):
    x, df = feats
    flat = recurrent.initial(recurrent.Shape(), "normal", 1.0, 0.1, 4)
    assert len(flat) == 891
    w = windows.supervised_windows(df, 4)
    got = {(r.window_id, r.step): r.yhat for r in sequence.sequence_forecast(w.repartition(5), flat).collect()}
    for i in range(60 - 8):
        np.testing.assert_allclose([got[i, s] for s in range(4)], naive_cell(flat, x[i:i + 4]), atol=1e-12)
    pred = sequence.sequence_forecast(w, flat)
    cost = sequence.sequence_cost(pred, w.select("window_id", "step", "target")).first().cost
    want = sum((got[i, s] - x[i + 4 + s, 0]) ** 2 for i in range(52) for s in range(4)) / 52
    assert math.isclose(cost, want, rel_tol=1e-9)


def test_gradient_by_differences():
    shape = recurrent.Shape()
    rng = np.random.default_rng(5)
    flat = recurrent.initial(shape, "uniform", 1.0, 0.1, 6)
    x, y = rng.random((3, 5, 3)), rng.random((3, 5, 1))
    c, h = rng.normal(size=(3, 10)), rng.normal(size=(3, 10))
    grad = shape.join(recurrent.gradient(shape.split(flat), x, y, c, h)[1])
    for k in range(0, 891, 23):
        step = np.eye(891)[k] * 1e-6
        up, down = (recurrent.gradient(shape.split(flat + s * step), x, y, c, h)[0] for s in (1, -1))
        assert math.isclose(grad[k], (up - down) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)


def plain_training(x, cfg, epochs, seed):
    shape = recurrent.Shape()
    flat = recurrent.initial(shape, *cfg.init, cfg.bias, seed)
    m, v, step, costs = np.zeros(891), np.zeros(891), 0, []
    for _ in range(epochs):
        c = h = np.zeros((cfg.lanes, 10))
        total = 0.0
        for k in range(cfg.batches):
            ids = range(k * cfg.lanes, (k + 1) * cfg.lanes)
            xb = np.array([x[i:i + cfg.day] for i in ids])
            yb = np.array([x[i + cfg.day:i + 2 * cfg.day, :1] for i in ids])
            cost, g, c, h = recurrent.gradient(shape.split(flat), xb, yb, c, h)
            step += 1
            recurrent.adam(flat, shape.join(g), m, v, step, cfg.lr)
            total += cost
        costs.append(total / cfg.batches)
    return flat, costs


@pytest.mark.parametrize("group", [1, 2, 6])
def test_training_is_sequential_whatever_the_groups(feats, group):
    x, df = feats
    model = sequence.sequence_fit(df, CFG, group=group, batches=3, seed=2)
    flat, costs = plain_training(x, CFG, 3, 2)
    np.testing.assert_allclose(model.weights, flat, atol=1e-9)
    np.testing.assert_allclose([c for _, c in model.costs], costs, rtol=1e-9)


def test_all_windows_are_used(feats):
    x, df = feats
    got = {(r.batch, r.grp): (r.n, len(r.rows)) for r in sequence.slabs(df, 4, 6, 2, 52).collect()}
    assert sum(n for n, _ in got.values()) == 52 and len(got) == 26
    assert set(got.values()) == {(2, 2 + 2 * 4 - 1)}
    assert sequence.slabs(df, 4, 6, 6, 51).filter("batch = 8").first().n == 3
    model = sequence.sequence_fit(df.repartition(9), CFG, epochs=3)
    assert model.costs[-1][1] < model.costs[0][1]


def test_both_forecasts_end_to_end(spark):
    rng = np.random.default_rng(9)
    t = np.arange(160)
    day = 0.5 + 0.4 * np.sin(2 * np.pi * t / 4)
    rows = [(c, int(i), float(day[i] + 0.05 * rng.random())) for c in CELLS for i in t if rng.random() < 0.9]
    listed = spark.createDataFrame([(c,) for c in CELLS] + [("nowhere",)], "cell_id STRING")
    traffic = spark.createDataFrame(rows, LONG)
    series = forecasts.load_series(traffic, 100, listed)
    assert {r.cell_id for r in series.select("cell_id").distinct().collect()} == set(CELLS)
    done = forecasts.arma_day_forecast(series, 120, (2, 0))
    actual = {(r.cell_id, r.t): r.v for r in series.collect()}
    errors = {}
    for r in done.forecast.collect():
        if (r.cell_id, r.t) in actual:                  # a cell may end before the longest one
            errors.setdefault(r.cell_id, []).append(actual[r.cell_id, r.t] - r.yhat)
    for r in done.scores.collect():
        e = np.array(errors.pop(r.cell_id))
        assert math.isclose(r.mse, (e ** 2).mean(), rel_tol=1e-9)
        assert math.isclose(r.mae, np.abs(e).mean(), rel_tol=1e-9)
    assert not errors
    assert done.forecast.count() == 4 * (series.agg(F.max("t")).first()[0] + 1 - 120)
    assert done.fitted.count() == 4 * 118
    best = forecasts.arma_day_forecast(series, 120, max_lag=2)
    assert best.fits.count() == 4
    cfg = dataclasses.replace(CFG, latent_batch=16, latent_batches=8, latent_epochs=3, epochs=4,
                              init=("normal", 1.0), evaluate=(100, 140, 2, 5))
    beside = forecasts.load_series(traffic, 100, listed, side_by_side=True)
    other = forecasts.compressed_day_forecast(beside, "a", cfg, mask_at_encode=True)
    row = other.scores.first()
    assert 0 < row.mse < 2 and other.actual_vs_forecast.count() == 4 * 4


def test_registered_trainings_use_the_configured_epochs(spark, monkeypatch):
    from gridcast.plans import registered
    seen = {}

    def stop(name):
        def fn(*a, **k):
            seen[name] = a, k
            raise StopIteration
        return fn

    for name in ("_traffic", "_features"):
        monkeypatch.setattr(registered, name, lambda *a: spark.range(1))
    monkeypatch.setattr(registered.latent, "latent_fit", stop("latent_fit"))
    monkeypatch.setattr(registered.sequence, "sequence_fit", stop("sequence_fit"))
    monkeypatch.setattr(registered.forecasts, "compressed_day_forecast", stop("compressed_day_forecast"))
    for name in ("latent_fit", "sequence_fit", "compressed_day_forecast"):
        with pytest.raises(StopIteration):
            getattr(registered, name)(spark, "")
    assert seen["latent_fit"][0][3] == registered.CFG.latent_epochs
    assert "epochs" not in seen["sequence_fit"][1] and len(seen["sequence_fit"][0]) == 2
    assert not {"epochs", "latent_epochs"} & set(seen["compressed_day_forecast"][1])
