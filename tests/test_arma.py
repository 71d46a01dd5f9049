import math
from collections import namedtuple

import numpy as np
import pandas as pd
import pytest

from gridcast.functions import solvers
from gridcast.operators import arma
from gridcast.plans import forecasts
from tests.test_sources_and_cleaning import long


def simulate(n, phi, theta, mu, seed):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 100), np.zeros(n + 100)
    for t in range(3, n + 100):
        y[t] = e[t] + sum(f * y[t - i] for i, f in enumerate(phi, 1)) \
            + sum(h * e[t - j] for j, h in enumerate(theta, 1))
    return y[100:] + mu


def slow_residuals(y, mu, phi, theta):
    e = np.zeros(len(y))
    for t in range(len(phi), len(y)):
        e[t] = y[t] - mu - sum(f * (y[t - i] - mu) for i, f in enumerate(phi, 1)) \
            - sum(h * e[t - j] for j, h in enumerate(theta, 1) if t >= j)
    return e


MODELS = [(0, 0, 2.9, [], []), (0, 2, 3.0, [], [0.5, 0.2]), (2, 1, 3.1, [0.5, -0.2], [0.4]),
          (3, 0, 3.0, [0.3, 0.2, 0.1], []), (1, 3, 3.0, [0.6], [0.2, -0.3, 0.1])]


@pytest.fixture(scope="module")
def series(spark):
    data = {"a": simulate(301, [0.6, -0.2], [0.4], 3.0, 1), "b": simulate(301, [0.8], [0.3], -1.0, 2)}
    return data, long(spark, **{k: v.tolist() for k, v in data.items()}).repartition(5)


@pytest.fixture(scope="module")
def params(spark):
    return spark.createDataFrame([(c, *m) for c in "ab" for m in MODELS], arma.PARAMS)


@pytest.mark.parametrize("size,fan_in", [(7, 3), (43, 2), (301, 4), (1024, 1024)])
def test_blocked_recursion_is_exact(series, params, size, fan_in):
    data, df = series
    css = {(r.cell_id, r.p, r.q): r for r in arma.arma_css(df, params, size, fan_in).collect()}
    fitted = {}
    for r in arma.arma_predict_in_sample(df, params, size, fan_in).collect():
        fitted.setdefault((r.cell_id, r.p, r.q), {})[r.t] = r.yhat
    for c, y in data.items():
        for p, q, mu, phi, theta in MODELS:
            e = slow_residuals(y, mu, phi, theta)
            row = css[c, p, q]
            assert row.n == len(y) - p
            assert math.isclose(row.sse, float((e[p:] ** 2).sum()), rel_tol=1e-9)
            got = fitted[c, p, q]
            assert sorted(got) == list(range(p, len(y)))
            np.testing.assert_allclose([got[t] for t in range(p, len(y))], (y - e)[p:], atol=1e-9)


@pytest.mark.parametrize("size,chunk", [(7, 4), (50, 1000)])
def test_forecast_matches_the_recursion(series, params, size, chunk):
    data, df = series
    got = {}
    for r in arma.arma_forecast(df, params, 25, size, 3, chunk).collect():
        got.setdefault((r.cell_id, r.p, r.q), {})[r.t] = r.yhat
    for c, y in data.items():
        for p, q, mu, phi, theta in MODELS:
            ys, es = list(y), list(slow_residuals(y, mu, phi, theta))
            for _ in range(25):
                ys.append(mu + sum(f * (ys[-i] - mu) for i, f in enumerate(phi, 1))
                          + sum(h * es[-j] for j, h in enumerate(theta, 1)))
                es.append(0.0)
            path = got[c, p, q]
            assert sorted(path) == list(range(301, 326))
            np.testing.assert_allclose([path[t] for t in sorted(path)], ys[301:], atol=1e-9)


def test_ar_fit_is_least_squares(series):
    data, df = series
    for p in (0, 1, 3):
        for r in arma.ar_fit(df, p, 40).collect():
            y = data[r.cell_id]
            x = np.column_stack([np.ones(len(y) - p), *[y[p - i:len(y) - i] for i in range(1, p + 1)]])
            b, *_ = np.linalg.lstsq(x, y[p:], rcond=None)
            np.testing.assert_allclose(r.phi, b[1:], atol=1e-8)
            assert math.isclose(r.mu, b[0] / (1 - b[1:].sum()), rel_tol=1e-8)
            sse = float(((y[p:] - x @ b) ** 2).sum())
            n = len(y) - p
            bic = n * math.log(2 * math.pi * sse / n) + n + math.log(n) * (p + 2)
            assert math.isclose(r.bic, bic, rel_tol=1e-9)


def test_fit_recovers_parameters(spark):
    y = simulate(4000, [0.6, -0.2], [0.4], 3.0, 5)
    r = arma.arma_fit(long(spark, a=y.tolist()), [(2, 1)]).first()
    assert r.converged and abs(r.mu - 3.0) < 0.1
    np.testing.assert_allclose([*r.phi, *r.theta], [0.6, -0.2, 0.4], atol=0.08)
    # No nearby parameters do better.
    beta = np.array([r.mu, *r.phi, *r.theta])
    for k in range(4):
        for step in (-1e-3, 1e-3):
            other = beta.copy()
            other[k] += step
            e = slow_residuals(y, other[0], other[1:3], other[3:])
            assert float((e[2:] ** 2).sum()) >= r.sse


def test_long_series_are_refined_over_blocks(spark):
    """Past the in-task bound the result is still the fit to the whole series."""
    data = {"long": simulate(400, [0.6], [0.4], 1.0, 6), "short": simulate(90, [0.5], [0.3], 1.0, 7)}
    df = long(spark, **{k: v.tolist() for k, v in data.items()})
    whole = {r.cell_id: r for r in arma.arma_fit(df, [(1, 1)]).collect()}
    split = {r.cell_id: r for r in arma.arma_fit(df, [(1, 1)], in_task=100, size=64, fan_in=3).collect()}
    assert sorted(split) == ["long", "short"]
    for c in data:
        assert split[c].converged and split[c].n == whole[c].n
        assert math.isclose(split[c].sse, whole[c].sse, rel_tol=1e-7)
        np.testing.assert_allclose([*split[c].phi, *split[c].theta],
                                   [*whole[c].phi, *whole[c].theta], atol=1e-3)


@pytest.mark.parametrize("order", [(3, 0), (1, 1)])
def test_blocked_fit_equals_the_fit_in_a_task(spark, order):
    """Late first slots, a constant start and a missing value change nothing between the two."""
    flat = simulate(300, [0.6, -0.2], [0.4], 2.0, 9)
    flat[:120] = 2.0
    data = {"a": (0, simulate(330, [0.6, -0.2], [0.4], 3.0, 1)), "late": (500, simulate(250, [0.5], [0.3], 1.0, 2)), "flat": (0, flat)}
    rows = [(c, t0 + t, float(v)) for c, (t0, y) in data.items() for t, v in enumerate(y)]
    rows += [("gap", t, None if t == 60 else float(t % 7)) for t in range(150)]
    df = spark.createDataFrame(rows, "cell_id string, t bigint, v double")
    whole = {r.cell_id: r for r in arma.arma_fit(df, [order]).collect()}
    split = {r.cell_id: r for r in arma.arma_fit(df, [order], in_task=100, size=64, fan_in=3).collect()}
    assert whole.keys() == split.keys() == {*data, "gap"}
    for c in data:
        assert split[c].converged and whole[c].converged and split[c].n == whole[c].n == len(data[c][1]) - order[0]
        assert math.isclose(split[c].sse, whole[c].sse, rel_tol=1e-8)
        np.testing.assert_allclose([split[c].mu, *split[c].phi, *split[c].theta], [whole[c].mu, *whole[c].phi, *whole[c].theta], atol=1e-3)
    assert split["gap"].converged is False and split["gap"].bic is None


@pytest.mark.parametrize("order,seed", [((2, 2), 3), ((3, 1), 4), ((1, 2), 8)])
def test_rounds_take_the_steps_of_the_fit_in_a_task(monkeypatch, order, seed):
    """Several dampings a round, the first that improves wins: the same steps, in fewer rounds than trials."""
    p, q = order
    y = simulate(260, [0.9, -0.3], [0.6], 3.0, seed)
    y[::17] += 6.0
    tried = []
    residuals = solvers.css_residuals
    monkeypatch.setattr(solvers, "css_residuals", lambda *a: tried.append(a[1]) or residuals(*a))
    beta, sse, ok = solvers.css_fit(y, p, q)
    evaluations = len(tried)

    def sums(trials):
        for k, b in enumerate(trials):
            e = residuals(y, np.asarray(b, float), p, q)
            z = np.column_stack([e, solvers.css_jacobian(y, e, np.asarray(b, float), p, q)])[p:]
            yield from ({"k": k, "pos": i, "z": v, "count": len(z)} for i, v in enumerate((z.T @ z).ravel()))

    names = "cell_id p q trials lams best gram sse n lam steps done ok"
    Row = namedtuple("Row", names + " tried")
    row, rounds = ("a", p, q, [solvers.css_start(y, p, q)], [], None, None, None, None, 1e-3, 0, False, False), 0
    while not row[11]:
        (row,) = arma._advance(Row(*row, list(sums(row[3]))), 100)
        rounds += 1
    got = dict(zip(names.split(), row))
    assert got["ok"] == ok and rounds <= evaluations
    assert math.isclose(got["sse"], sse, rel_tol=1e-9)
    np.testing.assert_allclose(got["best"], beta, rtol=1e-5)


def test_damping_is_tried_ahead():
    """After a round without gain the next dampings come together; at their end there are none."""
    gram = np.array([[4.0, 1.0], [1.0, 2.0]])
    some = arma._proposed(np.array([0.5]), gram, 1e-2, 0, arma.TRIALS)
    assert [round(math.log10(lam)) for _, lam in some] == list(range(-2, -2 + arma.TRIALS))
    for trial, lam in some:
        assert math.isclose(trial[0], 0.5 - 1.0 / (2.0 + lam * 2.0), rel_tol=1e-9)
    assert len(arma._proposed(np.array([0.5]), gram, 1e10, 0, arma.TRIALS)) == 2
    assert arma._proposed(np.array([0.5]), gram, 1e12, 0, arma.TRIALS) == []


def test_order_search(series):
    data, df = series
    fits = {(r.cell_id, r.p, r.q): r for r in
            arma.arma_fit(df, [(p, q) for p in range(3) for q in range(2)]).collect()}
    for r in arma.arma_order_search(df, 3, 2).collect():
        mine = {k[1:]: v.bic for k, v in fits.items() if k[0] == r.cell_id and v.converged}
        assert (r.p, r.q) == min(mine, key=lambda k: (mine[k], k))
        assert math.isclose(r.bic, mine[r.p, r.q], rel_tol=1e-9)


def test_filter_is_the_recursion():
    rng = np.random.default_rng(0)
    for q in (0, 1, 4):
        theta, u = rng.normal(size=q) * 0.3, rng.normal(size=(150, 2))
        state = rng.normal(size=(q, 2))
        past, want = [state[j] for j in range(q)], []
        for row in u:
            e = row - sum((theta[j] * past[j] for j in range(q)), np.zeros(2))
            want.append(e)
            past = [e, *past][:q]
        for chunk in (1, 5, 64, None):
            np.testing.assert_allclose(solvers.ma_filter(u, theta, state, chunk), want, atol=1e-10)


def test_jacobian_by_differences():
    y = simulate(80, [0.5], [0.3], 1.0, 8)
    beta = np.array([1.1, 0.4, -0.1, 0.3, 0.1])
    e = solvers.css_residuals(y, beta, 2, 2)
    j = solvers.css_jacobian(y, e, beta, 2, 2)
    for k in range(5):
        up, down = beta.copy(), beta.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        diff = (solvers.css_residuals(y, up, 2, 2) - solvers.css_residuals(y, down, 2, 2)) / 2e-6
        np.testing.assert_allclose(j[:, k], diff, atol=1e-6)


def test_forecast_of_ragged_series(spark):
    """Each series is forecast from its own end; one too short or without a model gives NULLs."""
    rng = np.random.default_rng(6)
    ends = {"a": 500, "b": 499, "c": 300, "d": 1, "e": 40}
    rows = [(c, t, float(v)) for c, n in ends.items() for t, v in enumerate(rng.random(n))]
    df = spark.createDataFrame(rows, "cell_id string, t bigint, v double")
    models = [(c, 2, 0, 0.5, [0.5, 0.25], []) if c != "e" else (c, 2, 0, None, None, None) for c in ends]
    params = spark.createDataFrame(models, arma.PARAMS)
    got = arma.arma_forecast(df, params, 3, size=64).toPandas()
    for c, n in ends.items():
        part = got[got["cell_id"] == c].sort_values("t")
        assert part["t"].tolist() == [n, n + 1, n + 2]
        if c in "de":
            assert part["yhat"].isna().all()
            continue
        last = [v for k, _, v in rows if k == c][-2:]
        for y in part["yhat"]:
            want = 0.5 + 0.5 * (last[-1] - 0.5) + 0.25 * (last[-2] - 0.5)
            assert abs(y - want) < 1e-9
            last.append(want)


def test_unfittable_cells_are_rows(spark):
    rng = np.random.default_rng(8)
    rows = [("long", t, float(v)) for t, v in enumerate(rng.random(80))] + [("short", t, float(t)) for t in range(4)]
    df = spark.createDataFrame(rows, "cell_id string, t bigint, v double")
    fits = {r["cell_id"]: r for r in arma.arma_fit(df, [(1, 1)]).collect()}
    assert fits["short"]["mu"] is None and fits["short"]["converged"] is False and fits["long"]["mu"] is not None
    best = {r["cell_id"]: r for r in arma.arma_order_search(df, 2, 1).collect()}
    assert best["short"]["p"] is None and best["long"]["p"] is not None
    ahead = arma.arma_forecast(df, arma.arma_fit(df, [(1, 1)]).select("cell_id", "p", "q", "mu", "phi", "theta"), 2)
    assert ahead.filter("cell_id = 'short' AND yhat IS NULL").count() == 2 and ahead.filter("yhat IS NOT NULL").count() == 2


def test_scores_count_what_was_not_forecast(spark):
    from gridcast.operators import metrics
    actual = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "cell_id string, t bigint, y double")
    pred = spark.createDataFrame([("a", 0, 0.0)], "cell_id string, t bigint, yhat double")
    got = {r["cell_id"]: (r["mse"], r["n"], r["n_missing"]) for r in metrics.scores(actual, pred, ["cell_id", "t"], ["cell_id"]).collect()}
    assert got == {"a": (1.0, 1, 1), "b": (None, 0, 1)}


def test_no_small_order_search_by_default():
    from gridcast.plans import forecasts
    with pytest.raises(ValueError):
        forecasts.arma_day_forecast(None, 10)


def test_jobs_are_even_and_complete():
    orders = [(p, q) for p in range(13) for q in range(13)]
    jobs = arma._even_jobs(orders, 7)
    assert sorted(o for job in jobs for o in job) == orders and len(jobs) == 7
    loads = [sum((1 + p + 2 * q) * (2 + p + q) for p, q in job) for job in jobs]
    assert max(loads) < 1.05 * min(loads)
    assert arma._even_jobs([(1, 0)], 5) == [[(1, 0)]] and arma._even_jobs([], 3) == [[]]


def test_large_search_agrees_with_single_fits(spark):
    """Many orders dealt over tasks give what each order gives alone."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 160))
    for t in range(2, 160):
        x[:, t] += 0.6 * x[:, t - 1] - 0.3 * x[:, t - 2]
    df = long(spark, a=x[0].tolist(), b=x[1].tolist())
    orders = [(p, q) for p in range(4) for q in range(3)]
    got = {(r.cell_id, r.p, r.q): r.sse for r in arma.arma_fit(df, orders).collect()}
    assert len(got) == 24
    for i, cell in enumerate("ab"):
        for p, q in orders:
            assert math.isclose(got[cell, p, q], solvers.css_fit(x[i], p, q)[1], rel_tol=1e-12)


def test_forecast_by_time_labels(spark):
    x = np.random.default_rng(3).normal(size=60).cumsum()
    df = long(spark, a=x.tolist(), b=x[:50].tolist())
    params = arma.arma_fit(df, [(1, 0)]).select("cell_id", "p", "q", "mu", "phi", "theta")
    got = forecasts.arma_forecast_between(df, params, 45, "2014-06-02 21:00:00", "2014-06-02 22:30:00").collect()
    assert forecasts.slot_of("2014-06-02 21:00:00", 45) == 60
    want = {(r.cell_id, r.t): r.yhat for r in arma.arma_forecast(df, params, 13).collect()}
    assert {(r.cell_id, r.t): r.yhat for r in got} == {(c, t): want[c, t] for c in "ab" for t in (60, 61, 62)}
    assert {str(r.ts) for r in got if r.t == 61} == {"2014-06-02 21:45:00"}
    with pytest.raises(ValueError):
        forecasts.slot_of("2014-06-02 21:10:00", 45)


def many_series(lengths, seed=7):
    rng = np.random.default_rng(seed)
    out = []
    for n in lengths:
        e = rng.normal(size=n + 1)
        y = e[1:] + 0.4 * e[:-1]
        for t in range(1, n):
            y[t] += 0.5 * y[t - 1]
        out.append(y + 3)
    return out


@pytest.mark.parametrize("p,q", [(0, 0), (1, 0), (0, 1), (1, 1), (2, 1), (1, 2)])
def test_fits_together_equal_fits_alone(p, q):
    ys = [*many_series([60, 75, 75, 90, 120]), np.full(64, 2.0)]
    starts = np.array([solvers.css_start(y, p, q) for y in ys])
    with np.errstate(all="ignore"):
        together = solvers.css_fit_many(ys, starts, p, q)
        for y, got in zip(ys, together):
            beta, sse, ok = solvers.css_fit(y, p, q)
            np.testing.assert_allclose(got[0], beta, atol=1e-6)
            assert got[1] == pytest.approx(sse, rel=1e-9, abs=1e-20) and got[2] == ok


def test_many_series_are_fitted_together(monkeypatch):
    """One fit after the other took 54 ms a series for six orders."""
    alone = solvers.css_fit
    monkeypatch.setattr(solvers, "css_fit", lambda *a, **k: pytest.fail("fitted alone"))
    ys = many_series([70 + i % 9 for i in range(30)])
    odd = [np.array([1.0, np.nan] * 30), np.array([1.0, 2.0])]
    got = list(arma._fits([(str(i), y) for i, y in enumerate([*ys, *odd])], [(1, 1), (2, 0)]))
    assert len(got) == 64
    for cell, p, q, mu, phi, theta, sse, n, ok in got:
        if int(cell) >= 30:
            assert (mu, sse, n, ok) == (None, None, len(odd[int(cell) - 30]), False)
        else:
            beta, want, _ = alone(ys[int(cell)], p, q)
            assert sse == pytest.approx(want, rel=1e-9) and n == len(ys[int(cell)]) - p
            np.testing.assert_allclose([mu, *phi, *theta], beta, atol=1e-6)


def test_series_across_frames_stay_whole(monkeypatch):
    """Series cut by the borders of frames, a cell without name, batches that end in between."""
    monkeypatch.setattr(arma, "TOGETHER", 5)
    rows = pd.DataFrame({"cell_id": [None] * 3 + ["a"] * 4 + ["b"] * 6 + ["b"], "job": [0] * 13 + [1],
                         "t": range(14), "v": np.arange(14.0)})
    for step in (1, 2, 5, 14):
        batches = list(arma._series_batches(rows.iloc[i:i + step] for i in range(0, 14, step)))
        assert [(c, j, list(y)) for b in batches for c, j, y in b] == [
            (None, 0, [0, 1, 2]), ("a", 0, [3, 4, 5, 6]), ("b", 0, [7, 8, 9, 10, 11, 12]), ("b", 1, [13])]
        assert len(batches) == 3
