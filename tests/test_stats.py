import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.functions import solvers
from gridcast.functions.scale_out import pack_blocks
from gridcast.operators import arma, sketch, stats, tiles
from tests.test_sources_and_cleaning import LONG, long


def gaps(frame, rng, share=0.3):
    return frame.mask(rng.random(frame.shape) < share)


def to_spark(spark, frame):
    return spark.createDataFrame(
        [(c, int(t), None if v != v else float(v)) for c in frame for t, v in frame[c].items()], LONG)


@pytest.mark.parametrize("group,size", [(128, 1024), (2, 16), (1, 7)])
def test_spatial_corr_is_pairwise_complete(spark, group, size):
    rng = np.random.default_rng(3)
    frame = gaps(pd.DataFrame(rng.random((60, 5)) + 1000.0, columns=list("abcde")), rng)
    frame["flat"] = 0.1
    got = stats.spatial_corr(to_spark(spark, frame), group, size).toPandas()
    m = got.pivot(index="cell_a", columns="cell_b", values="r").astype(float)
    want = frame.corr().loc[m.index, m.columns]
    np.testing.assert_allclose(m.to_numpy(), want.to_numpy(), atol=1e-9)
    n = got.set_index(["cell_a", "cell_b"])["n"]
    assert n["a", "b"] == n["b", "a"] == (frame["a"].notna() & frame["b"].notna()).sum()


def test_pair_sums_are_shuffled_once_however_many_blocks():
    """A walk over blocks gives each pair once, with cells that lack blocks."""
    rng = np.random.default_rng(2)
    x = gaps(pd.DataFrame(rng.random((4, 90)).T, columns=list("abcd")), rng).to_numpy().T
    x[1, 30:60] = np.nan
    sums = stats.PairSums(same=True)
    for at in range(0, 90, 30):
        part = x[:, at:at + 30]
        some = np.flatnonzero((~np.isnan(part)).any(axis=1))[::1 if at else -1]
        sums.add(np.array(list("abcd"))[some], part[some], np.array(list("abcd"))[some], part[some])
    got = sums.frame().set_index(["cell_a", "cell_b"])
    assert len(got) == 10
    for i, a in enumerate("abcd"):
        for j in range(i, 4):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            assert got.loc[a, "abcd"[j]]["n"] == both.sum()
            assert math.isclose(got.loc[a, "abcd"[j]]["sxy"], (x[i] * x[j])[both].sum(), rel_tol=1e-12)


def test_spatial_corr_shuffles_no_pairs(spark):
    """Pairs leave their tile finished: the sums of all pairs are never grouped again."""
    frame = pd.DataFrame(np.random.default_rng(4).random((60, 40)), columns=[f"c{i:02d}" for i in range(40)])
    plan = stats.spatial_corr(to_spark(spark, frame), group=2)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "keys=[cell_a" not in plan


@pytest.mark.parametrize("held", [0, 1 << 25])
def test_spatial_corr_held_or_walked(spark, held):
    """Tiles walked block by block, or held whole and multiplied piece by piece."""
    rng = np.random.default_rng(6)
    frame = gaps(pd.DataFrame(rng.random((50, 40)), columns=[f"c{i:02d}" for i in range(40)]), rng)
    frame.iloc[16:32, 3] = np.nan                                # a block that a cell lacks
    got = stats.spatial_corr(to_spark(spark, frame), 2, 16, held=held).toPandas()
    assert len(got) == 1600
    m = got.pivot(index="cell_a", columns="cell_b", values="r").astype(float)
    np.testing.assert_allclose(m.to_numpy(), frame.corr().loc[m.index, m.columns].to_numpy(), atol=1e-9)


def test_closed_rows_are_short_and_lose_no_bit():
    rng = np.random.default_rng(8)
    measured = rng.integers(1, 150, 300).astype(float)
    again = np.tile(rng.random(20), 15)
    for off, x in (([], []), ([3], [-0.0]), ([0, 5, 1023], [np.inf, np.nan, 5e-324]), (range(0, 900, 3), measured),
                   (range(300), again), (range(300), rng.normal(size=300))):
        back, values = tiles.opened(tiles.closed_up(off, x))
        assert list(back) == list(off) and values.tobytes() == np.asarray(x, float).tobytes()
    assert max(len(tiles.closed_up(np.arange(300), x)) for x in (measured, again)) < 300 * 12 / 4


def test_rows_copied_to_tiles_are_closed(spark):
    """What is shuffled once per group of cells are closed rows, not the arrays of the packed ones."""
    frame = pd.DataFrame(np.random.default_rng(4).random((60, 40)), columns=[f"c{i:02d}" for i in range(40)])
    for least in (None, 0.2):
        plan = stats.spatial_corr(to_spark(spark, frame), group=2, min_abs_r=least)._jdf.queryExecution().executedPlan().toString()
        (fed,) = re.findall(r"MapInArrow pairs_of_tiles|MapInArrow <lambda>\(([^)]*)\)", plan)
        assert "z#" in fed and "off#" not in fed and "x#" not in fed


@pytest.mark.parametrize("least,most", [(None, 6), (0.05, 7.5)])
def test_pairs_come_in_both_orders_in_few_bytes(spark, tmp_path, least, most):
    """The result is written in few bytes: a value comes back soon after, and cells in runs."""
    rng = np.random.default_rng(9)
    frame = gaps(pd.DataFrame(rng.random((50, 600)), columns=[f"c{i:03d}" for i in range(600)]), rng, 0.1)
    got = stats.spatial_corr(to_spark(spark, frame), min_abs_r=least)
    got.coalesce(1).write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).toPandas()
    pairs = back[["cell_a", "cell_b"]].apply(tuple, axis=1)
    assert pairs.is_unique and set(pairs) == {(b, a) for a, b in pairs}
    assert len(back) == 360_000 if least is None else 100_000 < len(back) < 360_000
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    print(f"{size / len(back):.2f} bytes a row")
    assert size / len(back) < most


def test_groups_of_cells_grow_with_the_cells():
    """Each cell is copied once per group: no more copies for more cells until a task is full."""
    assert tiles.group_cells(1_000, 358, 12, 128) == 128
    assert math.ceil(60_000 / tiles.group_cells(60_000, 358, 12, 128)) == 10
    assert tiles.group_cells(10**6, 358, 12, 128) * 358 * 8 <= tiles.HELD
    assert 6 * 8 * tiles.group_cells(10**6, 10**6, 12, 128) ** 2 <= 2 * tiles.HELD


def families(cells, n, seed):
    """Cells of a few daily shapes, some upside down, some alone; then cells with gaps and a flat one."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    shapes = [np.sin(2 * np.pi * (k + 1) * t / 24 + k) + 0.5 * np.sin(2 * np.pi * t / (60 + 9 * k)) for k in range(8)]
    out = {}
    for i in range(cells):
        own = shapes[i % 8] if i % 5 else np.cumsum(rng.normal(size=n)) / 8
        out[f"c{i:03d}"] = (-1) ** (i // 8) * own * (1 + i % 3) + 100 + rng.normal(size=n) * 0.15 * (i % 4)
    return pd.DataFrame(out | {"flat": np.full(n, 0.1)})


@pytest.mark.parametrize("least", [0.5, 0.99])
@pytest.mark.parametrize("holes", [0, 7])
def test_pruned_correlation_loses_no_pair(spark, least, holes):
    rng = np.random.default_rng(5)
    frame = families(60, 200, 1)
    some = list(frame.columns[:holes])
    frame[some] = gaps(frame[some], rng, 0.1)
    df = to_spark(spark, frame).cache()
    got = stats.spatial_corr(df, 4, 64, min_abs_r=least).toPandas()
    want = stats.spatial_corr(df, 128, 64).filter(f"abs(r) >= {least}").toPandas()
    # a pair at the very bound may fall to either side by the last digit
    got, want = ({(a, b): (r, n) for a, b, r, n in f[["cell_a", "cell_b", "r", "n"]].itertuples(index=False)
                  if abs(r) > least + 1e-9} for f in (got, want))
    assert got.keys() == want.keys()
    assert any(r < 0 for r, _ in got.values()) and len(got) > 60
    for k in got:
        assert math.isclose(got[k][0], want[k][0], abs_tol=1e-9) and got[k][1] == want[k][1]


def test_pruning_examines_few_pairs(spark):
    frame = families(240, 300, 2)
    packed = pack_blocks(to_spark(spark, frame - frame.mean()), 128)
    cells = packed.groupBy("cell_id").agg(F.lit(300).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("first"),
                                          F.lit(299).cast("bigint").alias("last"))
    examined = sketch.pairs_examined(sketch.seats(packed, cells, 0.95, 8, 128))
    r = frame.drop(columns="flat").corr().abs().to_numpy()
    wanted = int((r[np.triu_indices(240)] >= 0.95).sum())
    print(f"pairs examined {examined} of {240 * 241 // 2}, above the bound {wanted}")
    assert wanted <= examined < 240 * 241 // 2 / 3


@pytest.mark.parametrize("held", [0, 1 << 25])
@pytest.mark.parametrize("holes", [0, 7])
def test_pruned_tiles_lose_no_pair_and_skip_pieces(spark, held, holes):
    """Large groups: the bound is asked again for every piece of a tile, whole or walked."""
    frame = families(60, 200, 1)
    some = list(frame.columns[:holes])
    frame[some] = gaps(frame[some], np.random.default_rng(5), 0.1)
    df = to_spark(spark, frame).cache()
    got = stats.spatial_corr(df, 8, 64, min_abs_r=0.9, held=held).toPandas()
    want = stats.spatial_corr(df, 128, 64).filter("abs(r) >= 0.9").toPandas()
    got, want = (f[f["r"].abs() > 0.9 + 1e-9].set_index(["cell_a", "cell_b"]).sort_index() for f in (got, want))
    assert len(got) > 60 and list(got.index) == list(want.index)
    np.testing.assert_allclose(got["r"], want["r"], atol=1e-9)
    assert list(got["n"]) == list(want["n"])


def test_pieces_out_of_reach_are_not_multiplied():
    """Two cells apart in their sketches, one without; each piece is a cell."""
    x = np.random.default_rng(1).normal(size=(3, 20))
    pdf = pd.DataFrame({"cell_id": list("abc"), "blk": 0, "off": [np.arange(20)] * 3, "x": list(x), "_g": "g",
                        "c": [np.array([1.0, 0.0]), np.array([0.0, 1.0]), None], "rest": [0.0, 0.0, np.nan]})
    met = [(a[p], b[q]) for a, b, i, j, _ in tiles.tile_pairs([pdf], "g", "g", 1, 20, True, sketch.within(0.5)) for p, q in zip(i, j)]
    assert sorted(met) == [("a", "a"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")]


def test_pruned_correlation_of_nothing(spark):
    assert stats.spatial_corr(spark.createDataFrame([], LONG), min_abs_r=0.5).count() == 0
    assert stats.spatial_corr(long(spark, a=[1.0] * 20, b=[2.0] * 20), min_abs_r=0.5).count() == 0


def test_spatial_corr_of_a_constant(spark):
    got = stats.spatial_corr(long(spark, a=[1.0, 1.0], b=[3.0, 4.0])).collect()
    assert {(r.cell_a, r.cell_b): r.r for r in got} == {
        ("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}


@pytest.mark.parametrize("size", [5, 16, 1024])
def test_autocorrelation_and_acf(spark, size):
    x = np.random.default_rng(1).random(90).cumsum()
    df = long(spark, a=x.tolist())
    got = {r.lag: r.r for r in stats.autocorrelation(df, 8, size).collect()}
    assert sorted(got) == list(range(1, 9))
    for i in got:
        a, b = x[i:], x[:-i]
        want = ((a - a.mean()) * (b - b.mean())).sum() / (a.std() * b.std() * len(a))
        assert math.isclose(got[i], want, abs_tol=1e-9)
    rows = sorted(stats.acf(df, 8, size).collect(), key=lambda r: r.lag)
    d = x - x.mean()
    want = [float(d[k:] @ d[:len(d) - k] / (d @ d)) for k in range(9)]
    np.testing.assert_allclose([r.r for r in rows], want, atol=1e-9)
    assert rows[0].band == 0.0 and math.isclose(rows[1].band, 1.96 / math.sqrt(90))
    assert math.isclose(rows[3].band, 1.96 * math.sqrt((1 + 2 * (want[1] ** 2 + want[2] ** 2)) / 90),
                        abs_tol=1e-9)


@pytest.mark.parametrize("bits", [14, 5, 3])
def test_all_lags_by_transforms(spark, monkeypatch, bits):
    """Whole and cut transforms, cells of several lengths, gaps: as the sums lag by lag."""
    monkeypatch.setattr(stats, "POINT_BITS", bits)
    rng = np.random.default_rng(6)
    frame = gaps(pd.DataFrame(rng.random((700, 3)) * 5 + 1e4, columns=list("abc")), rng)
    frame.loc[300:, "b"] = np.nan
    frame.loc[1:, "c"] = np.nan
    frame["flat"] = 3.0
    df = to_spark(spark, frame)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    for lags in (699, 320):
        got = stats.lagged_sums(df, lags).toPandas().set_index(["cell_id", "lag"]).sort_index()
        monkeypatch.setattr(stats, "MANY_LAGS", 10 ** 6)
        want = stats.lagged_sums(df, lags).toPandas().set_index(["cell_id", "lag"]).sort_index()
        monkeypatch.setattr(stats, "MANY_LAGS", 256)
        assert list(got.index) == list(want.index) and (got["n"] == want["n"]).all()
        np.testing.assert_allclose(got[names[1:]], want[names[1:]], atol=1e-8)


def test_acf_of_all_lags(spark):
    x = np.random.default_rng(1).random(20_000).cumsum()
    rows = sorted(stats.acf(long(spark, a=x.tolist()), 19_999).collect(), key=lambda r: r.lag)
    d = x - x.mean()
    want = np.correlate(d, d, "full")[19_999:] / (d @ d)
    np.testing.assert_allclose([r.r for r in rows], want, atol=1e-10)
    squares = np.concatenate([[0, 0], np.cumsum(want[1:-1] ** 2)])
    np.testing.assert_allclose([r.band for r in rows][1:], (1.96 * np.sqrt((1 + 2 * squares) / 20_000))[1:], atol=1e-9)


def test_pacf_solves_the_yule_walker_equations(spark):
    x = np.random.default_rng(2).random(200).cumsum()
    got = {r.lag: r.r for r in stats.pacf(long(spark, a=x.tolist()), 5, 64).collect()}
    d = x - x.mean()
    r = [float(d[k:] @ d[:len(d) - k] / (d @ d)) for k in range(6)]
    for k in range(1, 6):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert math.isclose(got[k], np.linalg.solve(toeplitz, r[1:k + 1])[-1], abs_tol=1e-8)


def brute_adf(x, max_lag):
    dx = np.diff(x)

    def fit(lag, first):
        rows = range(first, len(x))
        a = np.array([[1.0, x[t - 1], *[dx[t - 1 - i] for i in range(1, lag + 1)]] for t in rows])
        y = np.array([dx[t - 1] for t in rows])
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        return a, b, float(((y - a @ b) ** 2).sum())

    aic = []
    for lag in range(max_lag + 1):
        a, _, sse = fit(lag, max_lag + 1)
        aic.append(len(a) * math.log(sse / len(a)) + 2 * (lag + 2))
    lag = int(np.argmin(aic))
    a, b, sse = fit(lag, lag + 1)
    se = math.sqrt(sse / (len(a) - lag - 2) * np.linalg.inv(a.T @ a)[1, 1])
    return b[1] / se, lag, len(a)


@pytest.mark.parametrize("size", [20, 1024])
def test_adf(spark, size):
    rng = np.random.default_rng(4)
    noise, walk = rng.random(150), rng.normal(size=150).cumsum()
    ar = np.zeros(150)
    for t in range(3, 150):
        ar[t] = 0.4 * ar[t - 1] + 0.35 * ar[t - 3] + rng.normal()
    series = {"noise": noise, "walk": walk, "ar": ar}
    df = long(spark, **{k: v.tolist() for k, v in series.items()})
    got = {r.cell_id: r for r in stats.adf_test(df, 7, size).collect()}
    for name, x in series.items():
        stat, lag, n = brute_adf(x, 7)
        assert math.isclose(got[name].stat, stat, rel_tol=1e-6)
        assert (got[name].used_lag, got[name].n_obs) == (lag, n)
    assert got["noise"].p_value < 0.01 < 0.1 < got["walk"].p_value
    zero = {r.cell_id: r.stat for r in stats.adf_lag0(df, size).collect()}
    for name, x in series.items():
        assert math.isclose(zero[name], brute_adf(x, 0)[0], rel_tol=1e-6)
    assert stats.adf_test(df).count() == 3


def test_adf_constants_agree():
    for stat, p in ((-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)):
        assert abs(solvers.adf_p_value(stat) - p) < 1e-3
    assert solvers.adf_p_value(3.0) == 1.0 and solvers.adf_p_value(-20.0) == 0.0


@pytest.mark.parametrize("n,k", [(40, 5), (9, 4), (6, 5)])
def test_gram_from_lag_sums(n, k):
    x = np.random.default_rng(n).random(n) + 3
    cross = [float(x[d:] @ x[:n - d]) for d in range(k + 1)]
    g, _, m = solvers.centred_gram(n, float(x.sum()), cross, x[:k], x[-k:], k)
    z = np.array([[1.0, *(x[t - k:t + 1][::-1] - m)] for t in range(k, n)])
    np.testing.assert_allclose(g, z.T @ z, atol=1e-9)


def test_lag_statistics_do_not_depend_on_the_mean(spark):
    rng = np.random.default_rng(9)
    x = [0.0]
    for e in rng.normal(size=700):
        x.append(0.8 * x[-1] + float(e))
    x = (np.round(np.array(x) * 1024) / 1024).tolist()               # exact beside 1e8
    near = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "cell_id string, t bigint, v double")
    far = near.selectExpr("cell_id", "t", "v + 1e8 AS v")
    for stat in (lambda d: stats.autocorrelation(d, 3), lambda d: stats.acf(d, 3), lambda d: stats.pacf(d, 3),
                 lambda d: stats.adf_test(d, 4), lambda d: stats.adf_lag0(d),
                 lambda d: arma.ar_fit(d, 2).selectExpr("cell_id", "p AS lag", "phi[0]", "phi[1]", "sse", "bic")):
        a, b = (f.toPandas().sort_values(f.columns[:2]).select_dtypes("number").to_numpy(float) for f in (stat(near), stat(far)))
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-6)
    assert abs(arma.ar_fit(far, 1).first()["mu"] - 1e8 - arma.ar_fit(near, 1).first()["mu"]) < 1e-5


def test_short_cells_are_reported(spark):
    df = spark.createDataFrame([("short", 0, 1.0), ("short", 1, 2.0)] + [("long", t, float(t * 7 % 11)) for t in range(60)],
                               "cell_id string, t bigint, v double")
    got = {r["cell_id"]: r for r in stats.adf_test(df, 4).collect()}
    assert got["short"]["stat"] is None and got["short"]["n_obs"] == 2 and got["long"]["stat"] is not None
    fits = {r["cell_id"]: r for r in arma.ar_fit(df, 2).collect()}
    assert fits["short"]["mu"] is None and fits["long"]["mu"] is not None


def test_adf_lags_follow_each_cell(spark):
    """A long cell does not change a short one's test."""
    rng = np.random.default_rng(12)
    short, other = rng.normal(size=60).cumsum(), rng.normal(size=900).cumsum()
    alone = stats.adf_test(long(spark, a=short.tolist())).first()
    beside = {r.cell_id: r for r in stats.adf_test(long(spark, a=short.tolist(), b=other.tolist() )).collect()}
    assert beside["a"] == alone and alone.stat is not None
    stat, lag, n = brute_adf(short, stats.adf_lags(60))
    assert math.isclose(alone.stat, stat, rel_tol=1e-6) and (alone.used_lag, alone.n_obs) == (lag, n)
    stat, lag, n = brute_adf(other, stats.adf_lags(900))
    assert math.isclose(beside["b"].stat, stat, rel_tol=1e-6) and beside["b"].used_lag == lag
