"""Spectrum slicing and whitening against numpy's eigenvalues and exact sums."""

import math

import numpy as np
import pytest

from gridcast.llm import spectrum, whitening


@pytest.mark.parametrize("d", [1, 2, 3, 7, 30])
def test_inertia_counts(d):
    rng = np.random.default_rng(d)
    for _ in range(10):
        a = rng.normal(size=(d, d))
        a += a.T
        values = np.linalg.eigvalsh(a)
        assert all(spectrum.inertia(a, s) == (values > s).sum() for s in rng.normal(size=10) * 3)
    hollow = np.ones((4, 4)) - np.eye(4)                      # zero pivots throughout
    assert [spectrum.inertia(hollow, s) for s in (-2.0, -0.5, 0.0, 2.5, 3.5)] == [4, 1, 1, 1, 0]


def test_leading_pairs_of_ordinary_and_repeated_spectra():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    close = np.concatenate([[9, 9, 9, 9 - 1e-9, 9 - 1e-6], np.linspace(5, 1, 30), [1e-3] * 5])
    for values in (np.arange(40, 0, -1.0), close, 2.0 ** -np.arange(40), np.full(40, 3.0)):
        a = turn * values @ turn.T
        got, axes = spectrum.leading(a, 12)
        want = np.sort(values)[::-1][:12]
        assert np.allclose(got, want, rtol=1e-10, atol=1e-13 * values.max())
        assert np.abs(a @ axes - axes * got).max() < 1e-12 * values.max()
        assert np.abs(axes.T @ axes - np.eye(12)).max() < 1e-6
    assert spectrum.leading(np.zeros((3, 3)), 2)[1].shape == (3, 0)
    assert len(spectrum.leading(np.diag([4.0, 1, 0, 0]), 4)[0]) == 2


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>" + extra)


def test_whitened_rows(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())]
    bad = [(900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []),
           (905, [1.0] * 11), (906, [1e30] * 12)]
    df = vectors(spark, rows + bad)
    whole = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(whole), whole.sum(axis=0)
    centred = whole - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    model = whitening.fit(df, components=5)
    got = whitening.whiten(df, model).orderBy("vec_id", "component").collect()
    assert len(got) == n * 5 and {r["vec_id"] for r in got} == set(range(400))
    assert np.allclose(model.values, values[::-1][:5], rtol=1e-12) and model.n == n
    for r in got[:50] + got[-50:]:
        axis = axes[:, -r["component"]]
        at = r["vec_id"]
        assert abs(abs(r["whitened"]) - abs(centred[at] @ axis / math.sqrt(values[-r["component"]]))) < 1e-9
        assert int(r["deviation"]) == sum((n * int(v) - int(s)) ** 2 for v, s in zip(whole[at], sums))
        assert abs(r["explained"] - values[-r["component"]] / values.sum()) < 1e-10 and r["identity_error"] < 1e-9


def test_deviation_is_exact_beyond_long(spark):
    model = whitening.Whitening(10 ** 7, [10 ** 13, 5], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[2 ** 40, 3], [1_000_000, 0]], np.int64)
    assert model.deviation(x) == [(10 ** 7 * 2 ** 40 - 10 ** 13) ** 2 + (3 * 10 ** 7 - 5) ** 2, 25]


def test_no_direction_no_row(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]):
        df = vectors(spark, rows)
        assert whitening.whiten(df, whitening.fit(df)).count() == 0


def test_few_vectors_and_clashing_columns(spark):
    df = vectors(spark, [(1, [1.0, 5.0, 2.0], 4, "a", 1), (None, [2.0, 5.0, 0.0], 5, "b", 2), (3, [0.0, 5.0, 7.0], 6, None, 3)],
                 ", COMPONENT int, `kept` string, `z` int")
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 6 and {r["kept"] for r in got} == {"a", "b", None}
