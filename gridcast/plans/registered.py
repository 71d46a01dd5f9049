"""One query per operator, over the given tables.

``events`` gives few cells on a 45-minute grid, ``orders`` 25 sparse daily cells and
``lineitem`` one weekly series per supplier, so the number of cells grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridcast.config import GRANULARITIES, GRID_START
from gridcast.functions.recurrent import Shape, initial
from gridcast.functions.scale_out import scratch_path, settle
from gridcast.operators import arma, clean, latent, metrics, scale, sequence, stats, windows
from gridcast.plans import forecasts
from gridcast.sources import stand_ins, tables

CFG = GRANULARITIES[45]
STEPS = CFG.day
TARGET = "signup"
TRAIN_WEEKS = 280
STRONG = 0.2
MU, PHI, THETA = 0.4123457, (0.5123457, -0.2234567), (0.3141593,)
BIAS = (0.1, -0.2)
STACK_BIAS, STACK_BACK = (-0.1, 0.15), (0.2, -0.05, 0.1)


def encoder_weight(ord_: int, unit: int) -> float:
    return ((3 * ord_ + 5 * unit) % 7 - 3) / 10


def decoder_bias(ord_: int) -> float:
    return (ord_ % 3 - 1) / 10


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[_r(c).alias(c) if c in names else F.col(c) for c in df.columns])


def _events(spark, sf_dir, minutes=45):
    return stand_ins.event_traffic(spark, sf_dir, minutes)


def _traffic(spark, sf_dir):
    """All event cells side by side: filled, scaled, trimmed; settled first, as it is read often."""
    events = settle(_events(spark, sf_dir))
    return clean.prepare(events, start=clean.usual_start(events))


def _types(spark, sf_dir) -> list[str]:
    """The event types in order: the columns of the wide forms."""
    return [r[0] for r in _events(spark, sf_dir).select("cell_id").distinct().orderBy("cell_id").collect()]


def _weekly(spark, sf_dir):
    return clean.prepare(settle(stand_ins.supplier_shipments(spark, sf_dir)))


def _revenue(spark, sf_dir):
    return stand_ins.nation_revenue(spark, sf_dir)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, [encoder_weight(i, j) for j in range(2)], decoder_bias(i))
            for i, c in enumerate(_types(spark, sf_dir))]
    return spark.createDataFrame(rows, "cell_id STRING, w ARRAY<DOUBLE>, c DOUBLE")


def _features(spark, sf_dir):
    """(t, y, z1, z2) with the fixed encoder."""
    ser = settle(_traffic(spark, sf_dir))
    z = latent.encode_arrays(ser, _weights(spark, sf_dir), BIAS) \
        .select("t", F.col("z")[0].alias("z1"), F.col("z")[1].alias("z2"))
    return settle(windows.column_stack(ser.filter(F.col("cell_id") == TARGET), z))


def _params(ser: DataFrame, phi=PHI, theta=THETA) -> DataFrame:
    """The fixed ARMA(2, 1) for every cell."""
    return ser.select("cell_id").distinct().select(
        "cell_id", F.lit(len(phi)).alias("p"), F.lit(len(theta)).alias("q"), F.lit(MU).alias("mu"),
        F.array(*map(F.lit, phi)).alias("phi"), F.array(*map(F.lit, theta)).alias("theta"))


# --- sources and sinks -------------------------------------------------------------------


def scan_cells(spark, sf_dir):
    path = scratch_path(spark, "cells")
    stand_ins.nation_cells(spark, sf_dir).orderBy("n_nationkey").select("lon", "lat") \
        .write.csv(path, header=False)
    return tables.scan_cells(spark, path).withColumns({c: _r(c, 8) for c in ("lon", "lat")})


def _wide(spark, sf_dir):
    listed = _events(spark, sf_dir).select("cell_id").distinct()
    return tables.long_to_wide(tables.reindex_cells(_events(spark, sf_dir), listed), _types(spark, sf_dir))


def scan_traffic_wide(spark, sf_dir):
    path = scratch_path(spark, "wide")
    _wide(spark, sf_dir).orderBy("t").drop("t").write.csv(path, header=True)
    return _rounded(tables.scan_traffic_wide(spark, path), *_types(spark, sf_dir))


def reindex_cells(spark, sf_dir):
    """The suppliers in credit, and one cell nobody ships for."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    listed = supplier.filter("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("cell_id"))
    nobody = supplier.agg((F.max("s_suppkey") + 1).cast("string").alias("cell_id"))
    return tables.reindex_cells(stand_ins.supplier_shipments(spark, sf_dir), listed.union(nobody))


def time_grid(spark, sf_dir):
    total = _events(spark, sf_dir, 15).groupBy("t").agg(F.sum("v").alias("v"))
    return tables.attach_time(total, GRID_START, 15) \
        .select("t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), _r("v").alias("v"))


def wide_to_long(spark, sf_dir):
    return tables.wide_to_long(tables.long_to_wide(_events(spark, sf_dir), _types(spark, sf_dir)))


def long_to_wide(spark, sf_dir):
    return tables.long_to_wide(_events(spark, sf_dir), _types(spark, sf_dir))


def select_target(spark, sf_dir):
    return tables.select_target(_events(spark, sf_dir), TARGET)


def write_series(spark, sf_dir):
    path = scratch_path(spark, "series")
    rows = tables.attach_time(_events(spark, sf_dir).filter(F.col("cell_id") == TARGET), GRID_START, 45)
    tables.write_series(rows.select("t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "v"), path)
    return spark.read.csv(path, header=True, schema="t BIGINT, ts STRING, v DOUBLE")


# --- cleaning and scaling ----------------------------------------------------------------


def drop_sparse_cells(spark, sf_dir):
    """Cells with at least the average number of known slots."""
    events = settle(_events(spark, sf_dir))
    average = events.groupBy("cell_id").agg(F.count("v").alias("n")).agg(F.ceil(F.avg("n"))).first()[0] or 0
    return clean.drop_sparse_cells(events, average)


def interpolate_linear(spark, sf_dir):
    return clean.interpolate_linear(settle(_revenue(spark, sf_dir)))


def minmax_scale(spark, sf_dir):
    return scale.minmax_scale(settle(clean.interpolate_linear(settle(_revenue(spark, sf_dir)))))


def tanh_scale_columns(spark, sf_dir):
    return _rounded(scale.tanh_scale_columns(_revenue(spark, sf_dir)), "v")


def tanh_scale_global(spark, sf_dir):
    return _rounded(scale.tanh_scale_global(_revenue(spark, sf_dir)), "v")


def first_difference(spark, sf_dir):
    return scale.first_difference(_weekly(spark, sf_dir))


def sigmoid_affine(spark, sf_dir):
    z = scale.sigmoid_affine(_traffic(spark, sf_dir), _weights(spark, sf_dir), BIAS)
    return z.select("t", _r(F.col("z")[0]).alias("z1"), _r(F.col("z")[1]).alias("z2"))


# --- correlation -------------------------------------------------------------------------


def spatial_corr(spark, sf_dir):
    return _rounded(stats.spatial_corr(settle(stand_ins.supplier_shipments(spark, sf_dir))), "r")


def spatial_corr_strong(spark, sf_dir):
    """Only the correlated pairs of filled suppliers side by side; the others are pruned, not filtered."""
    shipments = settle(stand_ins.supplier_shipments(spark, sf_dir))
    filled = settle(clean.prepare(shipments, start=clean.usual_start(shipments)))
    return _rounded(stats.spatial_corr(filled, group=32, min_abs_r=STRONG), "r")


def autocorrelation(spark, sf_dir):
    return _rounded(stats.autocorrelation(_weekly(spark, sf_dir), 12), "r")


def autocorrelation_large_mean(spark, sf_dir):
    """Gappy whole numbers around a hundred million: the same correlations as around zero."""
    far = stand_ins.supplier_shipments(spark, sf_dir).withColumn("v", F.col("v") + 1e8)
    return _rounded(stats.autocorrelation(settle(far), 12), "r")


def acf(spark, sf_dir):
    return _rounded(stats.acf(_weekly(spark, sf_dir), 12), "r", "band")


def acf_all_lags(spark, sf_dir):
    """Lags up to the length of the series."""
    ser = settle(_weekly(spark, sf_dir))
    return _rounded(stats.acf(ser, ser.agg(F.max("t")).first()[0] or 0), "r", "band")


def pacf(spark, sf_dir):
    return _rounded(stats.pacf(_weekly(spark, sf_dir), 12), "r")


def pacf_two_lags(spark, sf_dir):
    return _rounded(stats.pacf(_weekly(spark, sf_dir), 2), "r")


def adf_test(spark, sf_dir):
    df = stats.adf_test(_weekly(spark, sf_dir), 16)
    return _rounded(df, "stat", "p_value", "crit_1", "crit_5", "crit_10")


def adf_test_own_lags(spark, sf_dir):
    """With the number of lags that is usual for each cell's length."""
    return _rounded(stats.adf_test(_weekly(spark, sf_dir)), "stat", "p_value", "crit_1", "crit_5", "crit_10")


def adf_one_lag(spark, sf_dir):
    """No lag or one, whichever AIC prefers: small enough for SQL to follow."""
    return _rounded(stats.adf_test(_weekly(spark, sf_dir), 1).drop("p_value"), "stat", "crit_1", "crit_5", "crit_10")


def adf_lag0(spark, sf_dir):
    return _rounded(stats.adf_lag0(_weekly(spark, sf_dir)), "stat")


# --- windows -----------------------------------------------------------------------------


def column_stack(spark, sf_dir):
    return _rounded(_features(spark, sf_dir), "y", "z1", "z2")


def train_test_split(spark, sf_dir):
    train, test = windows.train_test_split(settle(_weekly(spark, sf_dir)), TRAIN_WEEKS)
    df = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return _rounded(df, "v")


def batch_slices(spark, sf_dir):
    df = windows.batch_slices(_traffic(spark, sf_dir), CFG.latent_batch, CFG.latent_batches)
    return df.groupBy("batch_id", "cell_id").agg(F.count("*").alias("n"), _r(F.sum("v")).alias("total"))


def _per_window(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[_r(F.sum((F.col("step") + 1) * F.col(c))).alias(c)
                                   for c in ("y", "z1", "z2", "target")])


def supervised_windows(spark, sf_dir):
    return _per_window(windows.supervised_windows(_features(spark, sf_dir), STEPS), "window_id")


def supervised_windows_padded(spark, sf_dir):
    return _per_window(windows.supervised_windows(_features(spark, sf_dir), STEPS, "zeros"), "window_id")


def _batches(spark, sf_dir):
    df = windows.supervised_windows(_features(spark, sf_dir), STEPS)
    return windows.window_batches(df, CFG.lanes, CFG.batches)


def window_batches(spark, sf_dir):
    return _per_window(_batches(spark, sf_dir), "batch_id", "lane", "window_id")


def eval_windows(spark, sf_dir):
    df = windows.windows_at(_features(spark, sf_dir), STEPS,
                            windows.strided(F.col("window_id"), *CFG.evaluate))
    return _rounded(df.withColumn("step", F.col("step").cast("bigint")), "y", "z1", "z2", "target")


def lane_chains(spark, sf_dir):
    return windows.lane_chains(_batches(spark, sf_dir), CFG.lanes)


# --- ARMA --------------------------------------------------------------------------------


def _flat_fit(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("cell_id", F.col("p").cast("bigint").alias("p"), F.col("q").cast("bigint").alias("q"),
                     *[_r(c).alias(c) if c != "n" else F.col(c) for c in extra])


def ar_fit(spark, sf_dir):
    df = arma.ar_fit(_weekly(spark, sf_dir), 1)
    return _flat_fit(df.withColumn("phi_1", F.col("phi")[0]), "mu", "phi_1", "sse", "n", "sigma2", "bic")


def arma_css(spark, sf_dir):
    ser = settle(_weekly(spark, sf_dir))
    return _flat_fit(arma.arma_css(ser, _params(ser)), "sse", "n", "sigma2")


def arma_bic(spark, sf_dir):
    ser = settle(_weekly(spark, sf_dir))
    return _flat_fit(arma.arma_bic(arma.arma_css(ser, _params(ser))), "bic")


def arma_predict_in_sample(spark, sf_dir):
    ser = settle(_weekly(spark, sf_dir))
    return _rounded(arma.arma_predict_in_sample(ser, _params(ser)).select("cell_id", "t", "yhat"), "yhat")


def arma_forecast(spark, sf_dir):
    ser = settle(_weekly(spark, sf_dir))
    return _rounded(arma.arma_forecast(ser, _params(ser), 52).select("cell_id", "t", "yhat"), "yhat")


def arma_fit(spark, sf_dir):
    df = arma.arma_fit(settle(_weekly(spark, sf_dir)), [(1, 1)])
    df = df.withColumn("phi_1", F.col("phi")[0]).withColumn("theta_1", F.col("theta")[0])
    return _flat_fit(df, "mu", "phi_1", "theta_1", "sse", "n", "bic")


def arma_fit_ar1(spark, sf_dir):
    df = arma.arma_fit(settle(_weekly(spark, sf_dir)), [(1, 0)])
    return _flat_fit(df.withColumn("phi_1", F.col("phi")[0]), "mu", "phi_1", "sse", "n", "bic")


def arma_fit_ar2(spark, sf_dir):
    df = arma.arma_fit(settle(_weekly(spark, sf_dir)), [(2, 0)])
    df = df.withColumn("phi_1", F.col("phi")[0]).withColumn("phi_2", F.col("phi")[1])
    return _flat_fit(df, "mu", "phi_1", "phi_2", "sse", "n", "bic")


def arma_order_search_configured(spark, sf_dir):
    """The whole configured grid of orders (169 of them) for the event cells at 30 minutes."""
    events = settle(_events(spark, sf_dir, 30))
    return _flat_fit(forecasts.configured_orders(settle(clean.prepare(events)), GRANULARITIES[30]), "sse", "n", "bic")


def arma_order_search(spark, sf_dir):
    return _flat_fit(arma.arma_order_search(settle(_weekly(spark, sf_dir)), 3, 2), "sse", "n", "bic")


def arma_order_search_ar(spark, sf_dir):
    return _flat_fit(arma.arma_order_search(settle(_weekly(spark, sf_dir)), 2, 1), "n", "bic")


# --- compression -------------------------------------------------------------------------


def _bit(spark, sf_dir) -> Column:
    ordinal = F.array_position(F.array(*map(F.lit, _types(spark, sf_dir))), F.col("cell_id")) - 1
    return F.pmod(F.lit(7) * F.col("t") + F.lit(13) * ordinal + F.lit(5), F.lit(2))


def corrupt_mask(spark, sf_dir):
    return _rounded(latent.corrupt_mask(_traffic(spark, sf_dir), 5, 0.75, _bit(spark, sf_dir)), "v")


def latent_encode(spark, sf_dir):
    df = latent.latent_encode(_traffic(spark, sf_dir), _weights(spark, sf_dir), BIAS)
    return _rounded(df.withColumn("unit", F.col("unit").cast("bigint")), "z")


def _decoded(spark, sf_dir, ser):
    w = _weights(spark, sf_dir)
    return latent.latent_decode(latent.latent_encode(ser, w, BIAS), w, ser)


def latent_decode(spark, sf_dir):
    return _rounded(_decoded(spark, sf_dir, settle(_traffic(spark, sf_dir))), "y")


def reconstruction_cost(spark, sf_dir):
    ser = settle(_traffic(spark, sf_dir))
    return _rounded(latent.reconstruction_cost(ser, _decoded(spark, sf_dir, ser)), "cost")


def latent_gradient(spark, sf_dir):
    df = latent.latent_gradient(settle(_traffic(spark, sf_dir)), _weights(spark, sf_dir), BIAS, _bit(spark, sf_dir))
    return _rounded(df.withColumn("unit", F.col("unit").cast("bigint")), "g")


def latent_fit(spark, sf_dir):
    ser = settle(_traffic(spark, sf_dir))
    model = latent.latent_fit(ser, (2,), CFG.latent_lr, CFG.latent_epochs, CFG.latent_batch, None, "seeded")
    return _rounded(model.encode(ser), "z1", "z2")


def _fitted(model):
    return model.weights.select("cell_id", _r(F.col("w")[0]).alias("w0"), _r(F.col("w")[1]).alias("w1"), _r("c").alias("c"),
                                _r(F.lit(model.bias[0])).alias("b0"), _r(F.lit(model.bias[1])).alias("b1"),
                                _r(F.lit(model.costs[-1][1])).alias("cost"))


def latent_fit_two_epochs(spark, sf_dir):
    """Two steps along the whole gradient, from fixed weights and with the fixed mask, so that SQL
    can follow."""
    start, ser = (_weights(spark, sf_dir), BIAS), settle(_traffic(spark, sf_dir))
    last, slots = ser.agg(F.max("t"), F.count_distinct("t")).first()
    lr = CFG.latent_lr * min(CFG.latent_batch, slots) / slots
    return _fitted(latent.latent_fit(ser, (2,), lr, 2, last + 1, mask=_bit(spark, sf_dir), start=start))


def latent_fit_two_batches(spark, sf_dir):
    """The first two of the configured steps, likewise."""
    start = _weights(spark, sf_dir), BIAS
    return _fitted(latent.latent_fit(_traffic(spark, sf_dir), (2,), CFG.latent_lr, 1, CFG.latent_batch, 2,
                                     mask=_bit(spark, sf_dir), start=start, cells_a_task=2))


def latent_stack_step(spark, sf_dir):
    """One step of a stack of two tied layers, from fixed weights."""
    weights = spark.createDataFrame(
        [(c, [encoder_weight(i, j) for j in range(3)], decoder_bias(i)) for i, c in enumerate(_types(spark, sf_dir))],
        "cell_id STRING, w ARRAY<DOUBLE>, c DOUBLE")
    inner = [[encoder_weight(j + 1, k) for k in range(2)] for j in range(3)]
    start = weights, (*BIAS, 0.05), [(inner, STACK_BIAS)], [(inner, STACK_BACK)]
    model = latent.latent_fit(_traffic(spark, sf_dir), (3, 2), CFG.latent_lr, 1, CFG.latent_batch, 1,
                              mask=_bit(spark, sf_dir), start=start, cells_a_task=2)
    (w, e), (_, f) = model.deeper[0], model.decode_deeper[0]
    told = {f"b{j}": b for j, b in enumerate(model.bias)} | {f"e{k}": e[k] for k in range(2)} | {f"f{j}": f[j] for j in range(3)} \
        | {f"v{j}{k}": w[j][k] for j in range(3) for k in range(2)} | {"cost": model.costs[0][1]}
    return model.weights.select("cell_id", *[_r(F.col("w")[j]).alias(f"w{j}") for j in range(3)], _r("c").alias("c"),
                                *[_r(F.lit(float(x))).alias(n) for n, x in told.items()])


# --- sequence forecaster -----------------------------------------------------------------


def sequence_forecast(spark, sf_dir):
    weights = initial(Shape(), *CFG.init, CFG.bias, seed=7)
    df = windows.supervised_windows(_features(spark, sf_dir), STEPS)
    return _rounded(sequence.sequence_forecast(df, weights), "yhat")


def sequence_fit(spark, sf_dir):
    model = sequence.sequence_fit(_features(spark, sf_dir), CFG)
    return _rounded(spark.createDataFrame(model.costs, "epoch BIGINT, cost DOUBLE"), "cost")


def sequence_cost(spark, sf_dir):
    """Yesterday's value as the forecast of every window."""
    df = windows.supervised_windows(_features(spark, sf_dir), STEPS)
    pred = df.select("window_id", "step", F.col("y").alias("yhat"))
    return _rounded(sequence.sequence_cost(pred, df.select("window_id", "step", "target")), "cost")


# --- scores ------------------------------------------------------------------------------


def _ar1_forecast(spark, sf_dir):
    """Test weeks and their AR(1) forecast."""
    ser = settle(_weekly(spark, sf_dir))
    train, test = windows.train_test_split(ser, TRAIN_WEEKS)
    horizon = test.agg(F.max("t")).first()[0] - TRAIN_WEEKS + 1
    params = arma.ar_fit(train, 1).select("cell_id", "p", "q", "mu", "phi", "theta")
    return test.withColumnRenamed("v", "y"), arma.arma_forecast(train, params, horizon)


def mse(spark, sf_dir):
    return _rounded(metrics.mse(*_ar1_forecast(spark, sf_dir), ["cell_id", "t"], ["cell_id"]), "mse")


def mae(spark, sf_dir):
    return _rounded(metrics.mae(*_ar1_forecast(spark, sf_dir), ["cell_id", "t"], ["cell_id"]), "mae")


def actual_vs_forecast(spark, sf_dir):
    df = metrics.actual_vs_forecast(*_ar1_forecast(spark, sf_dir), ["cell_id", "t"])
    return _rounded(df, "y", "yhat")


def arma_day_forecast(spark, sf_dir):
    ser = settle(_traffic(spark, sf_dir))
    return _rounded(forecasts.arma_day_forecast(ser, CFG.train, CFG.order).scores, "mse", "mae")


def arma_day_forecast_ar1(spark, sf_dir):
    """The whole forecast with an order that SQL can follow."""
    done = forecasts.arma_day_forecast(settle(_weekly(spark, sf_dir)), TRAIN_WEEKS, (1, 0))
    return _rounded(done.scores.select("cell_id", "mse", "mae"), "mse", "mae")


def compressed_day_forecast(spark, sf_dir):
    ser = settle(_traffic(spark, sf_dir))
    done = forecasts.compressed_day_forecast(ser, TARGET, CFG)
    return _rounded(done.scores, "mse", "mae")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    scan_cells, scan_traffic_wide, reindex_cells, time_grid, wide_to_long, long_to_wide,
    select_target, write_series, drop_sparse_cells, interpolate_linear, minmax_scale,
    tanh_scale_columns, tanh_scale_global, first_difference, sigmoid_affine, spatial_corr, spatial_corr_strong,
    autocorrelation, autocorrelation_large_mean, acf, acf_all_lags, pacf, pacf_two_lags,
    adf_test, adf_test_own_lags, adf_one_lag, adf_lag0, column_stack,
    train_test_split, batch_slices, supervised_windows, supervised_windows_padded,
    window_batches, eval_windows, lane_chains, ar_fit, arma_css, arma_bic,
    arma_predict_in_sample, arma_forecast, arma_fit, arma_fit_ar1, arma_fit_ar2, arma_order_search, arma_order_search_configured,
    arma_order_search_ar, corrupt_mask, latent_encode, latent_decode, reconstruction_cost,
    latent_gradient, latent_fit, latent_fit_two_epochs, latent_fit_two_batches, latent_stack_step,
    sequence_forecast, sequence_fit, sequence_cost, mse, mae,
    actual_vs_forecast, arma_day_forecast, arma_day_forecast_ar1, compressed_day_forecast)}
