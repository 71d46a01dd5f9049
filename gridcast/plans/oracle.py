"""The same results as the registered queries, in DuckDB SQL."""

from __future__ import annotations

from gridcast.functions.solvers import ADF_CRITICAL
from gridcast.plans import registered as q

TYPES = "(SELECT list(DISTINCT event_type ORDER BY event_type) FROM events)"
COLUMNS = ("click", "error", "purchase", "signup", "view")    # a wide result must name its columns


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def events(minutes: int = 45) -> str:
    return f"""src AS (SELECT event_type AS cell_id,
        CAST(date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', ts) // {minutes} AS BIGINT) AS t,
        CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM events GROUP BY ALL)"""


REVENUE = """src AS (SELECT CAST(c_nationkey AS VARCHAR) AS cell_id,
        CAST(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS BIGINT) AS t,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

SHIPMENTS = """src AS (SELECT CAST(l_suppkey AS VARCHAR) AS cell_id,
        CAST(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', l_shipdate) // 7 AS BIGINT) AS t,
        CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"""

FILLED = """dense AS (SELECT c.cell_id, g.t, s.v
        FROM (SELECT DISTINCT cell_id FROM src) c
        CROSS JOIN (SELECT unnest(range(0, (SELECT max(t) + 1 FROM src))) AS t) g
        LEFT JOIN src s ON s.cell_id = c.cell_id AND s.t = g.t),
    marks AS (SELECT cell_id, t, v,
        last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
        last_value(v IGNORE NULLS) OVER b AS v0,
        first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1,
        first_value(v IGNORE NULLS) OVER f AS v1
        FROM dense WINDOW
        b AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT cell_id, t, CASE WHEN t0 IS NULL THEN NULL
        WHEN t0 = t OR t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS v
        FROM marks)"""

MINMAX = """scaled AS (SELECT f.cell_id, f.t, CASE WHEN f.v IS NULL THEN NULL
        WHEN m.hi = m.lo THEN 0.0 ELSE (f.v - m.lo) / (m.hi - m.lo) END AS v
        FROM filled f JOIN (SELECT cell_id, min(v) AS lo, max(v) AS hi FROM filled GROUP BY 1) m
        USING (cell_id))"""

SCALED = f"""{FILLED},
    {MINMAX},
    firsts AS (SELECT cell_id, min(t) AS f FROM src GROUP BY 1)"""
TRAFFIC = f"""WITH {events()},
    {SCALED},
    t_start AS (SELECT quantile_disc(f, 0.9) AS s FROM firsts),
    ser AS (SELECT cell_id, t - s AS t, v FROM scaled JOIN firsts USING (cell_id), t_start WHERE f <= s AND t >= s)"""
WEEKLY = f"""WITH {SHIPMENTS},
    {SCALED},
    ser AS (SELECT cell_id, t - f AS t, v FROM scaled JOIN firsts USING (cell_id) WHERE t >= f)"""

ORD = f"(list_position({TYPES}, cell_id) - 1)"


def w(unit: int) -> str:
    return f"(((3 * {ORD} + {5 * unit}) % 7 - 3) / 10.0)"


CELL_BIAS = f"(({ORD} % 3 - 1) / 10.0)"


def sig(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def latent_of(value: str = "v") -> str:
    return ", ".join(f"{sig(f'sum({value} * {w(j)}) + {q.BIAS[j]}')} AS z{j + 1}" for j in range(2))


LATENT = f"lat AS (SELECT t, {latent_of()} FROM ser GROUP BY t)"
FEATURES = f"""{TRAFFIC},
    {LATENT},
    feat AS (SELECT t, v AS y, z1, z2 FROM ser JOIN lat USING (t) WHERE cell_id = '{q.TARGET}'),
    n AS (SELECT max(t) + 1 AS n FROM feat)"""
T = q.STEPS
WINDOWS = f"""{FEATURES},
    win AS (SELECT a.t - s.step AS window_id, s.step, a.y, a.z1, a.z2, b.y AS target
        FROM feat a JOIN feat b ON b.t = a.t + {T}
        CROSS JOIN (SELECT unnest(range(0, {T})) AS step) s, n
        WHERE a.t - s.step >= 0 AND a.t - s.step < n.n - {2 * T})"""
PER_WINDOW = "count(*) AS n, " + ", ".join(
    r(f"sum((step + 1) * {c})", c) for c in ("y", "z1", "z2", "target"))
BATCHED = f"""{WINDOWS},
    bat AS (SELECT window_id // {q.CFG.lanes} AS batch_id, window_id % {q.CFG.lanes} AS lane, *
        FROM win WHERE window_id < {q.CFG.lanes * q.CFG.batches})"""

PAIRS = "count(*) AS n, sum(x) AS sx, sum(y) AS sy"
PEARSON = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"

RESIDUALS = f"""u AS (SELECT cell_id, t, v, CASE WHEN t < {len(q.PHI)} THEN 0.0 ELSE (v - {q.MU})
        {"".join(f" - ({f}) * (lag(v, {i}) OVER (PARTITION BY cell_id ORDER BY t) - {q.MU})"
                 for i, f in enumerate(q.PHI, 1))} END AS u FROM ser),
    res AS (SELECT cell_id, t, v, u AS e FROM u WHERE t = 0
        UNION ALL
        SELECT u.cell_id, u.t, u.v,
            CASE WHEN u.t < {len(q.PHI)} THEN 0.0 ELSE u.u - {q.THETA[0]} * res.e END
        FROM res JOIN u ON u.cell_id = res.cell_id AND u.t = res.t + 1)"""
CSS_RECURSIVE = WEEKLY.replace("WITH ", "WITH RECURSIVE ", 1) + f",\n    {RESIDUALS}"
P, Q = len(q.PHI), len(q.THETA)
CSS = f"""css AS (SELECT cell_id, sum(e * e) AS sse, count(*) AS n FROM res WHERE t >= {P} GROUP BY 1)"""


def bic(sse: str, n: str, p: int, k: int) -> str:
    return f"({n} * ln(2 * pi()) + {n} * ln({sse} / {n}) + {n} + ln({n}) * {p + k + 2})"


def ar1(where: str = "") -> str:
    return f"""lagged AS (SELECT cell_id, t, v, lag(v) OVER (PARTITION BY cell_id ORDER BY t) AS x
        FROM ser {where}),
    fit AS (SELECT cell_id, count(*) AS n, regr_slope(v, x) AS phi,
        regr_intercept(v, x) / (1 - regr_slope(v, x)) AS mu,
        regr_syy(v, x) - regr_sxy(v, x) ** 2 / regr_sxx(v, x) AS sse
        FROM lagged WHERE x IS NOT NULL GROUP BY 1)"""


FORECAST = f"""{WEEKLY},
    {ar1(f"WHERE t < {q.TRAIN_WEEKS}")},
    pred AS (SELECT s.cell_id, s.t, s.v AS y,
        f.mu + f.phi ** (s.t - {q.TRAIN_WEEKS} + 1) * (l.v - f.mu) AS yhat
        FROM ser s JOIN fit f USING (cell_id)
        JOIN ser l ON l.cell_id = s.cell_id AND l.t = {q.TRAIN_WEEKS - 1}
        WHERE s.t >= {q.TRAIN_WEEKS})"""

LAGS = f"""{WEEKLY},
    lags AS (SELECT a.cell_id, a.t - b.t AS lag, a.v AS x, b.v AS y
        FROM ser a JOIN ser b ON a.cell_id = b.cell_id AND a.t - b.t BETWEEN 0 AND 12)"""
ACF = f"""{LAGS},
    mean AS (SELECT cell_id, avg(v) AS m, count(*) AS n, sum(v * v) - count(*) * avg(v) ** 2 AS c0
        FROM ser GROUP BY 1),
    acf AS (SELECT l.cell_id, l.lag, sum((x - m) * (y - m)) / max(c0) AS r, max(n) AS n
        FROM lags l JOIN mean USING (cell_id) GROUP BY 1, 2)"""

BIT = f"((7 * t + 13 * {ORD} + 5) % 2)"
GRADIENT = f"""{TRAFFIC},
    h AS (SELECT t, {latent_of(f"v * {BIT}")} FROM ser GROUP BY t),
    dec AS (SELECT cell_id, t, v, v * {BIT} AS xm, {w(0)} AS w0, {w(1)} AS w1, z1, z2,
        {sig(f"z1 * {w(0)} + z2 * {w(1)} + {CELL_BIAS}")} AS y FROM ser JOIN h USING (t)),
    del AS (SELECT *, 2 * (y - v) * y * (1 - y) AS dy FROM dec),
    back AS (SELECT t, sum(dy * w0) * max(z1) * (1 - max(z1)) AS d0,
        sum(dy * w1) * max(z2) * (1 - max(z2)) AS d1 FROM del GROUP BY t)"""



def epoch(i: int, slots: str = "true", rate: str = "") -> str:
    """One step of training on some slots: weights w{i} (per cell) and b{i} become those of i + 1."""
    rate = rate or f"{q.CFG.latent_lr} * least({q.CFG.latent_batch}, count(DISTINCT t)) / count(DISTINCT t)"
    z = [f"1.0 / (1.0 + exp(-(sum(v * bit * w{j}) + any_value(b{j}))))" for j in range(2)]
    return f"""x{i} AS (SELECT cell_id, t, v, {BIT} AS bit, w0, w1, c, b0, b1 FROM ser JOIN w{i} USING (cell_id), b{i} WHERE {slots}),
        h{i} AS (SELECT t, {z[0]} AS z0, {z[1]} AS z1 FROM x{i} GROUP BY t),
        y{i} AS (SELECT *, {sig("z0 * w0 + z1 * w1 + c")} AS y FROM x{i} JOIN h{i} USING (t)),
        d{i} AS (SELECT *, 2 * (y - v) * y * (1 - y) AS dy FROM y{i}),
        k{i} AS (SELECT t, sum(dy * w0) * max(z0) * (1 - max(z0)) AS d0, sum(dy * w1) * max(z1) * (1 - max(z1)) AS d1,
            sum((y - v) ** 2) AS cost FROM d{i} GROUP BY t),
        s{i} AS (SELECT {rate} AS lr FROM ser),
        w{i + 1} AS (SELECT cell_id, any_value(w0) - any_value(lr) * sum(v * bit * d0 + dy * z0) AS w0,
            any_value(w1) - any_value(lr) * sum(v * bit * d1 + dy * z1) AS w1,
            any_value(c) - any_value(lr) * sum(dy) AS c FROM d{i} JOIN k{i} USING (t), s{i} GROUP BY cell_id),
        b{i + 1} AS (SELECT any_value(b0) - any_value(lr) * sum(d0) AS b0, any_value(b1) - any_value(lr) * sum(d1) AS b1
            FROM k{i}, b{i}, s{i})"""


def _stack() -> str:
    """One step of a stack of 3 and 2 units on the first batch of slots."""
    js, ks, lr = range(3), range(2), q.CFG.latent_lr
    bias, v = (*q.BIAS, 0.05), [[q.encoder_weight(j + 1, k) for k in range(2)] for j in range(3)]
    plus = " + ".join
    z = ", ".join(f"{sig(f'sum(v * bit * w{j}) + ({bias[j]})')} AS z{j}" for j in js)
    inner = ", ".join(sig(plus(f"z{j} * ({v[j][k]})" for j in js) + f" + ({q.STACK_BIAS[k]})") + f" AS q{k}" for k in ks)
    back = ", ".join(sig(plus(f"q{k} * ({v[j][k]})" for k in ks) + f" + ({q.STACK_BACK[j]})") + f" AS u{j}" for j in js)
    y = sig(plus(f"u{j} * w{j}" for j in js) + " + c")
    du = ", ".join(f"sum(dy * w{j}) * max(u{j}) * (1 - max(u{j})) AS du{j}" for j in js)
    dq = ", ".join(f"({plus(f'du{j} * ({v[j][k]})' for j in js)}) * q{k} * (1 - q{k}) AS dq{k}" for k in ks)
    dz = ", ".join(f"({plus(f'dq{k} * ({v[j][k]})' for k in ks)}) * z{j} * (1 - z{j}) AS dz{j}" for j in js)
    own = ", ".join([r(f"any_value(w{j}) - {lr} * sum(v * bit * dz{j} + dy * u{j})", f"w{j}") for j in js] + [r(f"any_value(c) - {lr} * sum(dy)", "c")])
    told = [r(f"{bias[j]} - {lr} * sum(dz{j})", f"b{j}") for j in js] + [r(f"{q.STACK_BIAS[k]} - {lr} * sum(dq{k})", f"e{k}") for k in ks]
    told += [r(f"{q.STACK_BACK[j]} - {lr} * sum(du{j})", f"f{j}") for j in js] + [r("sum(cost)", "cost")]
    told += [r(f"{v[j][k]} - {lr} * sum(z{j} * dq{k} + du{j} * q{k})", f"v{j}{k}") for j in js for k in ks]
    return f"""{TRAFFIC}, x AS (SELECT cell_id, t, v, {BIT} AS bit, {", ".join(f"{w(j)} AS w{j}" for j in js)}, {CELL_BIAS} AS c
            FROM ser WHERE t < {q.CFG.latent_batch}),
        h AS (SELECT t, {z} FROM x GROUP BY t), g AS (SELECT *, {inner} FROM h), u AS (SELECT *, {back} FROM g),
        y AS (SELECT *, {y} AS y FROM x JOIN u USING (t)), d AS (SELECT *, 2 * (y - v) * y * (1 - y) AS dy FROM y),
        k AS (SELECT t, {du}, sum((y - v) ** 2) AS cost FROM d GROUP BY t),
        m AS (SELECT *, {dq} FROM u JOIN k USING (t)), n AS (SELECT *, {dz} FROM m),
        cells AS (SELECT cell_id, {own} FROM d JOIN (SELECT t, {", ".join(f"dz{j}" for j in js)} FROM n) USING (t) GROUP BY cell_id),
        shared AS (SELECT {", ".join(told)} FROM n)
        SELECT * FROM cells, shared"""


LON, LAT = "118.70 + 0.0123457 * n_nationkey", "32.01 + 0.0034569 * n_nationkey"


def decimal_text(x: str) -> str:
    return (f"regexp_replace(CAST(CAST(round({x}, 5) AS DECIMAL(9, 5)) AS VARCHAR), "
            r"'(\.\d+?)0+$', '\1')")


def per_type(expr: str) -> str:
    return ", ".join(expr.format(t=t) for t in COLUMNS)


SQL = {
    "scan_cells": f"""SELECT CAST(n_nationkey AS INTEGER) AS ord, {r(f"CAST({LON} AS DOUBLE)", "lon", 8)},
        {r(f"CAST({LAT} AS DOUBLE)", "lat", 8)},
        {decimal_text(LAT)} || '_' || {decimal_text(LON)} AS cell_id FROM nation""",
    "scan_traffic_wide": f"""WITH {events()}, {FILLED} SELECT t, {per_type(
        "round(max(CASE WHEN cell_id = '{t}' THEN v END), 6) + 0.0 AS {t}")} FROM dense GROUP BY t""",
    "reindex_cells": f"""WITH {SHIPMENTS}, listed AS (
        SELECT CAST(s_suppkey AS VARCHAR) AS cell_id FROM supplier WHERE s_acctbal >= 0
        UNION ALL SELECT CAST(max(s_suppkey) + 1 AS VARCHAR) FROM supplier)
        SELECT l.cell_id, g.t, s.v FROM listed l
        CROSS JOIN (SELECT unnest(range(0, (SELECT max(t) + 1 FROM src))) AS t) g
        LEFT JOIN src s ON s.cell_id = l.cell_id AND s.t = g.t""",
    "time_grid": f"""WITH {events(15)} SELECT t, strftime(TIMESTAMP '{q.GRID_START}'
        + to_minutes(t * 15), '%Y-%m-%d %H:%M:%S') AS ts, {r("sum(v)", "v")} FROM src GROUP BY t""",
    "wide_to_long": f"""WITH {events()} SELECT c.cell_id, g.t, s.v
        FROM (SELECT unnest({TYPES}) AS cell_id) c CROSS JOIN (SELECT DISTINCT t FROM src) g
        LEFT JOIN src s ON s.cell_id = c.cell_id AND s.t = g.t""",
    "long_to_wide": f"""WITH {events()} SELECT t, {per_type(
        "max(CASE WHEN cell_id = '{t}' THEN v END) AS {t}")} FROM src GROUP BY t""",
    "select_target": f"WITH {events()} SELECT * FROM src WHERE cell_id = '{q.TARGET}'",
    "write_series": f"""WITH {events()} SELECT t, strftime(TIMESTAMP '{q.GRID_START}'
        + to_minutes(t * 45), '%Y-%m-%d %H:%M:%S') AS ts, v FROM src WHERE cell_id = '{q.TARGET}'""",
    "drop_sparse_cells": f"""WITH {events()} SELECT * FROM src WHERE cell_id IN (
        SELECT cell_id FROM src GROUP BY 1 HAVING count(v) >= (
        SELECT ceil(avg(n)) FROM (SELECT count(v) AS n FROM src GROUP BY cell_id)))""",
    "interpolate_linear": f"WITH {REVENUE}, {FILLED} SELECT cell_id, t, v FROM filled",
    "minmax_scale": f"WITH {REVENUE}, {FILLED}, {MINMAX} SELECT cell_id, t, v FROM scaled",
    "tanh_scale_columns": f"""WITH {REVENUE} SELECT cell_id, t, {r(
        "0.5 * (tanh(0.01 * (v - m) / s) + 1)", "v")} FROM src JOIN (SELECT cell_id, avg(v) AS m,
        stddev_pop(v) AS s FROM src GROUP BY 1) USING (cell_id)""",
    "tanh_scale_global": f"""WITH {REVENUE} SELECT cell_id, t, {r(
        "0.5 * (tanh(0.01 * (v - m) / s) + 1)", "v")}
        FROM src, (SELECT avg(v) AS m, stddev_pop(v) AS s FROM src)""",
    "first_difference": f"""{WEEKLY} SELECT cell_id, t,
        v - lag(v) OVER (PARTITION BY cell_id ORDER BY t) AS v FROM ser""",
    "sigmoid_affine": f"{TRAFFIC}, {LATENT} SELECT t, {r('z1', 'z1')}, {r('z2', 'z2')} FROM lat",
    "spatial_corr": f"""WITH {SHIPMENTS}, pair AS (SELECT a.cell_id AS cell_a, b.cell_id AS cell_b,
        a.v AS x, b.v AS y FROM src a JOIN src b USING (t))
        SELECT cell_a, cell_b, {r(PEARSON, "r")}, count(*) AS n FROM pair GROUP BY 1, 2""",
    "spatial_corr_strong": f"""WITH {SHIPMENTS},
    {SCALED},
    t_start AS (SELECT quantile_disc(f, 0.9) AS s FROM firsts),
    ser AS (SELECT cell_id, t - s AS t, v FROM scaled JOIN firsts USING (cell_id), t_start WHERE f <= s AND t >= s),
    pair AS (SELECT a.cell_id AS cell_a, b.cell_id AS cell_b, a.v AS x, b.v AS y FROM ser a JOIN ser b USING (t)),
    corr AS (SELECT cell_a, cell_b, {PEARSON} AS r, count(*) AS n FROM pair GROUP BY 1, 2)
        SELECT cell_a, cell_b, {r("r", "r")}, n FROM corr WHERE abs(r) >= {q.STRONG}""",
    "autocorrelation": f"""{LAGS} SELECT cell_id, lag, {r(PEARSON, "r")} FROM lags
        WHERE lag > 0 GROUP BY 1, 2""",
    "autocorrelation_large_mean": f"""WITH {SHIPMENTS}, lags AS (SELECT a.cell_id, a.t - b.t AS lag, a.v AS x, b.v AS y
        FROM src a JOIN src b ON a.cell_id = b.cell_id AND a.t - b.t BETWEEN 1 AND 12)
        SELECT cell_id, lag, {r(PEARSON, "r")} FROM lags GROUP BY 1, 2""",
    "pacf": f"""{ACF.replace("WITH ", "WITH RECURSIVE ", 1)},
        rs AS (SELECT cell_id, list(r ORDER BY lag) AS r FROM acf GROUP BY 1),
        dl AS (SELECT cell_id, 1 AS k, r, [r[2]] AS phi FROM rs
            UNION ALL SELECT cell_id, k + 1, r, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - new * phi[k + 1 - j]), new)
            FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
                / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS new FROM dl WHERE k < 12))
        SELECT cell_id, CAST(0 AS BIGINT) AS lag, 1.0 AS r FROM rs
        UNION ALL SELECT cell_id, CAST(k AS BIGINT), {r("phi[k]", "r")} FROM dl""",
    "acf": f"""{ACF} SELECT cell_id, lag, {r("r", "r")}, round(CASE WHEN lag = 0 THEN 0 ELSE 1.96 * sqrt(
        (1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN r * r END) OVER (PARTITION BY cell_id ORDER BY lag
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END, 6) + 0.0 AS band FROM acf""",
    "pacf_two_lags": f"""{ACF}, k AS (SELECT cell_id, max(CASE WHEN lag = 1 THEN r END) AS r1,
        max(CASE WHEN lag = 2 THEN r END) AS r2 FROM acf GROUP BY 1)
        SELECT cell_id, lag, {r("CASE lag WHEN 0 THEN 1 WHEN 1 THEN r1 ELSE (r2 - r1 * r1) / (1 - r1 * r1) END",
        "r")} FROM k CROSS JOIN (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS lag)""",
    "acf_all_lags": f"""{WEEKLY}, c AS (SELECT cell_id, t, v - avg(v) OVER (PARTITION BY cell_id) AS v FROM ser),
        s AS (SELECT a.cell_id, a.t - b.t AS lag, sum(a.v * b.v) AS s FROM c a JOIN c b ON a.cell_id = b.cell_id AND a.t >= b.t GROUP BY 1, 2),
        z AS (SELECT cell_id, sum(v * v) AS c0, count(*) AS n FROM c GROUP BY 1),
        a AS (SELECT s.cell_id, lag, CASE WHEN c0 > 0 THEN s / c0 END AS r, n FROM s JOIN z USING (cell_id))
        SELECT cell_id, lag, {r("r", "r")}, round(CASE WHEN lag = 0 THEN 0 ELSE 1.96 * sqrt(
        (1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN r * r END) OVER (PARTITION BY cell_id ORDER BY lag
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END, 6) + 0.0 AS band FROM a""",
    "adf_one_lag": f"""{WEEKLY}, d AS (SELECT cell_id, v - x AS d, x, x - lag(x) OVER w AS z FROM (
            SELECT cell_id, t, v, lag(v) OVER (PARTITION BY cell_id ORDER BY t) AS x FROM ser) WINDOW w AS (PARTITION BY cell_id ORDER BY t)),
        s AS (SELECT cell_id, count(*) AS n, regr_sxx(d, x) AS xx, regr_sxx(d, z) AS zz, regr_sxy(x, z) AS xz, regr_sxy(d, x) AS xd,
            regr_sxy(d, z) AS zd, regr_syy(d, x) AS dd FROM d WHERE z IS NOT NULL GROUP BY 1),
        b AS (SELECT *, (xd * zz - zd * xz) / (xx * zz - xz * xz) AS b1, (zd * xx - xd * xz) / (xx * zz - xz * xz) AS b2 FROM s),
        f AS (SELECT *, dd - xd * xd / xx AS sse0, dd - b1 * xd - b2 * zd AS sse1 FROM b),
        l AS (SELECT *, CASE WHEN n * ln(sse1 / n) + 6 < n * ln(sse0 / n) + 4 THEN 1 ELSE 0 END AS lag FROM f),
        o AS (SELECT cell_id, count(*) AS n0, regr_slope(d, x) / sqrt((regr_syy(d, x) - regr_sxy(d, x) ** 2 / regr_sxx(d, x))
            / (count(*) - 2) / regr_sxx(d, x)) AS stat0 FROM d WHERE x IS NOT NULL GROUP BY 1),
        c AS (SELECT cell_id, CAST(lag AS BIGINT) AS used_lag, CASE lag WHEN 1 THEN n ELSE n0 END AS n_obs,
            CASE lag WHEN 1 THEN b1 / sqrt(sse1 / (n - 3) * zz / (xx * zz - xz * xz)) ELSE stat0 END AS stat FROM l JOIN o USING (cell_id))
        SELECT cell_id, {r("stat", "stat")}, used_lag, n_obs, {", ".join(r(" + ".join(f"({x}) / n_obs ** {i}" for i, x in enumerate(row)), name)
            for row, name in zip(ADF_CRITICAL, ("crit_1", "crit_5", "crit_10")))} FROM c""",
    "adf_lag0": f"""{WEEKLY}, d AS (SELECT cell_id, v - lag(v) OVER w AS d, lag(v) OVER w AS x FROM ser
        WINDOW w AS (PARTITION BY cell_id ORDER BY t))
        SELECT cell_id, {r('''regr_slope(d, x) / sqrt((regr_syy(d, x) - regr_sxy(d, x) ** 2
        / regr_sxx(d, x)) / (count(*) - 2) / regr_sxx(d, x))''', "stat")}, count(*) AS n_obs
        FROM d WHERE x IS NOT NULL GROUP BY 1""",
    "column_stack": f"{FEATURES} SELECT t, {r('y', 'y')}, {r('z1', 'z1')}, {r('z2', 'z2')} FROM feat",
    "train_test_split": f"""{WEEKLY} SELECT cell_id, t, {r("v", "v")},
        CASE WHEN t < {q.TRAIN_WEEKS} THEN 'train' ELSE 'test' END AS part FROM ser""",
    "batch_slices": f"""{TRAFFIC} SELECT t // {q.CFG.latent_batch} AS batch_id, cell_id, count(*) AS n,
        {r("sum(v)", "total")} FROM ser WHERE t < {q.CFG.latent_batch * q.CFG.latent_batches}
        GROUP BY 1, 2""",
    "supervised_windows": f"{WINDOWS} SELECT window_id, {PER_WINDOW} FROM win GROUP BY 1",
    "supervised_windows_padded": f"""{WINDOWS}, pad AS (SELECT * FROM win UNION ALL
        SELECT unnest(range(n - {2 * T}, n - {T})), step, 0, 0, 0, 0
        FROM n CROSS JOIN (SELECT unnest(range(0, {T})) AS step))
        SELECT window_id, {PER_WINDOW} FROM pad GROUP BY 1""",
    "window_batches": f"""{BATCHED} SELECT batch_id, lane, window_id, {PER_WINDOW} FROM bat
        GROUP BY 1, 2, 3""",
    "eval_windows": f"""{WINDOWS} SELECT window_id, step, {r("y", "y")}, {r("z1", "z1")},
        {r("z2", "z2")}, {r("target", "target")} FROM win WHERE window_id IN (
        SELECT unnest(range({q.CFG.evaluate[0]}, {q.CFG.evaluate[1]},
        {q.CFG.evaluate[2] * q.CFG.evaluate[3]})))""",
    "lane_chains": f"""{BATCHED} SELECT batch_id, lane, window_id,
        lag(window_id) OVER (PARTITION BY lane ORDER BY batch_id) AS prev_window_id
        FROM bat WHERE step = 0""",
    "ar_fit": f"""{WEEKLY}, {ar1()} SELECT cell_id, CAST(1 AS BIGINT) AS p, CAST(0 AS BIGINT) AS q,
        {r("mu", "mu")}, {r("phi", "phi_1")}, {r("sse", "sse")}, n, {r("sse / n", "sigma2")},
        {r(bic("sse", "n", 1, 0), "bic")} FROM fit""",
    "arma_css": f"""{CSS_RECURSIVE}, {CSS} SELECT cell_id, CAST({P} AS BIGINT) AS p,
        CAST({Q} AS BIGINT) AS q, {r("sse", "sse")}, n, {r("sse / n", "sigma2")} FROM css""",
    "arma_bic": f"""{CSS_RECURSIVE}, {CSS} SELECT cell_id, CAST({P} AS BIGINT) AS p,
        CAST({Q} AS BIGINT) AS q, {r(bic("sse", "n", P, Q), "bic")} FROM css""",
    "arma_predict_in_sample": f"""{CSS_RECURSIVE} SELECT cell_id, t, {r("v - e", "yhat")} FROM res
        WHERE t >= {P}""",
    "arma_forecast": f"""{CSS_RECURSIVE},
        fin AS (SELECT res.cell_id, res.t, res.v, res.e, p.v AS v_prev FROM res
            JOIN ser p ON p.cell_id = res.cell_id AND p.t = res.t - 1
            WHERE (res.cell_id, res.t) IN (SELECT cell_id, max(t) FROM ser GROUP BY 1)),
        fc AS (SELECT cell_id, t, v AS a, v_prev AS b, e, 0 AS h FROM fin
            UNION ALL SELECT cell_id, t + 1, {q.MU} + {q.PHI[0]} * (a - {q.MU})
            + ({q.PHI[1]}) * (b - {q.MU}) + {q.THETA[0]} * e, a, 0.0, h + 1 FROM fc WHERE h < 52)
        SELECT cell_id, t, {r("a", "yhat")} FROM fc WHERE h > 0""",
    "arma_fit_ar1": f"""{WEEKLY}, {ar1()} SELECT cell_id, CAST(1 AS BIGINT) AS p,
        CAST(0 AS BIGINT) AS q, {r("mu", "mu")}, {r("phi", "phi_1")}, {r("sse", "sse")}, n,
        {r(bic("sse", "n", 1, 0), "bic")} FROM fit""",
    "arma_fit_ar2": f"""{WEEKLY}, lagged AS (SELECT cell_id, v AS y, lag(v) OVER w AS x, lag(v, 2) OVER w AS z FROM ser
            WINDOW w AS (PARTITION BY cell_id ORDER BY t)),
        s AS (SELECT cell_id, count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, regr_sxx(y, x) AS xx, regr_sxx(y, z) AS zz,
            regr_sxy(x, z) AS xz, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy, regr_syy(y, x) AS yy FROM lagged WHERE z IS NOT NULL GROUP BY 1),
        b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS phi1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS phi2 FROM s),
        fit AS (SELECT *, (my - phi1 * mx - phi2 * mz) / (1 - phi1 - phi2) AS mu, yy - phi1 * xy - phi2 * zy AS sse FROM b)
        SELECT cell_id, CAST(2 AS BIGINT) AS p, CAST(0 AS BIGINT) AS q, {r("mu", "mu")}, {r("phi1", "phi_1")}, {r("phi2", "phi_2")},
        {r("sse", "sse")}, n, {r(bic("sse", "n", 2, 0), "bic")} FROM fit""",
    "arma_order_search_ar": f"""{WEEKLY}, {ar1()},
        fits AS (SELECT cell_id, 1 AS p, n, {bic("sse", "n", 1, 0)} AS bic FROM fit UNION ALL
            SELECT cell_id, 0, n, {bic("sse", "n", 0, 0)} FROM (SELECT cell_id, count(*) AS n,
            count(*) * var_pop(v) AS sse FROM ser GROUP BY 1))
        SELECT cell_id, CAST(arg_min(p, bic) AS BIGINT) AS p, CAST(0 AS BIGINT) AS q,
        arg_min(n, bic) AS n, {r("min(bic)", "bic")} FROM fits GROUP BY 1""",
    "corrupt_mask": f"{TRAFFIC} SELECT cell_id, t, {r(f'v * {BIT} * 0.75 + v * 0.25', 'v')} FROM ser",
    "latent_encode": f"""{TRAFFIC}, {LATENT} SELECT t, CAST(unit AS BIGINT) AS unit,
        {r("CASE unit WHEN 0 THEN z1 ELSE z2 END", "z")}
        FROM lat CROSS JOIN (SELECT unnest([0, 1]) AS unit)""",
    "latent_decode": f"""{TRAFFIC}, {LATENT} SELECT t, cell_id, {r(
        sig(f"z1 * {w(0)} + z2 * {w(1)} + {CELL_BIAS}"), "y")} FROM ser JOIN lat USING (t)""",
    "reconstruction_cost": f"""{TRAFFIC}, {LATENT} SELECT {r("sum((y - v) ** 2)", "cost")} FROM (
        SELECT v, {sig(f"z1 * {w(0)} + z2 * {w(1)} + {CELL_BIAS}")} AS y FROM ser JOIN lat USING (t))""",
    "latent_gradient": f"""{GRADIENT},
        g AS (SELECT cell_id, sum(xm * d0 + dy * z1) AS g0, sum(xm * d1 + dy * z2) AS g1,
            sum(dy) AS gc FROM del JOIN back USING (t) GROUP BY 1),
        b AS (SELECT sum(d0) AS d0, sum(d1) AS d1 FROM back)
        SELECT 'w' AS param, cell_id, CAST(0 AS BIGINT) AS unit, {r("g0", "g")} FROM g
        UNION ALL SELECT 'w', cell_id, 1, {r("g1", "g")} FROM g
        UNION ALL SELECT 'c', cell_id, 0, {r("gc", "g")} FROM g
        UNION ALL SELECT 'b', '', 0, {r("d0", "g")} FROM b
        UNION ALL SELECT 'b', '', 1, {r("d1", "g")} FROM b
        UNION ALL SELECT 'cost', '', 0, {r("sum((y - v) ** 2)", "g")} FROM dec""",
    "latent_fit_two_epochs": f"""{TRAFFIC},
        w0 AS (SELECT cell_id, {w(0)} AS w0, {w(1)} AS w1, {CELL_BIAS} AS c FROM (SELECT DISTINCT cell_id FROM ser)),
        b0 AS (SELECT {q.BIAS[0]} AS b0, {q.BIAS[1]} AS b1), {epoch(0)}, {epoch(1)}
        SELECT cell_id, {r("w2.w0", "w0")}, {r("w2.w1", "w1")}, {r("c", "c")}, {r("b2.b0", "b0")}, {r("b2.b1", "b1")},
            {r("(SELECT sum(cost) FROM k1)", "cost")} FROM w2, b2""",
    "latent_fit_two_batches": f"""{TRAFFIC},
        w0 AS (SELECT cell_id, {w(0)} AS w0, {w(1)} AS w1, {CELL_BIAS} AS c FROM (SELECT DISTINCT cell_id FROM ser)),
        b0 AS (SELECT {q.BIAS[0]} AS b0, {q.BIAS[1]} AS b1),
        {epoch(0, f"t < {q.CFG.latent_batch}", f"any_value({q.CFG.latent_lr})")},
        {epoch(1, f"t // {q.CFG.latent_batch} = 1", f"any_value({q.CFG.latent_lr})")}
        SELECT cell_id, {r("w2.w0", "w0")}, {r("w2.w1", "w1")}, {r("c", "c")}, {r("b2.b0", "b0")}, {r("b2.b1", "b1")},
            {r("(SELECT sum(cost) FROM k0) + (SELECT sum(cost) FROM k1)", "cost")} FROM w2, b2""",
    "latent_stack_step": _stack(),
    "sequence_cost": f"""{WINDOWS} SELECT {r(
        "sum((y - target) ** 2) / count(DISTINCT window_id)", "cost")} FROM win""",
    "mse": f"{FORECAST} SELECT cell_id, {r('avg((y - yhat) ** 2)', 'mse')} FROM pred GROUP BY 1",
    "mae": f"{FORECAST} SELECT cell_id, {r('avg(abs(y - yhat))', 'mae')} FROM pred GROUP BY 1",
    "arma_day_forecast_ar1": f"""{FORECAST} SELECT cell_id, {r('avg((y - yhat) ** 2)', 'mse')}, {r('avg(abs(y - yhat))', 'mae')}
        FROM pred GROUP BY 1""",
    "actual_vs_forecast": f"""{FORECAST} SELECT cell_id, t, {r("y", "y")}, {r("yhat", "yhat")}
        FROM pred ORDER BY cell_id, t""",
}
