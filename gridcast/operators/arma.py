"""ARMA models over many series and many orders.

The residual recursion e_t = u_t - sum theta_j e_{t-j} is linear in its state, the last
q residuals. A packed block therefore maps its start state to its end state by
``A^len s + c``, where ``c`` comes from running the block once with a zero state. Folding
these maps (blocks, then groups of blocks) gives every block its exact start state, and a
second run is then parallel over blocks. The Jacobian is the same recursion with other
inputs, so its columns travel in the same states. Series of up to ``IN_TASK`` slots are
fitted within a task, longer ones over their blocks: the same start, steps and stopping rule.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions import solvers
from gridcast.functions.scale_out import (BLOCK, FAN_IN, div, lookup_join, map_rows, pack_blocks,
                                          row_groups, settle, spread, spread_out)
from gridcast.operators.stats import series_summary

BROADCAST_MODELS = 100_000   # a model is under 1 kB
TOGETHER = 1 << 19         # values of the series that one batch of a task fits together
FEW = 8                    # fewer series of about one length are fitted one by one
TRIALS = 8                 # steps tried in one pass after one without gain
IN_TASK = 32_768           # longest series fitted inside one task; the result does not depend on it
PARAMS = "cell_id STRING, p INT, q INT, mu DOUBLE, phi ARRAY<DOUBLE>, theta ARRAY<DOUBLE>"
ROWS_OF_STATES = "ARRAY<ARRAY<DOUBLE>>"


def _bic(sse: Column, n: Column, p: Column, q: Column) -> Column:
    sigma2 = sse / n
    llf = -n / 2 * (F.lit(math.log(2 * math.pi)) + F.ln(sigma2)) - sse / (F.lit(2.0) * sigma2)
    return F.when(sse > 0, F.lit(-2.0) * llf + F.ln(n) * (p + q + 2))


def arma_bic(css: DataFrame) -> DataFrame:
    """Add ``bic`` to ``(p, q, sse, n, ...)``; n counts the slots after the first p."""
    return css.withColumn("bic", _bic(F.col("sse"), F.col("n"), F.col("p"), F.col("q")))


def ar_fit(df: DataFrame, p: int, size: int = BLOCK) -> DataFrame:
    """ARMA(p, 0) by conditional least squares: one pass for the lag sums, then p+1 equations."""
    def solve(row):
        if row.n > 2 * p + 2:
            mu, phi, sse = solvers.ar_from_summary(int(row.n), row.total, row.cross, row.head,
                                                   row.tail, p)
            yield row.cell_id, p, 0, mu + row.centre, phi, [], sse, int(row.n) - p, sse / (row.n - p)
        else:                                  # too short: no model
            yield row.cell_id, p, 0, None, None, None, None, int(row.n), None

    fits = map_rows(series_summary(df, p, size), solve,
                    f"{PARAMS}, sse DOUBLE, n BIGINT, sigma2 DOUBLE")
    return arma_bic(fits)


# --- the blocked recursion -------------------------------------------------------------


def _bundle(params: DataFrame) -> DataFrame:
    """``(cell_id, models)``, settled: all models of a cell in one row."""
    return settle(params.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct(
        *[c for c in params.columns if c != "cell_id"]))).alias("models")))


def _blocks_with_models(df: DataFrame, models: DataFrame, size: int) -> tuple[DataFrame, int, int]:
    """Packed blocks, each with the models of its cell."""
    halo, most = models.agg(F.max(F.array_max("models.p")), F.max(F.size("models"))).first()
    halo = halo or 0
    size = max(size, halo)
    blocks = lookup_join(pack_blocks(df, size, halo), models, "cell_id", salt_by="blk",
                         max_rows=BROADCAST_MODELS // (most or 1), settled=True)
    return blocks, size, halo


def _block_inputs(row, size: int, halo: int):
    """Per model: (model, AR-filtered block); nothing for a block that is all halo."""
    body = int(max(row.off)) + 1 - halo
    if body <= 0:
        return
    x = spread_out(row.off, row.x, halo + body)
    for m in row.models:
        yield m, solvers.innovations_input(x, halo, int(row.blk) * size, m["mu"],
                                           np.asarray(m["phi"], float))


def _fold(states: list[np.ndarray], thetas, length: int, ends) -> list[np.ndarray]:
    return [solvers.carried(s, th, length) + np.asarray(e, float) for s, th, e in zip(states, thetas, ends)]


def _zero_states(parts) -> list[np.ndarray]:
    return [np.zeros(len(e)) for e in parts[0]["ends"]]


def _block_ends(blocks: DataFrame, size: int, halo: int) -> DataFrame:
    def run(row):
        ends, thetas, length = [], [], 0
        for m, u in _block_inputs(row, size, halo):
            th = np.asarray(m["theta"], float)
            e = solvers.ma_filter(u[:, None], th, np.zeros((len(th), 1)))[:, 0]
            ends.append(np.concatenate([e[::-1][:len(th)], np.zeros(max(len(th) - len(e), 0))]))
            thetas.append(th)
            length = len(u)
        if length:
            yield row.cell_id, row.blk, length, ends, thetas

    return map_rows(blocks, run, f"cell_id STRING, blk BIGINT, len BIGINT, "
                                 f"ends {ROWS_OF_STATES}, thetas {ROWS_OF_STATES}")


def _grouped(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(order, "len", "ends"))).alias("parts"),
        F.first("thetas").alias("thetas"))


def _carry(ends: DataFrame, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """``(cell_id, blk, start)`` and ``(cell_id, final)`` from the zero-state ends."""
    grp = F.coalesce(div("blk", fan_in), F.lit(0).cast("bigint"))
    groups = _grouped(ends.filter(F.col("cell_id").isNotNull()).withColumn("grp", grp),
                      ["cell_id", "grp"], "blk")

    def close(row):
        s, length = _zero_states(row.parts), 0
        for part in row.parts:
            s = _fold(s, row.thetas, int(part["len"]), part["ends"])
            length += int(part["len"])
        yield row.cell_id, row.grp, length, s, row.thetas

    closed = map_rows(groups, close, f"cell_id STRING, grp BIGINT, len BIGINT, "
                                     f"ends {ROWS_OF_STATES}, thetas {ROWS_OF_STATES}")
    tops = _grouped(closed, ["cell_id"], "grp")

    def top(row):
        s = _zero_states(row.parts)
        for part in row.parts:
            yield row.cell_id, part["grp"], s
            s = _fold(s, row.thetas, int(part["len"]), part["ends"])
        yield row.cell_id, None, s

    starts = map_rows(tops, top, f"cell_id STRING, grp BIGINT, at {ROWS_OF_STATES}")

    def inside(row):
        s = row.at
        for part in row.parts:
            yield row.cell_id, part["blk"], s
            s = _fold(s, row.thetas, int(part["len"]), part["ends"])

    inner = map_rows(groups.join(starts, ["cell_id", "grp"]), inside,
                     f"cell_id STRING, blk BIGINT, start {ROWS_OF_STATES}")
    return inner, starts.filter(F.col("grp").isNull()).select("cell_id", F.col("at").alias("final"))


def _run_exact(df: DataFrame, params: DataFrame, size: int, fan_in: int,
               fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``fn(row, first slot, [(model, residuals), ...])`` per block, from exact start states."""
    blocks, size, halo = _blocks_with_models(df, _bundle(params.filter("mu IS NOT NULL")), size)
    starts, _ = _carry(_block_ends(blocks, size, halo), fan_in)

    def run(row):
        done = []
        for (m, u), s in zip(_block_inputs(row, size, halo), row.start):
            th = np.asarray(m["theta"], float)
            done.append((m, solvers.ma_filter(u[:, None], th, np.asarray(s, float)[:, None])[:, 0]))
        yield from fn(row, int(row.blk) * size, done, halo)

    return map_rows(blocks.join(starts, ["cell_id", "blk"]), run, schema)


def arma_css(df: DataFrame, params: DataFrame, size: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """``(cell_id, p, q, sse, n, sigma2)`` of given models; the first p slots are skipped."""
    def sums(row, start, models, halo):
        for m, e in models:
            e = e[max(m["p"] - start, 0):]
            yield row.cell_id, m["p"], m["q"], float(e @ e), len(e)

    parts = _run_exact(df, params, size, fan_in, sums,
                       "cell_id STRING, p INT, q INT, sse DOUBLE, n BIGINT")
    return parts.groupBy("cell_id", "p", "q").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")) \
        .withColumn("sigma2", F.try_divide("sse", "n"))


def arma_predict_in_sample(df: DataFrame, params: DataFrame, size: int = BLOCK,
                           fan_in: int = FAN_IN) -> DataFrame:
    """``(cell_id, p, q, t, yhat)``: one-step fitted values from slot p on."""
    def fitted(row, start, models, halo):
        y = spread_out(row.off, row.x, int(max(row.off)) + 1)[halo:]
        for m, e in models:
            skip = max(m["p"] - start, 0)
            yield row.cell_id, m["p"], m["q"], start + skip, (y - e)[skip:]

    return _unrolled(_run_exact(df, params, size, fan_in, fitted, PATH))


PATH = "cell_id STRING, p INT, q INT, first BIGINT, path ARRAY<DOUBLE>"


def _unrolled(paths: DataFrame) -> DataFrame:
    """One row per slot of ``(cell_id, p, q, first, path)``."""
    return paths.select("cell_id", "p", "q", "first", F.posexplode("path").alias("i", "yhat")) \
        .select("cell_id", "p", "q", (F.col("first") + F.col("i")).alias("t"), F.when(~F.isnan("yhat"), F.col("yhat")).alias("yhat"))


def arma_forecast(df: DataFrame, params: DataFrame, horizon: int, size: int = BLOCK,
                  fan_in: int = FAN_IN, chunk: int = 1024) -> DataFrame:
    """``(cell_id, p, q, t, yhat)`` for the ``horizon`` slots after each series.

    Each series ends at its own last slot and enters by its last values and residuals alone;
    long horizons are cut into chunks that start from a power of the step matrix. A series
    with fewer than p values, or a model without parameters, has a NULL forecast.
    """
    models = _bundle(params)
    known = _with_parameters(models)
    blocks, size, halo = _blocks_with_models(df, known, size)
    _, final = _carry(_block_ends(blocks, size, halo), fan_in)
    ends = df.groupBy("cell_id").agg(F.max("t").alias("t_end"))
    last = lookup_join(df, ends, "cell_id").filter(F.col("t") > F.col("t_end") - max(halo, 1)).groupBy("cell_id").agg(
        F.max("t_end").alias("t_end"),
        F.sort_array(F.collect_list(F.struct("t", "v")), asc=False).alias("tail")) \
        .select("cell_id", "t_end", F.col("tail.v").alias("values"))
    jobs = models.join(last, "cell_id").join(final, "cell_id", "left").withColumn(
        "skip", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1), F.lit(chunk))))
    if horizon > chunk:
        jobs = spread(jobs, "cell_id", "skip")

    def ahead(row):
        steps = min(chunk, horizon - row.skip)
        states = iter(row.final if row.final is not None else ())
        for m in row.models:
            fits = m["mu"] is not None
            state = next(states) if fits else None
            path = np.full(steps, np.nan) if not fits or len(row.values) < m["p"] else solvers.forecast(
                row.values, state, m["mu"], m["phi"], m["theta"], int(row.skip), steps)
            yield row.cell_id, m["p"], m["q"], row.t_end + int(row.skip) + 1, np.asarray(path, float)

    return _unrolled(map_rows(jobs, ahead, PATH))


def _with_parameters(models: DataFrame) -> DataFrame:
    """Without the models that could not be fitted."""
    return settle(models.select("cell_id", F.filter("models", lambda m: m["mu"].isNotNull()).alias("models"))
                  .filter(F.size("models") > 0))


# --- fitting ---------------------------------------------------------------------------

FIT = f"{PARAMS}, sse DOUBLE, n BIGINT, converged BOOLEAN"


def _even_jobs(orders: list[tuple[int, int]], jobs: int) -> list[list[tuple[int, int]]]:
    """Orders in ``jobs`` lists of about equal cost, the dearest dealt first. A fit's cost grows with
    its columns, twice as fast with those that need filtering."""
    cost = lambda o: (1 + o[0] + 2 * o[1]) * (2 + o[0] + o[1])
    heap = [(0, i, []) for i in range(min(jobs, len(orders)))]
    for order in sorted(orders, key=cost, reverse=True):
        load, i, own = heapq.heappop(heap)
        heapq.heappush(heap, (load + cost(order), i, own + [order]))
    return [own for _, _, own in heap] or [[]]


def _series_batches(frames: Iterable[pd.DataFrame]) -> Iterable[list[tuple]]:
    """``(cell_id, job, values)`` of frames sorted by cell, job and slot: up to ``TOGETHER`` values at a time."""
    open_, done, size = None, [], 0
    for pdf in frames:
        if pdf.empty:
            continue
        v, job = pdf["v"].to_numpy(float), pdf["job"].to_numpy()
        code, names = pd.factorize(pdf["cell_id"])                     # NULL: -1
        at = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(job) != 0)) + 1), len(v)]
        for lo, hi in zip(at, at[1:]):
            key = names[code[lo]] if code[lo] >= 0 else None, int(job[lo])
            if open_ is not None and open_[0] == key:
                open_[1].append(v[lo:hi])
                continue
            if open_ is not None:
                done.append((*open_[0], np.concatenate(open_[1])))
                size += len(done[-1][2])
                if size >= TOGETHER:
                    yield done
                    done, size = [], 0
            open_ = key, [v[lo:hi]]
    if open_ is not None:
        yield [*done, (*open_[0], np.concatenate(open_[1]))]


def _fits(series: list[tuple], orders: Sequence[tuple[int, int]]) -> Iterable[tuple]:
    """All orders of some series. Many series of about one length take their steps together, few one by one."""
    known: list[dict] = [{} for _ in series]
    whole = [not np.isnan(y).any() for _, y in series]
    for p, q in orders:
        starts = {}
        for i, (_, y) in enumerate(series):
            if whole[i] and len(y) > 2 * (p + q) + 4:
                try:
                    with np.errstate(all="ignore"):
                        starts[i] = solvers.css_start(y, p, q, known[i])
                except np.linalg.LinAlgError:
                    pass
        order = sorted(starts, key=lambda i: len(series[i][1]))
        cuts = [k for k in range(1, len(order)) if len(series[order[k]][1]).bit_length() > len(series[order[k - 1]][1]).bit_length()]
        found = {}
        for lo, hi in zip([0, *cuts], [*cuts, len(order)]):
            part = order[lo:hi]
            with np.errstate(all="ignore"):
                if len(part) >= FEW:
                    made = solvers.css_fit_many([series[i][1] for i in part], np.array([starts[i] for i in part]), p, q)
                else:
                    made = [_fit_or_none(series[i][1], p, q, starts[i]) for i in part]
            found.update(zip(part, made))
        for i, (cell, y) in enumerate(series):
            if found.get(i) is None:
                yield cell, p, q, None, None, None, None, len(y), False
            else:
                beta, sse, ok = found[i]
                yield cell, p, q, float(beta[0]), beta[1:1 + p], beta[1 + p:], sse, len(y) - p, ok


def _fit_or_none(y: np.ndarray, p: int, q: int, start: np.ndarray):
    try:
        return solvers.css_fit(y, p, q, start=start)
    except np.linalg.LinAlgError:
        return None


def arma_fit(df: DataFrame, orders: Sequence[tuple[int, int]], in_task: int = IN_TASK,
             size: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """Fit every order to every cell by conditional least squares, with constant.

    ``(cell_id, p, q, mu, phi, theta, sse, n, sigma2, bic, converged)``; a series too short for
    an order, with a missing value, or whose equations have no solution, has NULLs and
    ``converged = false``. Slots are the rows of a series in order of ``t``. Series of up to
    ``in_task`` rows are fitted inside a task, many at once (few series: one task per series and job),
    longer ones over all blocks; the method is the same.
    """
    spark = df.sparkSession
    lengths = settle(df.groupBy("cell_id").agg(F.count("*").alias("n"), F.count("v").alias("known")))
    count, long, slots = lengths.agg(F.count("*"), F.count(F.when(F.col("n") > in_task, 1)),
                                     F.sum(F.when(F.col("n") <= in_task, F.col("n")))).first()
    cores = spark.sparkContext.defaultParallelism
    few = count < 4 * cores
    jobs = _even_jobs(list(orders), math.ceil(4 * cores / max(count, 1))) if few else [list(orders)]

    def fit(frames):
        for series in _series_batches(frames):
            found = [r for job in sorted({j for _, j, _ in series})
                     for r in _fits([(c, y) for c, j, y in series if j == job], jobs[job])]
            yield pd.DataFrame(found, columns=["cell_id", "p", "q", "mu", "phi", "theta", "sse", "n", "converged"])

    longer = settle(lengths.filter(F.col("n") > in_task)) if long else None
    short = lookup_join(df, longer.select("cell_id"), "cell_id", "left_anti") if long else df
    rows = short.select("cell_id", "t", "v", F.explode(F.array(*[F.lit(i) for i in range(len(jobs))])).alias("job"))
    if few:                                                # each (cell, job) has a turn: even loads, known beforehand
        cells = sorted(r["cell_id"] for r in lengths.filter("cell_id IS NOT NULL").select("cell_id").collect())
        turn = F.coalesce(F.array_position(F.array(*map(F.lit, cells)), F.col("cell_id")), F.lit(0)) if cells else F.lit(0)
        parts = min(max(len(cells), 1) * len(jobs), 4 * cores)
        dealt = rows.repartitionById(parts, F.pmod(F.col("job") * F.lit(len(cells) + 1) + turn, F.lit(parts)).cast("int"))
    else:
        full = max(2 * cores, math.ceil((slots or 0) / TOGETHER))       # smaller batches gain less
        dealt = spread(rows, "cell_id", "job", most=full)
    fits = dealt.select("cell_id", "job", "t", "v").sortWithinPartitions("cell_id", "job", F.col("t").asc_nulls_last()) \
        .mapInPandas(fit, FIT)
    if long:
        grid = longer.withColumn("o", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in orders]))) \
            .select("cell_id", "o.p", "o.q", "n", (F.col("n") == F.col("known")).alias("whole"))
        grid = settle(grid.withColumn("fits", F.col("whole") & (F.col("n") > 2 * (F.col("p") + F.col("q")) + 4)))
        series = settle(_compact(lookup_join(df, longer.filter("n = known").select("cell_id"), "cell_id", "left_semi"), size))
        refined = settle(_refine(series, list(orders), grid.filter("fits").select("cell_id", "p", "q"), size, fan_in))
        rest = grid.join(refined, ["cell_id", "p", "q"], "left_anti").select(
            "cell_id", "p", "q", F.lit(None).cast("double").alias("mu"), F.lit(None).cast("array<double>").alias("phi"),
            F.lit(None).cast("array<double>").alias("theta"), F.lit(None).cast("double").alias("sse"), "n",
            F.lit(False).alias("converged"))
        fits = fits.unionByName(refined).unionByName(rest)
    return arma_bic(fits.withColumn("sigma2", F.try_divide("sse", "n"))).select(
        "cell_id", "p", "q", "mu", "phi", "theta", "sse", "n", "sigma2", "bic", "converged")


def _compact(df: DataFrame, size: int) -> DataFrame:
    """The rows of each series on slots 0, 1, ... in order of ``t``."""
    packed = settle(pack_blocks(df, size))
    before = Window.partitionBy("cell_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    at = packed.select("cell_id", "blk", F.size("x").alias("n")) \
        .withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return packed.join(at, ["cell_id", "blk"]).select("cell_id", "at", F.posexplode("x").alias("i", "v")) \
        .select("cell_id", (F.col("at") + F.col("i")).alias("t"), "v")


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, count, total)``: the arrays ``z`` and the counts ``n`` of all blocks added up."""
    return parts.select(*keys, "n", F.posexplode("z").alias("pos", "z")) \
        .groupBy(*keys, "pos").agg(F.sum("z").alias("z"), F.sum("n").alias("count")) \
        .groupBy(*keys).agg(F.max("count").alias("count"),
                            F.sort_array(F.collect_list(F.struct("pos", "z"))).alias("p_")) \
        .select(*keys, "count", F.col("p_.z").alias("total"))


def _starts(df: DataFrame, orders: list[tuple[int, int]], jobs: DataFrame, size: int) -> DataFrame:
    """``(cell_id, p, q, beta)``: the start of ``solvers.css_start`` from sums over all slots."""
    longest = max(max(10, 2 * (p + q)) for p, q in orders)
    halo = longest + max(max(p, q) for p, q in orders)

    def autoregressions(row):
        g, _, m = solvers.centred_gram(int(row.n), row.total, row.cross, row.head, row.tail, longest)
        made, lags = [], []
        for p, q in orders:
            long = min(max(10, 2 * (p + q)), int(row.n) // 4)
            a = []
            if p + q and long > max(p, q):
                if long != longest:            # the sums begin at the slot after the lags used
                    g_, _, _ = solvers.centred_gram(int(row.n), row.total, row.cross, row.head, row.tail, long)
                else:
                    g_ = g
                a = np.linalg.lstsq(g_[2:, 2:], g_[2:, 1], rcond=None)[0]
            made.append((p, q, a))
        yield row.cell_id, m + row.centre, [p for p, _, _ in made], [q for _, q, _ in made], [a for _, _, a in made]

    first = settle(map_rows(series_summary(df, longest, size), autoregressions,
                            f"cell_id STRING, mu DOUBLE, ps ARRAY<INT>, qs ARRAY<INT>, longs {ROWS_OF_STATES}"))
    width = max(size, halo)
    blocks = lookup_join(pack_blocks(df, width, halo), first, "cell_id", salt_by="blk", settled=True)

    def second(row):
        body = int(max(row.off)) + 1 - halo
        if body <= 0:
            return
        start = int(row.blk) * width
        d = np.nan_to_num(spread_out(row.off, row.x, halo + body) - row.mu)    # nothing before slot 0
        for p, q, a in zip(row.ps, row.qs, row.longs):
            if not len(a):
                continue
            k = max(p, q)
            e = np.zeros(halo + body)
            e[len(a):] = d[len(a):] - sum(f * d[len(a) - i:len(d) - i] for i, f in enumerate(a, 1))
            e[:max(halo - start + len(a), 0)] = 0.0
            here = np.arange(max(halo, halo - start + len(a) + k), halo + body)
            z = np.column_stack([d[here], *[d[here - i] for i in range(1, p + 1)], *[e[here - j] for j in range(1, q + 1)]])
            yield row.cell_id, p, q, len(here), (z.T @ z).ravel()

    keys = ["cell_id", "p", "q"]
    sums = _summed(map_rows(blocks, second, "cell_id STRING, p INT, q INT, n BIGINT, z ARRAY<DOUBLE>"), keys)
    joined = jobs.join(sums, keys, "left").join(first.select("cell_id", "mu"), "cell_id")

    def solve(row):
        phi, theta = np.zeros(row.p), np.zeros(row.q)
        if row.total is not None:
            g = np.array(row.total, float).reshape(1 + row.p + row.q, -1)
            try:
                coef = np.linalg.lstsq(g[1:, 1:], g[1:, 0], rcond=None)[0]
                phi, theta = solvers.shrunk(coef[:row.p], coef[row.p:])
            except np.linalg.LinAlgError:
                return
        yield row.cell_id, row.p, row.q, np.concatenate([[row.mu], phi, theta])

    return map_rows(joined, solve, "cell_id STRING, p INT, q INT, beta ARRAY<DOUBLE>")


def _run_derivatives(packed: DataFrame, models: DataFrame, size: int, halo: int, fan_in: int, short: bool) -> DataFrame:
    """``(cell_id, p, q, k, n, z)`` per block and trial ``k``: products of the residuals and their exact
    Jacobian. ``short``: no series has more than ``fan_in`` blocks, so one fold per series does."""
    blocks = packed.join(models, "cell_id")

    def inputs(row):
        body = int(max(row.off)) + 1 - halo
        if body > 0:
            x = spread_out(row.off, row.x, halo + body)
            for m in row.models:
                p = m["p"]
                for k, beta in enumerate(m["trials"]):
                    beta = np.asarray(beta, float)
                    yield p, m["q"], k, beta[1 + p:], solvers.derivative_inputs(x, halo, int(row.blk) * size, beta[0], beta[1:1 + p])

    def ends(row):
        out, thetas, length = [], [], 0
        for _, _, _, theta, u in inputs(row):
            out.append(solvers.joint_filter(u, theta, None)[1])
            thetas.append(theta)
            length = len(u)
        if length:
            yield row.cell_id, row.blk, length, out, thetas

    closed = map_rows(blocks, ends, f"cell_id STRING, blk BIGINT, len BIGINT, ends {ROWS_OF_STATES}, thetas {ROWS_OF_STATES}")
    if short:
        starts = map_rows(_grouped(closed, ["cell_id"], "blk"), _starts_inside, f"cell_id STRING, blk BIGINT, start {ROWS_OF_STATES}")
    else:
        starts, _ = _carry(closed, fan_in)

    def products(row):
        for (p, q, k, theta, u), s in zip(inputs(row), row.start):
            z = solvers.joint_filter(u, theta, np.asarray(s, float))[0][max(p - int(row.blk) * size, 0):]
            yield row.cell_id, p, q, k, len(z), (z.T @ z).ravel()

    return map_rows(blocks.join(starts, ["cell_id", "blk"]), products,
                    "cell_id STRING, p INT, q INT, k INT, n BIGINT, z ARRAY<DOUBLE>")


def _starts_inside(row):
    s = _zero_states(row.parts)
    for part in row.parts:
        yield row.cell_id, part["blk"], s
        s = _fold(s, row.thetas, int(part["len"]), part["ends"])


def _proposed(best: np.ndarray, gram: np.ndarray, lam: float, p: int, most: int) -> list[tuple[np.ndarray, float]]:
    """The next ``most`` admissible steps of ``solvers.css_fit``, each with its damping; none are left
    when the damping has reached its limit. The first without a solution raises."""
    out = []
    while lam < 1e12 and len(out) < most:
        try:
            trial = best + solvers.damped_step(gram[1:, 1:], gram[1:, 0], lam)
        except np.linalg.LinAlgError:
            if not out:
                raise
            break
        if solvers.admissible(trial[1:1 + p], trial[1 + p:]):
            out.append((trial, lam))
        lam *= 10
    return out


def _advance(row, rounds: int):
    """One round of ``_refine`` for one model: take the first trial that improves, propose the next ones."""
    width = 1 + len(row.trials[0])
    sums = np.array([part["z"] for part in row.tried], float).reshape(len(row.trials), width * width)
    count, lam, steps = int(row.tried[0]["count"]), row.lam, int(row.steps)
    same = row.cell_id, row.p, row.q
    done = ok = rejected = False
    if row.best is None:
        best, gram = row.trials[0], sums[0]
        if not np.all(np.isfinite(gram)):
            yield *same, row.trials, row.lams, None, None, None, count, lam, steps, True, False
            return
    else:
        best, gram = row.best, np.array(row.gram, float)
        taken = next((i for i, z in enumerate(sums) if z[0] <= row.sse), None)
        if taken is None:
            lam, rejected = row.lams[-1] * 10, True
        else:
            best, gram, lam, steps = row.trials[taken], sums[taken], max(row.lams[taken] / 10, 1e-12), steps + 1
            ok = row.sse - gram[0] <= 1e-11 * gram[0]
            done = ok or steps >= rounds
    sse, g = float(gram[0]), gram.reshape(width, width)
    trials = []
    if not done:
        try:
            trials = _proposed(np.array(best, float), g, lam, row.p, TRIALS if rejected else 2)
        except np.linalg.LinAlgError:          # no solution: a row of NULLs
            yield *same, row.trials, row.lams, None, None, None, count, lam, steps, True, False
            return
        if not trials:
            done, ok = True, bool(np.all(np.abs(g[1:, 0]) <= 1e-5 * np.sqrt(np.diag(g)[1:] * sse + 1e-300)))
    yield (*same, [t for t, _ in trials], [at for _, at in trials], best, gram, sse, count, lam, steps, done, ok)


def _refine(df: DataFrame, orders: list[tuple[int, int]], jobs: DataFrame, size: int, fan_in: int,
            rounds: int = 100) -> DataFrame:
    """``solvers.css_fit`` over blocks, up to ``rounds`` steps a model: the same steps in the same order.

    A round is one pass over blocks packed once. It tries the next step of every live model with
    growing damping, two at a time and ``TRIALS`` after a round without gain, and takes the first
    that improves; rejected steps thus seldom cost a pass of their own.
    """
    halo = max(p for p, _ in orders)
    size = max(size, halo)
    packed = settle(pack_blocks(df, size, halo))
    short = (packed.agg(F.max("blk")).first()[0] or 0) < fan_in
    numbers = F.array().cast("array<double>")
    state = settle(_starts(df, orders, jobs, size).select(
        "cell_id", "p", "q", F.array("beta").alias("trials"), numbers.alias("lams"), F.lit(None).cast("array<double>").alias("best"),
        F.lit(None).cast("array<double>").alias("gram"), F.lit(None).cast("double").alias("sse"),
        F.lit(None).cast("bigint").alias("n"), F.lit(1e-3).alias("lam"), F.lit(0).alias("steps"),
        F.lit(False).alias("done"), F.lit(False).alias("ok")))
    schema = ", ".join(f"{k} {v}" for k, v in state.dtypes)
    keys = ["cell_id", "p", "q"]
    while count := (live := state.filter(~F.col("done"))).count():
        models = _bundle_small(live.select(*keys, "trials"), count)
        parts = _run_derivatives(packed, models, size, halo, fan_in, short)
        totals = parts.select(*keys, "k", "n", F.posexplode("z").alias("pos", "z")) \
            .groupBy(*keys, "k", "pos").agg(F.sum("z").alias("z"), F.sum("n").alias("count")) \
            .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "pos", "z", "count"))).alias("tried"))
        stepped = map_rows(live.join(totals, keys), lambda row: _advance(row, rounds), schema)
        state = settle(stepped.unionByName(state.filter("done")))
    best = F.col("best")
    return state.filter("best IS NOT NULL").select(
        *keys, best[0].alias("mu"), F.slice(best, F.lit(2), F.col("p")).alias("phi"),
        F.slice(best, F.col("p") + 2, F.col("q")).alias("theta"), "sse", "n", F.col("ok").alias("converged"))


def _bundle_small(live: DataFrame, count: int) -> DataFrame:
    """``(cell_id, models)`` of the live models, broadcast while ``count`` of them are known to be few."""
    models = live.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("p", "q", "trials"))).alias("models"))
    return F.broadcast(models) if count * TRIALS <= BROADCAST_MODELS else models


def arma_order_search(df: DataFrame, max_p: int, max_q: int, **how) -> DataFrame:
    """Per cell the order with the smallest BIC over p < max_p, q < max_q.

    Fits that fail or do not converge are skipped; of equals the first (p, q) wins. A cell
    without any fit has a row of NULLs.
    """
    fits = arma_fit(df, [(p, q) for p in range(max_p) for q in range(max_q)], **how)
    good = F.col("converged") & F.col("bic").isNotNull() & ~F.isnan("bic")
    chosen = F.min_by(F.struct("p", "q", "mu", "phi", "theta", "sse", "n", "bic"),
                      F.when(good, F.struct("bic", "p", "q")))
    return fits.groupBy("cell_id").agg(chosen.alias("m")).select("cell_id", "m.*")
