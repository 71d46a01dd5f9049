"""Small dense maths on per-cell summaries and single blocks (numpy)."""

from __future__ import annotations

import math

import numpy as np


def lag_products(x: np.ndarray, halo: int, lags: int) -> list[tuple]:
    """Pair sums of x_t with x_{t-k}, k = 0..lags, over the slots after the halo."""
    padded = x if halo >= lags else np.concatenate([np.full(lags - halo, np.nan), x])
    views = np.lib.stride_tricks.sliding_window_view(padded, lags + 1)[:, ::-1]
    views = views[max(halo - lags, 0):]
    has = ~np.isnan(views)
    z = np.where(has, views, 0.0)
    m = has.astype(float)
    z0, m0 = z[:, 0], m[:, 0]
    sums = (m0 @ m, z0 @ m, m0 @ z, (z0 * z0) @ m, m0 @ (z * z), z0 @ z)
    return [(k, int(sums[0][k]), *(float(s[k]) for s in sums[1:])) for k in range(lags + 1)]


def partial_from_acf(r: list[float]) -> list[float]:
    """Durbin-Levinson: partial autocorrelations from r_0 = 1, r_1, ..."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        past = np.asarray(r[1:k])
        num = r[k] - float(phi @ past[::-1]) if k > 1 else r[1]
        den = 1.0 - float(phi @ past) if k > 1 else 1.0
        new = num / den if den else math.nan
        phi = np.append(phi - new * phi[::-1], new)
        out.append(float(new))
    return out


def centred_gram(n: int, total: float, cross, head, tail, k: int):
    """Gram matrix of [1, x_t - m, ..., x_{t-k} - m] over t = k..n-1, and the centred head.

    ``cross[d]`` is the sum of x_t x_{t-d} over t >= d; ``head`` and ``tail`` hold the
    first and last values (at least ``k``, or all). Shifted products differ from
    ``cross`` only by edge terms, so the full matrix costs no further pass over the data.
    """
    m = total / n
    head, tail = np.asarray(head, float) - m, np.asarray(tail, float) - m
    first = lambda c: float(head[:c].sum())
    last = lambda c: float(tail[len(tail) - c:].sum()) if c else 0.0
    c = np.empty(k + 1)
    for d in range(k + 1):
        # sum over t >= d of (x_t - m)(x_{t-d} - m), from raw sums
        s_lead, s_lag = total - float((head[:d] + m).sum()), \
            total - float((tail[len(tail) - d:] + m).sum() if d else 0.0)
        c[d] = cross[d] - m * (s_lead + s_lag) + m * m * (n - d)
    g = np.empty((k + 2, k + 2))
    g[0, 0] = n - k
    for i in range(k + 1):
        g[0, i + 1] = g[i + 1, 0] = -first(k - i) - last(i)
        for j in range(i, k + 1):
            d = j - i
            lo = float(head[d:k - i] @ head[:k - j]) if k - i > d else 0.0
            hi = float(tail[len(tail) - i:] @ tail[len(tail) - i - d:len(tail) - d]) if i else 0.0
            g[i + 1, j + 1] = g[j + 1, i + 1] = c[d] - lo - hi
    return g, head, m


def least_squares(g: np.ndarray, target: int, cols: list[int]):
    """Coefficients, SSE and inverse from a Gram matrix."""
    a, b = g[np.ix_(cols, cols)], g[cols, target]
    try:
        inv = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(a, hermitian=True)
    beta = inv @ b
    return beta, float(max(g[target, target] - beta @ b, 0.0)), inv


# MacKinnon surfaces, constant only (fixed values).
ADF_P_LOW = (2.1659, 1.4412, 0.038269)
ADF_P_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_RANGE = (-18.83, -1.61, 2.74)
ADF_CRITICAL = ((-3.43035, -6.5393, -16.786, -79.433),
                (-2.86154, -2.8903, -4.234, -40.040),
                (-2.56677, -1.5384, -2.809))


def adf_p_value(stat: float) -> float:
    low, split, high = ADF_P_RANGE
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    poly = ADF_P_LOW if stat <= split else ADF_P_HIGH
    z = sum(c * stat ** i for i, c in enumerate(poly))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def adf_critical(nobs: int) -> list[float]:
    return [sum(c / nobs ** i for i, c in enumerate(row)) for row in ADF_CRITICAL]


def adf(n: int, total: float, cross, head, tail, max_lag: int) -> tuple:
    """Unit root test with constant, lag count by AIC on the common sample."""
    max_lag = max(min(max_lag, n // 2 - 2), 0)
    k = max_lag + 1
    g, x, _ = centred_gram(n, total, cross, head, tail, k)
    # Columns: constant, level y_{t-1}, differences at lags 1..max_lag, target difference.
    def change(lag: int) -> np.ndarray:
        e = np.zeros(k + 2)
        e[1 + lag], e[2 + lag] = 1.0, -1.0
        return e
    one, level = np.eye(k + 2)[0], np.eye(k + 2)[2]
    basis = np.array([one, level, *[change(i) for i in range(1, max_lag + 1)], change(0)])
    target = len(basis) - 1
    q = basis @ g @ basis.T
    nobs, best = n - k, None
    for lag in range(max_lag + 1):
        _, sse, _ = least_squares(q, target, list(range(lag + 2)))
        fit = nobs * math.log(sse / nobs) + 2 * (lag + 2) if sse > 0 else -math.inf
        if best is None or fit < best[0]:
            best = (fit, lag)
    lag = best[1]
    # The chosen lag needs fewer slots before it: add the rows the common sample left out.
    cols = [*range(lag + 2), target]
    full = q[np.ix_(cols, cols)]
    for t in range(lag + 1, k):
        window = x[t - lag - 1:t + 1][::-1]          # x_t, x_{t-1}, ...
        dx = window[:-1] - window[1:]
        row = np.array([1.0, window[1], *dx[1:lag + 1], dx[0]])
        full = full + np.outer(row, row)
    nobs = n - lag - 1
    beta, sse, inv = least_squares(full, lag + 2, list(range(lag + 2)))
    se = math.sqrt(max(sse / (nobs - lag - 2) * inv[1, 1], 0.0))
    stat = float(beta[1] / se) if se > 0 else math.nan
    p = adf_p_value(stat) if stat == stat else None
    return (stat if stat == stat else None, p, lag, nobs, *adf_critical(nobs))


def companion(theta) -> np.ndarray:
    """Step matrix of the last q residuals: s' = A s (+ the new input in front)."""
    q = len(theta)
    a = np.zeros((q, q))
    if q:
        a[0] = -np.asarray(theta, float)
        a[1:, :-1] = np.eye(q - 1)
    return a


def ma_filter(u: np.ndarray, theta, state: np.ndarray, chunk: int | None = None) -> np.ndarray:
    """e_t = u_t - sum theta_j e_{t-j}, per column; ``state`` holds e_{-1}, e_{-2}, ...

    Runs in chunks: inside a chunk the filter is one triangular matrix, so the loop
    is over chunks, not slots.
    """
    q, n = len(theta), len(u)
    if q == 0 or n == 0:
        return u.copy()
    theta = np.asarray(theta, float)
    chunk = max(chunk or min(max(int(n ** 0.5), 16), 96), q)
    h = np.zeros(chunk)
    h[0] = 1.0
    for t in range(1, chunk):
        r = min(q, t)
        h[t] = -theta[:r] @ h[t - r:t][::-1]
    lag = np.subtract.outer(np.arange(chunk), np.arange(chunk))
    tri = np.where(lag >= 0, h[np.abs(lag)], 0.0)
    prior = np.zeros((chunk, q))
    for i in range(q):
        prior[i, :q - i] = theta[i:]
    carry = tri @ prior
    e, prev = np.empty_like(u), np.asarray(state, float)
    for b in range(0, n, chunk):
        m = min(chunk, n - b)
        e[b:b + m] = tri[:m, :m] @ u[b:b + m] - carry[:m] @ prev
        prev = np.concatenate([e[b:b + m][::-1], prev])[:q]
    return e


def innovations_input(x: np.ndarray, halo: int, start: int, mu: float, phi) -> np.ndarray:
    """phi(B)(y - mu) over the slots after the halo; 0 for the first p slots of a series."""
    p, d = len(phi), x - mu
    body = len(x) - halo
    u = d[halo:].copy()
    for i, f in enumerate(phi, 1):
        u -= f * d[halo - i:halo - i + body]
    if start < p:
        u[:p - start] = 0.0
    return u


def derivative_inputs(x: np.ndarray, halo: int, start: int, mu: float, phi) -> np.ndarray:
    """Inputs of the residuals and of their derivatives by mu and phi, one column each."""
    p, body = len(phi), len(x) - halo
    d = x - mu
    u = np.column_stack([innovations_input(x, halo, start, mu, phi), np.full(body, -(1.0 - np.sum(phi))),
                         *[-d[halo - i:halo - i + body] for i in range(1, p + 1)]])
    u[:max(p - start, 0)] = 0.0
    return u


def joint_filter(u: np.ndarray, theta, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Residuals with their Jacobian (mu, phi, theta), and the end state of all recursions.

    The derivative by theta_j is -g_{t-j}, where g is the residuals filtered once more. A state
    holds the last q of each column of ``u`` filtered, then of g.
    """
    theta = np.asarray(theta, float)
    q, n, k = len(theta), *u.shape
    s = np.zeros((q, k + 1)) if state is None or not q else state.reshape(k + 1, q).T
    e = ma_filter(u, theta, s[:, :k])
    if not q:
        return e, np.zeros(0)
    g = ma_filter(e[:, :1], theta, s[:, k:])
    back = np.concatenate([s[::-1, k], g[:, 0]])                   # g_{-q}, ..., g_{n-1}
    by_theta = np.column_stack([-back[q - j:q - j + n] for j in range(1, q + 1)])
    after = np.concatenate([np.hstack([e, g])[::-1], s])[:q]
    return np.hstack([e, by_theta]), after.T.ravel()


def carried(state: np.ndarray, theta, length: int) -> np.ndarray:
    """A state ``length`` slots later, without input: one of residuals, or of ``joint_filter``."""
    q = len(theta)
    if not q:
        return np.zeros(0)
    a = companion(theta)
    if len(state) == q:
        return np.linalg.matrix_power(a, length) @ state
    both = np.zeros((2 * q, 2 * q))                # g takes the residuals as its input
    both[:q, :q] = both[q:, q:] = a
    both[q, :q] = a[0]
    m = np.linalg.matrix_power(both, length)
    s = state.reshape(-1, q).T
    out = m[:q, :q] @ s
    out[:, -1] = m[q:, :q] @ s[:, 0] + m[q:, q:] @ s[:, -1]
    return out.T.ravel()


def admissible(phi, theta) -> bool:
    for coef in (-np.asarray(phi, float), np.asarray(theta, float)):
        if len(coef) and (not np.all(np.isfinite(coef))
                          or np.abs(np.linalg.eigvals(companion(coef))).max() >= 0.9999):
            return False
    return True


def shrunk(phi, theta, r: float = 0.9):
    if not np.all(np.isfinite([*phi, *theta])):
        raise np.linalg.LinAlgError("no finite start")
    while not admissible(phi, theta):
        phi = phi * r ** np.arange(1, len(phi) + 1)
        theta = theta * r ** np.arange(1, len(theta) + 1)
    return phi, theta


def css_start(y: np.ndarray, p: int, q: int, known: dict | None = None) -> np.ndarray:
    """Hannan-Rissanen: long autoregression, then least squares on lags and its residuals. ``known``
    keeps the former of this series for its other orders."""
    mu = float(y.mean())
    d = y - mu
    known = {} if known is None else known

    def lags(z, k, start):
        return np.column_stack([z[start - i:len(z) - i] for i in range(1, k + 1)]) \
            if k else np.zeros((len(z) - start, 0))

    phi, theta = np.zeros(p), np.zeros(q)
    long = min(max(10, 2 * (p + q)), len(y) // 4)
    if p + q and long > max(p, q):
        if long not in known:
            x = lags(d, long, long)
            known[long] = np.concatenate([np.zeros(long), d[long:] - x @ np.linalg.lstsq(x, d[long:], rcond=None)[0]])
        e = known[long]
        s = long + max(p, q)
        coef = np.linalg.lstsq(np.hstack([lags(d, p, s), lags(e, q, s)]), d[s:], rcond=None)[0]
        phi, theta = shrunk(coef[:p], coef[p:])
    return np.concatenate([[mu], phi, theta])


def css_residuals(y: np.ndarray, beta: np.ndarray, p: int, q: int) -> np.ndarray:
    padded = np.concatenate([np.zeros(p), y])
    u = innovations_input(padded, p, 0, beta[0], beta[1:1 + p])
    return ma_filter(u[:, None], beta[1 + p:], np.zeros((q, 1)))[:, 0]


def css_jacobian(y: np.ndarray, e: np.ndarray, beta: np.ndarray, p: int, q: int) -> np.ndarray:
    d, n = y - beta[0], len(y)
    u = np.zeros((n, 1 + p))
    u[p:, 0] = -(1.0 - beta[1:1 + p].sum())
    for i in range(1, p + 1):
        u[p:, i] = -d[p - i:n - i]
    v = np.zeros((n, q))
    for j in range(1, q + 1):
        v[j:, j - 1] = -e[:n - j]
    v[:p] = 0.0
    both = np.hstack([u, v])
    return ma_filter(both, beta[1 + p:], np.zeros((q, both.shape[1])))


def damped_step(jj: np.ndarray, je: np.ndarray, lam: float) -> np.ndarray:
    return -np.linalg.solve(jj + lam * np.diag(np.diag(jj) + 1e-12), je)


def css_fit(y: np.ndarray, p: int, q: int, rounds: int = 100, start: np.ndarray | None = None):
    """Conditional least squares by damped Gauss-Newton: (beta, sse, converged)."""
    beta = css_start(y, p, q) if start is None else start
    e = css_residuals(y, beta, p, q)
    sse, lam = float(e @ e), 1e-3
    for _ in range(rounds):
        j = css_jacobian(y, e, beta, p, q)
        jj, je = j.T @ j, j.T @ e
        moved = False
        while lam < 1e12:
            new = beta + damped_step(jj, je, lam)
            if admissible(new[1:1 + p], new[1 + p:]):
                e_new = css_residuals(y, new, p, q)
                sse_new = float(e_new @ e_new)
                if sse_new <= sse:
                    moved = True
                    break
            lam *= 10.0
        if not moved:
            return beta, sse, bool(np.all(np.abs(je) <= 1e-5 * np.sqrt(np.diag(jj) * sse + 1e-300)))
        gain, beta, e, sse, lam = sse - sse_new, new, e_new, sse_new, max(lam / 10.0, 1e-12)
        if gain <= 1e-11 * sse:
            return beta, sse, True
    return beta, sse, False


def _filter_many(u: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """``ma_filter`` from zero states, slot by slot for many series at once; ``u`` is (slots, ..., series)
    and changed, ``theta`` (series, q)."""
    by_lag = [np.ascontiguousarray(theta[:, j]) for j in range(theta.shape[1])]
    part = np.empty(u.shape[1:])
    for t in range(1, len(u) if by_lag else 0):
        for j, th in enumerate(by_lag[:t], 1):
            np.multiply(u[t - j], th, out=part)
            u[t] -= part
    return u


def _residuals_many(y: np.ndarray, mask: np.ndarray, beta: np.ndarray, p: int) -> np.ndarray:
    d, n = y - beta[:, 0], len(y)
    u = d.copy()
    for i in range(1, p + 1):
        u[p:] -= beta[:, i] * d[p - i:n - i]
    u[:p] = 0.0
    return _filter_many(u, beta[:, 1 + p:]) * mask


def _jacobian_many(y: np.ndarray, mask: np.ndarray, e: np.ndarray, beta: np.ndarray, p: int, q: int) -> np.ndarray:
    d, n = y - beta[:, 0], len(y)
    both = np.zeros((n, 1 + p + q, y.shape[1]))
    both[p:, 0] = -(1.0 - beta[:, 1:1 + p].sum(axis=1))
    for i in range(1, p + 1):
        both[p:, i] = -d[p - i:n - i]
    for j in range(1, q + 1):
        both[j:, p + j] = -e[:n - j]
    both[:p] = 0.0
    return _filter_many(both, beta[:, 1 + p:]) * mask[:, None]


def _admissible_many(beta: np.ndarray, p: int) -> np.ndarray:
    good = np.ones(len(beta), bool)
    for coef in (-beta[:, 1:1 + p], beta[:, 1 + p:]):
        if m := coef.shape[1]:
            good &= np.isfinite(coef).all(axis=1)
            step = np.zeros((int(good.sum()), m, m))
            step[:, 0] = -coef[good]
            step[:, range(1, m), range(m - 1)] = 1.0
            good[good] = np.abs(np.linalg.eigvals(step)).max(axis=1, initial=0.0) < 0.9999
    return good


def _damped_steps(jj: np.ndarray, je: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``damped_step`` of each, and which have none."""
    k = jj.shape[1]
    a = jj.copy()
    a[:, range(k), range(k)] += lam[:, None] * (jj[:, range(k), range(k)] + 1e-12)
    none = np.zeros(len(jj), bool)
    try:
        return -np.linalg.solve(a, je[:, :, None])[:, :, 0], none
    except np.linalg.LinAlgError:
        out = np.zeros_like(je)
        for i in range(len(jj)):
            try:
                out[i] = -np.linalg.solve(a[i], je[i])
            except np.linalg.LinAlgError:
                none[i] = True
        return out, none


def css_fit_many(ys: list[np.ndarray], starts: np.ndarray, p: int, q: int, rounds: int = 100) -> list[tuple | None]:
    """``css_fit`` of many series from their ``starts``: the same steps and stopping rule for each, one
    trial of every unfinished series at a time. None for a series without solution."""
    n, k, count = max(map(len, ys)), 1 + p + q, len(ys)
    y, mask = np.zeros((n, count)), np.zeros((n, count))
    for i, x in enumerate(ys):
        y[:len(x), i], mask[:len(x), i] = x, 1.0
    beta, lam, steps = np.array(starts, float), np.full(count, 1e-3), np.zeros(count, int)
    e = _residuals_many(y, mask, beta, p)
    sse = (e * e).sum(axis=0)
    jj, je = np.zeros((count, k, k)), np.zeros((count, k))
    out: list[tuple | None] = [None] * count
    live, fresh = np.arange(count), np.ones(count, bool)
    # columns of y, mask, e and fresh are those of live; they are cut as series finish
    while len(live):
        turn = live[fresh]
        if len(turn):
            j = _jacobian_many(y[:, fresh], mask[:, fresh], e[:, fresh], beta[turn], p, q)
            for a in range(k):
                je[turn, a] = (j[:, a] * e[:, fresh]).sum(axis=0)
                for b in range(a, k):
                    jj[turn, a, b] = jj[turn, b, a] = (j[:, a] * j[:, b]).sum(axis=0)
        stay = np.ones(len(live), bool)
        for i in np.flatnonzero(lam[live] >= 1e12):          # no step improves
            s = live[i]
            flat = np.all(np.abs(je[s]) <= 1e-5 * np.sqrt(np.diag(jj[s]) * sse[s] + 1e-300))
            out[s], stay[i] = (beta[s], float(sse[s]), bool(flat)), False
        step, none = _damped_steps(jj[live], je[live], lam[live])
        stay &= ~none                                        # no solution: stays None
        new = beta[live] + step
        tried = np.flatnonzero(stay)
        tried = tried[_admissible_many(new[tried], p)]
        fresh = np.zeros(len(live), bool)
        lam_next = lam[live] * 10.0
        if len(tried):
            e_new = _residuals_many(y[:, tried], mask[:, tried], new[tried], p)
            sse_new = (e_new * e_new).sum(axis=0)
            good = sse_new <= sse[live[tried]]
            won, s = tried[good], live[tried[good]]
            gain = sse[s] - sse_new[good]
            e[:, won], beta[s], sse[s], fresh[won] = e_new[:, good], new[won], sse_new[good], True
            lam_next[won] = np.maximum(lam[s] / 10.0, 1e-12)
            steps[s] += 1
            done = gain <= 1e-11 * sse[s]
            for i, ended in zip(won[done | (steps[s] >= rounds)], done[done | (steps[s] >= rounds)]):
                out[live[i]], stay[i] = (beta[live[i]], float(sse[live[i]]), bool(ended)), False
        lam[live] = lam_next
        if not stay.all():
            live, fresh, y, mask, e = live[stay], fresh[stay], y[:, stay], mask[:, stay], e[:, stay]
    return out


def ar_from_summary(n: int, total: float, cross, head, tail, p: int):
    """Least-squares AR(p) with constant: (mu, phi, sse)."""
    g, _, m = centred_gram(n, total, cross, head, tail, p)
    beta, sse, _ = least_squares(g, 1, [0, *range(2, p + 2)])
    return m + beta[0] / (1.0 - beta[1:].sum()), beta[1:], sse


def forecast(values, residuals, mu: float, phi, theta, skip: int, steps: int) -> np.ndarray:
    """Steps skip+1..skip+steps; ``values`` and ``residuals`` newest first."""
    p, q = len(phi), len(theta)
    move = np.zeros((p + q, p + q))
    step = np.concatenate([phi, theta])
    if p:
        move[0] = step
        move[1:p, :p - 1] = np.eye(p - 1)
    if q > 1:
        move[p + 1:, p:-1] = np.eye(q - 1)
    s = np.concatenate([np.asarray(values[:p], float) - mu, np.asarray(residuals[:q], float)])
    if skip:
        s = np.linalg.matrix_power(move, skip) @ s
    out = np.empty(steps)
    for h in range(steps):
        out[h] = mu + step @ s
        s = move @ s
    return out
