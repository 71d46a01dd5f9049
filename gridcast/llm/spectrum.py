"""Leading eigenpairs of a symmetric matrix by spectrum slicing (numpy, one small matrix).

The signs of an LDL^T factor's pivots count the eigenvalues on either side of a shift, as
congruence keeps inertia. Bisection with these counts isolates each leading eigenvalue; Rayleigh
quotient iteration then converges cubically inside its interval; two more counts certify its
number. Eigenvalues closer than ``CLUSTER`` of the matrix's size share an interval: their space
comes from iterating a block, and a Rayleigh-Ritz step gives a basis of it.
"""

from __future__ import annotations

import numpy as np

CLUSTER = 1e-11                 # of the matrix's norm
ALPHA = (1 + 17 ** 0.5) / 8     # pivot bound of Bunch and Kaufman


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` lie above ``shift``: positive pivots of an LDL^T factor with
    1x1 and 2x2 pivots. A pivot of zero counts as below."""
    a = a - shift * np.eye(len(a))
    above = 0
    while len(a):
        col = np.abs(a[1:, 0])
        r = 1 + int(col.argmax()) if len(col) else 0
        peak = col[r - 1] if len(col) else 0.0
        if abs(a[0, 0]) < ALPHA * peak:
            row = np.abs(a[r]).copy()
            row[r] = 0.0
            if abs(a[0, 0]) * row.max() < ALPHA * peak * peak:
                if abs(a[r, r]) >= ALPHA * row.max():
                    a = _swap(a, 0, r)
                else:                                        # a 2x2 pivot has one sign each
                    a = _swap(a, 1, r)
                    above += 1
                    below, d = a[2:, :2], a[:2, :2]
                    a = a[2:, 2:] - below @ np.linalg.solve(d, below.T)
                    continue
        pivot = a[0, 0]
        above += pivot > 0
        a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / pivot) if pivot else a[1:, 1:]
    return int(above)


def _swap(a: np.ndarray, i: int, j: int) -> np.ndarray:
    if i != j:
        order = np.arange(len(a))
        order[[i, j]] = j, i
        a = a[np.ix_(order, order)]
    return a


def isolate(a: np.ndarray, k: int, width: float) -> list[tuple[float, float, int, int]]:
    """``(low, high, first, last)``, from the top: intervals ``(low, high]`` that hold eigenvalues
    numbered first to last, one of them or several within ``width``."""
    radius = np.abs(a).sum(axis=1) - np.abs(a.diagonal())
    low, high = (a.diagonal() - radius).min(), (a.diagonal() + radius).max()
    pad = 1e-3 * max(high - low, width)
    out, open_ = [], [(low - pad, high + pad, 1, len(a))]
    while open_:
        low, high, first, last = open_.pop()
        if first > min(k, len(a)) or last < first:
            continue
        if first == last or high - low <= width:
            out.append((low, high, first, last))
            continue
        middle = (low + high) / 2
        above = inertia(a, middle)
        open_ += [(low, middle, above + 1, last), (middle, high, first, above)]
    return out


def _shifted_solve(a: np.ndarray, shift: float, b: np.ndarray, size: float) -> np.ndarray:
    """(a - shift)^-1 b; a shift that is an eigenvalue gives way by a rounding error."""
    for nudge in (0.0, 1.0, 8.0, 64.0):
        try:
            x = np.linalg.solve(a - (shift + nudge * np.finfo(float).eps * size) * np.eye(len(a)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    raise ArithmeticError("no shift near this eigenvalue can be solved")


def _start(d: int, columns: int) -> np.ndarray:
    return np.random.default_rng(d).normal(size=(d, columns))


def _single(a: np.ndarray, low: float, high: float, first: int, size: float) -> tuple[float, np.ndarray]:
    """The one eigenpair of ``(low, high]``."""
    eps = np.finfo(float).eps
    while True:
        x = _start(len(a), 1)[:, 0]
        for _ in range(3):                                   # inverse iteration at the middle
            x = _shifted_solve(a, (low + high) / 2, x, size)
            x /= np.linalg.norm(x)
        value, before = x @ a @ x, np.inf
        for _ in range(12):
            residual = np.linalg.norm(a @ x - value * x)
            if residual >= before / 2 or not low < value <= high:
                break
            kept, before = (value, x), residual
            if residual <= 2 * eps * size:
                break
            x = _shifted_solve(a, value, x, size)
            x /= np.linalg.norm(x)
            value = x @ a @ x
        if before <= 64 * eps * size * len(a) ** 0.5 or high - low <= 4 * eps * size:
            return kept
        middle = (low + high) / 2                            # too wide for the iteration: halve it
        low, high = (middle, high) if inertia(a, middle) >= first else (low, middle)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns. Fewer if
    the rest are zero within rounding. Signs: the entry largest in size is positive."""
    a = np.asarray(a, float)
    a = (a + a.T) / 2
    d, size = len(a), float(np.abs(a).sum(axis=1).max()) if len(a) else 0.0
    if not size:
        return np.empty(0), np.empty((d, 0))
    values, vectors = [], []
    for low, high, first, last in isolate(a, k, CLUSTER * size):
        if first == last:
            value, x = _single(a, low, high, first, size)
            values.append(value)
            vectors.append(x)
            continue
        block = _start(d, last - first + 1)
        for _ in range(4):
            block = np.linalg.qr(_shifted_solve(a, low, block, size))[0]
        ritz, turn = np.linalg.eigh(block.T @ a @ block)     # a few columns, within one cluster
        values += list(ritz[::-1])
        vectors += list((block @ turn[:, ::-1]).T)
    values, vectors = np.array(values[:k]), np.array(vectors[:k])
    gap = 4 * CLUSTER * size
    for i, value in enumerate(values, 1):
        if not inertia(a, value + gap) < i <= inertia(a, value - gap):
            raise ArithmeticError(f"eigenvalue {i} is not certified by its counts")
    real = values > 8 * d * np.finfo(float).eps * size
    values, vectors = values[real], vectors[real].reshape(-1, d)
    peak = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)] if len(vectors) else np.empty(0)
    return values, (vectors * np.sign(peak)[:, None]).T
