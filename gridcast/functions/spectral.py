"""Pair sums over all lags by Fourier transforms dealt over tasks (numpy inside tasks).

A transform of ``N = N1 * N2`` points is N2 short ones of N1 points (slots ``n2, n2 + N2, ...``),
a twist, and N1 short ones of N2 points. A task does some columns or some rows, never a whole
series, and one exchange of small pieces lies between. Spectra are multiplied where the rows
end, and the way back begins there: two exchanges for all lags of a series of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

POINTS = 1 << 14          # of one transform in a task


@dataclass(frozen=True)
class Split:
    """How a transform of ``2 ** bits`` points is cut."""
    bits: int
    points: int = POINTS

    @property
    def n(self) -> int:
        return 1 << self.bits

    @property
    def n1(self) -> int:
        return self.n if self.n <= self.points else 1 << self.bits // 2

    @property
    def n2(self) -> int:
        return self.n // self.n1

    @property
    def columns(self) -> int:
        """Of a task: how many of the ``n2`` columns."""
        return max(1, min(self.n2, self.points // self.n1))

    @property
    def rows(self) -> int:
        """Of a task: how many of the ``n1`` rows."""
        return max(1, min(self.n1, self.points // self.n2))

    def twist(self, rows: np.ndarray, columns: np.ndarray, sign: int) -> np.ndarray:
        turns = rows[:, None] * columns[None, :] % self.n
        return np.exp(sign * 2j * np.pi * turns / self.n)


def down(split: Split, chunk: int, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Transforms over the columns of ``chunk`` of what is known, the values and their squares:
    (3, n1, columns), twisted."""
    columns = chunk * split.columns + np.arange(split.columns)
    x = np.zeros((3, split.n1, split.columns))
    at = t // split.n2, t % split.n2 - columns[0]
    x[0][at], x[1][at], x[2][at] = 1.0, v, v * v
    return np.fft.fft(x, axis=1) * split.twist(np.arange(split.n1), columns, -1)


def across(split: Split, chunk: int, x: np.ndarray) -> np.ndarray:
    """(3, rows, n2) twisted columns to the same of the pair sums, on their way back. The sums are
    real, so two share one transform: n and sxy, sx and sy, sxx and syy."""
    rows = chunk * split.rows + np.arange(split.rows)
    m, z, q = np.fft.fft(x, axis=2)
    pairs = np.stack([m * m.conj() + 1j * z * z.conj(), z * m.conj() + 1j * m * z.conj(), q * m.conj() + 1j * m * q.conj()])
    return np.fft.ifft(pairs, axis=2) * split.twist(rows, np.arange(split.n2), 1)


def up(split: Split, chunk: int, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(3, n1, columns) to ``lag`` and the (n, sx, sy, sxx, syy, sxy) of each, up to ``lags``."""
    columns = chunk * split.columns + np.arange(split.columns)
    sums = np.fft.ifft(x, axis=1)
    lag = np.arange(split.n1)[:, None] * split.n2 + columns[None, :]
    keep = lag <= lags
    s = sums[:, keep]
    return lag[keep], np.stack([s[0].real, s[1].real, s[1].imag, s[2].real, s[2].imag, s[0].imag], axis=1)


def pieces(x: np.ndarray, axis: int, width: int) -> list[list[float]]:
    """``x`` cut along ``axis`` into parts of ``width``, each as plain numbers."""
    return [np.ascontiguousarray(p).view(float).ravel() for p in np.split(x, x.shape[axis] // width, axis=axis)]


def joined(parts: list[np.ndarray], shape: tuple[int, int], axis: int) -> np.ndarray:
    """The inverse of :func:`pieces` in order; ``shape`` is that of a part."""
    return np.concatenate([np.asarray(p, float).view(complex).reshape(3, *shape) for p in parts], axis=axis)
