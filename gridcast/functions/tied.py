"""A stack of tied sigmoid layers over a row of many cells, cells split over tasks (numpy).

The first layer's weights belong to cells and are split with them; all other parameters are
small and the same in every task. Two sums over the cells make a step: the units' inputs, and
what flows back to the units.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


def sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * a) + 1.0)


@dataclass
class Stack:
    """``w`` (cells, units) and ``c`` (cells) of this task's cells; ``b`` of the first units;
    ``inner``: weights, encoder bias and decoder bias of the further layers, outermost first."""
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray
    inner: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def step(self, x: np.ndarray, seen: np.ndarray, lr: float, total: Callable[[np.ndarray], np.ndarray]) -> float:
        """One descent step on a batch ``x`` (slots, cells), of which the encoder is shown ``seen``.
        ``total`` sums an array over all tasks. The batch's cost before the step."""
        up = [sigmoid(total(seen @ self.w) + self.b)]
        for w, b, _ in self.inner:
            up.append(sigmoid(up[-1] @ w + b))
        down = [up[-1]]
        for w, _, c in reversed(self.inner):
            down.append(sigmoid(down[-1] @ w.T + c))
        u = down[-1]
        y = sigmoid(u @ self.w.T + self.c)
        dy = 2.0 * (y - x) * y * (1.0 - y)
        back = np.concatenate([dy @ self.w, ((y - x) ** 2).sum(axis=1, keepdims=True)], axis=1)
        back = total(back)
        d, cost = back[:, :-1], float(back[:, -1].sum())
        moves = [[np.zeros_like(p) for p in layer] for layer in self.inner]
        for i, (w, _, _) in enumerate(self.inner):               # decoder, from the outside in
            d = d * down[len(self.inner) - i] * (1.0 - down[len(self.inner) - i])
            moves[i][2] += d.sum(axis=0)
            moves[i][0] += d.T @ down[len(self.inner) - i - 1]
            d = d @ w
        for i in reversed(range(len(self.inner))):               # encoder, from the inside out
            d = d * up[i + 1] * (1.0 - up[i + 1])
            moves[i][1] += d.sum(axis=0)
            moves[i][0] += up[i].T @ d
            d = d @ self.inner[i][0].T
        d = d * up[0] * (1.0 - up[0])
        self.w = self.w - lr * (seen.T @ d + dy.T @ u)
        self.c = self.c - lr * dy.sum(axis=0)
        self.b = self.b - lr * d.sum(axis=0)
        self.inner = [tuple(p - lr * g for p, g in zip(layer, move)) for layer, move in zip(self.inner, moves)]
        return cost

    def small(self) -> np.ndarray:
        """The parameters that all tasks share, as one array."""
        return np.concatenate([self.b, *[p.ravel() for layer in self.inner for p in layer]])


def from_small(flat: np.ndarray, units: list[int]) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """``b`` and ``inner`` out of :meth:`Stack.small`."""
    flat = np.asarray(flat, float)
    b, at, inner = flat[:units[0]], units[0], []
    for n, k in zip(units, units[1:]):
        cuts = np.cumsum([at, n * k, k, n])
        inner.append((flat[cuts[0]:cuts[1]].reshape(n, k), flat[cuts[1]:cuts[2]], flat[cuts[2]:cuts[3]]))
        at = cuts[3]
    return b, inner


def mask_bits(cell_keys: np.ndarray, slots: np.ndarray, epoch: int) -> np.ndarray:
    """0 or 1 for each slot and cell, by a hash of epoch, slot and the cell's key."""
    with np.errstate(over="ignore"):
        x = cell_keys.view(np.uint64)[None, :] ^ _mixed(slots.astype(np.uint64) + (np.uint64(epoch) << np.uint64(40)))[:, None]
        return (_mixed(x) >> np.uint64(63)).astype(float)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
