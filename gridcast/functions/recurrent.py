"""One recurrent layer between two affine maps: forward, gradient, Adam (numpy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    inputs: int = 3
    cell: int = 10
    outputs: int = 1

    def shapes(self) -> dict[str, tuple[int, ...]]:
        i, c, o = self.inputs, self.cell, self.outputs
        return {"w_in": (i, c), "b_in": (c,), "k": (2 * c, 4 * c), "b": (4 * c,),
                "w_out": (c, o), "b_out": (o,)}

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            out[name] = flat[at:at + n].reshape(shape)
            at += n
        return out

    def join(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.asarray(parts[n]).ravel() for n in self.shapes()])


def initial(shape: Shape, kind: str, scale: float, bias: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    draw = (lambda s: rng.uniform(0.0, scale, s)) if kind == "uniform" else \
        (lambda s: rng.normal(0.0, scale, s))
    s = shape.shapes()
    edge = np.sqrt(6.0 / sum(s["k"]))
    return shape.join({"w_in": draw(s["w_in"]), "b_in": np.full(s["b_in"], bias),
                       "k": rng.uniform(-edge, edge, s["k"]), "b": np.zeros(s["b"]),
                       "w_out": draw(s["w_out"]), "b_out": np.full(s["b_out"], bias)})


def _sig(a):
    return 0.5 * (np.tanh(0.5 * a) + 1.0)


def forward(p: dict, x: np.ndarray, c: np.ndarray, h: np.ndarray, keep: bool = False):
    """x (lanes, steps, inputs) -> predictions, final (c, h), trace for the gradient."""
    n = c.shape[1]
    u = x @ p["w_in"] + p["b_in"]
    out, trace = np.empty((*x.shape[:2], p["w_out"].shape[1])), []
    for t in range(x.shape[1]):
        xh = np.concatenate([u[:, t], h], axis=1)
        g = xh @ p["k"] + p["b"]
        i, j = _sig(g[:, :n]), np.tanh(g[:, n:2 * n])
        f, o = _sig(g[:, 2 * n:3 * n] + 1.0), _sig(g[:, 3 * n:])     # forget bias 1
        before, c = c, c * f + i * j
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h @ p["w_out"] + p["b_out"]
        if keep:
            trace.append((xh, i, j, f, o, before, tc, h))
    return out, c, h, trace


def gradient(p: dict, x, y, c, h):
    """Cost sum((pred - y)^2) / lanes, its gradient, and the final state."""
    out, c_end, h_end, trace = forward(p, x, c, h, keep=True)
    lanes, n = x.shape[0], c.shape[1]
    d_out = 2.0 * (out - y) / lanes
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dh_next, dc_next = np.zeros_like(h), np.zeros_like(c)
    du = np.empty((*x.shape[:2], n))
    for t in reversed(range(x.shape[1])):
        xh, i, j, f, o, before, tc, ht = trace[t]
        g["w_out"] += ht.T @ d_out[:, t]
        g["b_out"] += d_out[:, t].sum(0)
        dh = d_out[:, t] @ p["w_out"].T + dh_next
        dc = dh * o * (1.0 - tc * tc) + dc_next
        gates = np.concatenate([dc * j * i * (1.0 - i), dc * i * (1.0 - j * j),
                                dc * before * f * (1.0 - f), dh * tc * o * (1.0 - o)], axis=1)
        g["k"] += xh.T @ gates
        g["b"] += gates.sum(0)
        dxh = gates @ p["k"].T
        du[:, t], dh_next, dc_next = dxh[:, :n], dxh[:, n:], dc * f
    g["w_in"] += np.einsum("lti,ltc->ic", x, du)
    g["b_in"] += du.sum((0, 1))
    return float(((out - y) ** 2).sum() / lanes), g, c_end, h_end


def adam(flat, grad, m, v, step: int, lr: float):
    """In place; beta .9/.999, eps 1e-8."""
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    rate = lr * np.sqrt(1.0 - 0.999 ** step) / (1.0 - 0.9 ** step)
    flat -= rate * m / (np.sqrt(v) + 1e-8)
