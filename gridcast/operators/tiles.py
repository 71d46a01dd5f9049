"""Pairs of cells by tiles: a task holds two groups of cells and multiplies them piece by piece."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from gridcast.functions.scale_out import row_groups

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
HELD = 32 << 20            # bytes of one group of cells in a task
ROWS_OUT = 1 << 15         # of one batch handed back to Spark
RUN = 32                   # pairs that are followed by their mirror images


def group_cells(cells: int, slots: int, cores: int, group: int, held: int = HELD) -> int:
    """Cells per group: each is copied once per group, so few and large ones. Bounded by the memory
    of their values (or of the sums of a pair of groups, if the values are walked block by block),
    and by the tiles that ``cores`` need for an even load."""
    fits = max(held // (8 * max(slots, 1)), math.isqrt(held // 24))
    return max(group, min(fits, math.ceil(cells / math.ceil(math.sqrt(8 * cores)))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The six sums of all pairs of rows over the columns that both know."""
    missing_a, missing_b = np.isnan(a), np.isnan(b)
    if not missing_a.any() and not missing_b.any():
        out = np.empty((6, len(a), len(b)))
        out[0] = a.shape[1]
        out[1], out[2] = a.sum(axis=1)[:, None], b.sum(axis=1)
        out[3], out[4] = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)
        out[5] = a @ b.T
        return out
    ha, hb = (~missing_a).astype(float), (~missing_b).astype(float)
    a, b = np.where(missing_a, 0.0, a), np.where(missing_b, 0.0, b)
    return np.array([ha @ hb.T, a @ hb.T, ha @ b.T, (a * a) @ hb.T, ha @ (b * b).T, a @ b.T])


class PairSums:
    """Running sums of all pairs of two cell groups over slot blocks; cells may lack blocks."""

    def __init__(self, same: bool):
        self.same, self.rows, self.cols, self.sums = same, {}, {}, np.zeros((6, 0, 0))

    def add(self, a_ids, a: np.ndarray, b_ids, b: np.ndarray) -> None:
        i = np.array([self.rows.setdefault(c, len(self.rows)) for c in a_ids], np.int64)
        j = np.array([self.cols.setdefault(c, len(self.cols)) for c in b_ids], np.int64)
        grow = [max(0, len(ids) - have) for ids, have in zip((self.rows, self.cols), self.sums.shape[1:])]
        if any(grow):
            self.sums = np.pad(self.sums, [(0, 0), (0, grow[0]), (0, grow[1])])
        self.sums[:, i[:, None], j[None, :]] += products(a, b)

    def frame(self) -> pd.DataFrame:
        a, b = np.array(list(self.rows), object), np.array(list(self.cols), object)
        met = self.sums[0] > 0
        if self.same:
            met &= a[:, None] <= b[None, :]
        i, j = np.nonzero(met)
        cols = {"cell_a": a[i], "cell_b": b[j], "n": self.sums[0, i, j].astype("int64")}
        return pd.DataFrame(cols | {name: m[i, j] for name, m in zip(SUMS[1:], self.sums[1:])})


def pearson_of(sums: np.ndarray) -> np.ndarray:
    """``exprs.pearson`` of arrays; NaN where a side does not vary."""
    n, sx, sy, sxx, syy, sxy = sums
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    varies = (n > 1) & (vx > 1e-13 * sxx) & (vy > 1e-13 * syy)
    r = (sxy - sx * sy / n) / np.sqrt(np.where(varies, vx * vy, 1.0))
    return np.where(varies, r, np.nan)


def _planes(x: np.ndarray, kind: str) -> bytes:
    """First all first bytes, then all second ones, and so on: equal exponents and signs come together."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T).tobytes()


def _from_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def closed_up(off, x) -> bytes:
    """A packed row in few bytes, for what is shuffled many times over; no bit is lost.

    Values of few digits are short in planes, values that come again and again as a whole; the shorter of
    the two counts, the first byte tells which.
    """
    off, x = _planes(np.diff(np.asarray(off, np.int64), prepend=0), "<i4"), np.asarray(x, "<f8")
    forms = (b"p", _planes(x, "<f8")), (b"w", x.tobytes())
    return min((form + zlib.compress(off + values, 1) for form, values in forms), key=len)


def opened(z: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(off, x)`` of :func:`closed_up`."""
    raw = np.frombuffer(zlib.decompress(z[1:]), np.uint8)
    n = len(raw) // 12
    x = _from_planes(raw[4 * n:], "<f8") if z[:1] == b"p" else raw[4 * n:].view("<f8")
    return np.cumsum(_from_planes(raw[:4 * n], "<i4"), dtype=np.int32), x


def close_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(cell_id, blk, off, x)`` to ``(cell_id, blk, z)``."""
    for batch in batches:
        cell, blk, off, x = (batch.column(c) for c in ("cell_id", "blk", "off", "x"))
        starts, offs, xs = off.offsets.to_numpy(), off.values.to_numpy(), x.values.to_numpy()
        first = x.offsets.to_numpy() - starts
        z = [closed_up(offs[a:b], xs[a + d:b + d]) for a, b, d in zip(starts[:-1], starts[1:], first)]
        yield pa.RecordBatch.from_arrays([cell, blk, pa.array(z, pa.binary())], ["cell_id", "blk", "z"])


def _open_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Closed rows as packed ones again, less the mean ``m`` of their cell where there is one."""
    rows = [opened(z) for z in pdf["z"]]
    x = [v for _, v in rows]
    if "m" in pdf:
        x = [v - m for v, m in zip(x, pdf["m"])]
    return pdf.assign(off=pd.Series([o for o, _ in rows], pdf.index, object), x=pd.Series(x, pdf.index, object)).drop(columns="z")


def _dense(pdf: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, the first row of each and their values on the slots that any of them knows, NaN elsewhere."""
    row, ids = pd.factorize(pdf["cell_id"])
    first = np.unique(row, return_index=True)[1]
    lengths = [len(o) for o in pdf["off"]]
    at = np.concatenate(pdf["off"].to_numpy()).astype(np.int64) + np.repeat(pdf["blk"].to_numpy(np.int64) * size, lengths)
    at -= at.min()
    x = np.full((len(ids), at.max() + 1), np.nan)
    x[np.repeat(row, lengths), at] = np.concatenate(pdf["x"].to_numpy())
    return np.asarray(ids, object), first, x


class _Side:
    """The cells of one group in the order in which they came, cut into pieces of ``group``."""

    def __init__(self, group: int):
        self.group, self.at, self.bounds = group, {}, None

    def names(self) -> np.ndarray:
        return np.array(list(self.at), object)

    def pieces(self, ids: np.ndarray, x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``(piece, places of its cells, values)``."""
        place = np.array([self.at.setdefault(c, len(self.at)) for c in ids], np.int64)
        order = np.argsort(place, kind="stable")
        piece = place[order] // self.group
        cuts = np.flatnonzero(np.diff(piece)) + 1
        return [(int(place[o[0]] // self.group), place[o], x[o]) for o in np.split(order, cuts) if len(o)]


def tile_pairs(blocks: Iterable[pd.DataFrame], ga, gb, group: int, size: int, whole: bool, may=None) \
        -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(names a, names b, i, j, six sums)`` of the pairs of cells of one tile, each pair once.

    ``whole``: the tile comes as one frame, so a piece is done after one product. Otherwise the sums of
    all pieces are held. ``may(left rows, right rows)`` tells which pairs are wanted; pieces without
    any are not multiplied.
    """
    same = ga == gb
    a, b = _Side(group), _Side(group)
    b = a if same else b
    held: dict[tuple[int, int], list] = {}
    wanted: dict[str, tuple] = {}
    for pdf in blocks:
        ids, first, x = _dense(pdf, size)
        g = pdf["_g"].to_numpy()[first]
        if may:
            wanted.update(zip(ids, zip(pdf["c"].to_numpy()[first], pdf["rest"].to_numpy()[first])))
        left = a.pieces(ids[g == ga], x[g == ga])
        right = left if same else b.pieces(ids[g == gb], x[g == gb])
        names = a.names(), b.names()
        for k, i, xa in left:
            for m, j, xb in right:
                if same and k > m:
                    continue
                hit = may([wanted[c] for c in names[0][i]], [wanted[c] for c in names[1][j]]) if may \
                    else np.ones((len(i), len(j)), bool)
                rows, cols = hit.any(axis=1), hit.any(axis=0)
                if not rows.any():
                    continue
                i_, j_, hit = i[rows], j[cols], hit[np.ix_(rows, cols)]
                sums = products(xa[rows], xb[cols])
                if whole:
                    yield _of_piece(names, i_, j_, sums, hit, same and k == m)
                    continue
                if (k, m) not in held:
                    held[k, m] = [np.zeros((6, group, group)), np.zeros((group, group), bool)]
                into = np.ix_(i_ - k * group, j_ - m * group)
                held[k, m][0][:, into[0], into[1]] += sums
                held[k, m][1][into] |= hit
    names = a.names(), b.names()
    for (k, m), (sums, hit) in held.items():
        na, nb = (min(group, len(n) - p * group) for n, p in zip(names, (k, m)))
        yield _of_piece(names, np.arange(na) + k * group, np.arange(nb) + m * group, sums[:, :na, :nb], hit[:na, :nb], same and k == m)


def _of_piece(names, i, j, sums, hit, same: bool):
    met = hit & (sums[0] > 0)
    if same:
        met &= names[0][i][:, None] <= names[1][j][None, :]
    p, q = np.nonzero(met)
    return names[0], names[1], i[p], j[q], sums[:, p, q]


def in_both_orders(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(pair, mirrored)`` of the rows to give: a cell with itself once, all other pairs in both orders.

    A run of pairs is followed by its mirror images, so that within a short way a value comes back and
    one cell stays while the other ones come in the same order: few bytes for whoever writes the rows.
    """
    other = np.flatnonzero(left != right)
    pair, mirrored = np.concatenate([np.arange(len(left)), other]), np.repeat([False, True], [len(left), len(other)])
    order = np.argsort(pair // RUN * 2 + mirrored, kind="stable")
    return pair[order], mirrored[order]


def pairs_of_tiles(batches: Iterable[pa.RecordBatch], group: int, size: int, whole: bool, shared: bool,
                   least: float | None = None, may=None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``_ga, _gb, _s, blk`` to ``(cell_a, cell_b, r, n)`` in both orders, or, if the blocks of a
    tile are ``shared`` by tasks, to the six sums, each pair once. Pairs below ``least`` are left out."""
    key = ["_ga", "_gb", "_s"]
    frames = map(_open_rows, row_groups((batch.to_pandas() for batch in batches), key if whole else [*key, "blk"]))
    ahead = next(frames, None)
    while ahead is not None:
        here = tuple(ahead[key].iloc[0])

        def blocks():
            nonlocal ahead
            while ahead is not None and tuple(ahead[key].iloc[0]) == here:
                yield ahead
                ahead = next(frames, None)

        known: list = [(-1, -1)]

        def coded(a, b):
            """Numbers of the names of both sides, and the names as Arrow; made once as long as none come in addition."""
            if known[0] != (len(a), len(b)):
                code, names = pd.factorize(np.concatenate([a, b]))
                known[:] = (len(a), len(b)), code[:len(a)], code[len(a):], pa.array(names, pa.string())
            return known[1:]

        def batch(kept):
            """One batch of what has been gathered."""
            of_a, of_b, names = coded(kept[-1][0], kept[-1][1])
            i, j = (np.concatenate([k[c] for k in kept]) for c in (2, 3))
            sums = np.concatenate([k[4] for k in kept], axis=1)
            left, right, n = of_a[i], of_b[j], sums[0].astype(np.int64)
            if shared:
                return pa.RecordBatch.from_arrays([names.take(pa.array(left)), names.take(pa.array(right)), pa.array(n),
                                                   *[pa.array(s) for s in sums[1:]]], ["cell_a", "cell_b", *SUMS])
            r = pearson_of(sums)
            pair, mirrored = in_both_orders(left, right)
            cells = [names.take(pa.array(np.where(mirrored, y[pair], x[pair]))) for x, y in ((left, right), (right, left))]
            return pa.RecordBatch.from_arrays([*cells, pa.array(r[pair], mask=np.isnan(r[pair])), pa.array(n[pair])],
                                              ["cell_a", "cell_b", "r", "n"])

        kept, count = [], 0
        for a, b, i, j, sums in tile_pairs(blocks(), here[0], here[1], group, size, whole, may):
            if least is not None and not shared:
                high = np.abs(pearson_of(sums)) >= least
                i, j, sums = i[high], j[high], sums[:, high]
            if len(i):
                kept.append((a, b, i, j, sums))
                count += len(i)
            if count >= ROWS_OUT:
                yield batch(kept)
                kept, count = [], 0
        if kept:
            yield batch(kept)
