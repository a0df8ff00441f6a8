"""Very many pairs as moments of cells of their differences, so that an evaluation does not grow with the pairs.

Pairs of the same two segments whose differences lie in one cell of an even grid are taken together: of each cell the
sums of the Chebyshev polynomials up to a total degree of ``DEGREE`` are kept (``KEPT`` numbers, their first is the number
of pairs). The Gaussian of a cell is a product of three functions of one axis; its values at the Chebyshev nodes give the
coefficients that meet the sums, for every drift and every width not below the cells' size. There the series is off by
less than 1e-8 of the kernel's peak a pair, and by less at larger widths. Every pair counts; a cell of few pairs keeps
them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE = 9
_N = DEGREE + 1
_ANGLES = np.pi * (np.arange(_N) + 0.5) / _N
NODES = np.cos(_ANGLES)
#: Values at the nodes times this are the coefficients of the Chebyshev series.
_SERIES = np.cos(np.outer(_ANGLES, np.arange(_N))) * np.where(np.arange(_N), 2.0, 1.0) / _N
_A, _B = (np.array(v) for v in zip(*((a, b) for a in range(_N) for b in range(_N - a)), strict=True))
_AT, _C = np.nonzero(_A[:, None] + _B[:, None] + np.arange(_N) <= DEGREE)
#: Where the products with each polynomial of the first axis begin.
_ROWS = np.flatnonzero(_B == 0)
_KA, _KB, _KC = _A[_AT], _B[_AT], _C
#: Numbers kept of a cell; cells of fewer pairs than take as much room are kept as pairs.
KEPT = _C.size
FEW_PAIRS = KEPT // 3 + 1
#: Pairs taken together in a task, cells that it holds, pairs whose polynomials are made and that are multiplied at a time.
CHUNK, MOST, TURN, STEP = 1 << 20, 1 << 15, 2048, 256


@dataclass(frozen=True)
class Grid:
    """Cells of differences up to ``radius`` on each axis, for so many segments."""

    size: float
    radius: float
    segments: int

    @property
    def per_axis(self) -> int:
        return 2 * (int(self.radius / self.size) + 2)

    @property
    def fits(self) -> bool:
        """Whether two segments and a cell fit into one number of 62 bits."""
        return self.segments**2 * self.per_axis**3 < 1 << 62

    def keys(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
        key = i.astype(np.int64) * self.segments + j
        for x in d:
            key = key * self.per_axis + (np.floor(x / self.size).astype(np.int64) + self.per_axis // 2)
        return key

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two segments, and the middles of the cells (a row per axis)."""
        middle = np.empty((3, keys.size))
        for k in (2, 1, 0):
            keys, at = np.divmod(keys, self.per_axis)
            middle[k] = (at - self.per_axis // 2 + 0.5) * self.size
        return keys // self.segments, keys % self.segments, middle


def _polynomials(t: np.ndarray, out: np.ndarray) -> np.ndarray:
    out[0], out[1] = 1.0, t
    twice = 2.0 * t
    for k in range(2, _N):
        np.multiply(twice, out[k - 1], out=out[k])
        out[k] -= out[k - 2]
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of the keys, equal ones as they come: by 16 bits at a time where they span no more than 48."""
    low = keys.min()
    span = int(keys.max()) - int(low)
    if span >> 48:
        return np.argsort(keys, kind="stable")
    rest = keys - low
    order = np.argsort(rest.astype(np.uint16), kind="stable")
    for shift in range(16, span.bit_length(), 16):
        order = order[np.argsort((rest >> shift).astype(np.uint16)[order], kind="stable")]
    return order


def moments(keys: np.ndarray, first: np.ndarray, d: np.ndarray, grid: Grid) -> np.ndarray:
    """The sums of the cells that begin at ``first`` among pairs in order of their keys: a row per cell."""
    out = np.zeros((first.size, _A.size, _N))
    ends, middles = np.append(first[1:], keys.size), grid.places(keys[first])[2]
    # used again at every turn, as fresh arrays of this size would be new pages; a line wider, lest rows share cache sets
    room, products = np.empty((_N, 3, TURN + 8)), np.empty((_A.size, TURN + 8))
    lo = 0
    while lo < first.size:  # some thousand pairs at a time, so that their polynomials stay in the cache
        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + TURN, "right")))
        for begin in range(first[lo], ends[hi - 1], TURN):  # one turn, unless a single cell is larger
            end = min(begin + TURN, ends[hi - 1])
            middle = np.repeat(middles[:, lo:hi], np.minimum(ends[lo:hi], end) - np.maximum(first[lo:hi], begin), axis=1)
            x, y, z = _polynomials((d[:, begin:end] - middle) * (2.0 / grid.size), room[:, :, : end - begin]).swapaxes(0, 1)
            xy = products[:, : end - begin]
            for a, at in enumerate(_ROWS):
                np.multiply(x[a], y[: _N - a], out=xy[at : at + _N - a])
            for c in range(lo, hi):
                for s in range(max(first[c], begin), min(ends[c], end), STEP):
                    e = min(s + STEP, ends[c], end)
                    out[c] += xy[:, s - begin : e - begin] @ z[:, s - begin : e - begin].T
        lo = hi
    return out[:, _AT, _C]


class Merger:
    """Takes in pairs and moments, in any order, and holds moments of the cells with many pairs and the pairs of others."""

    def __init__(self, grid: Grid):
        self.grid, self.pairs, self.n = grid, [], 0
        self._clear()

    def _clear(self) -> None:
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros((0, KEPT))

    def add_moments(self, keys: np.ndarray, sums: np.ndarray) -> None:
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        out = np.zeros((both.size, KEPT))
        out[at[: self.keys.size]] = self.sums
        np.add.at(out, at[self.keys.size :], sums)
        self.keys, self.sums = both, out

    def add_pairs(self, keys: np.ndarray, d: np.ndarray) -> None:
        self.pairs.append((keys, d))
        self.n += keys.size

    def fold(self) -> None:
        """Pairs become moments where their cell has moments already, or enough pairs."""
        if not self.n:
            return
        keys, d = np.concatenate([k for k, _ in self.pairs]), np.concatenate([d for _, d in self.pairs], 1)
        order = _order(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        many = np.diff(np.append(first, keys.size))
        dense = (many >= FEW_PAIRS) | np.isin(keys[first], self.keys)
        rows = np.repeat(dense, many)
        if dense.any():
            taken = keys[rows]
            begin = np.cumsum(many[dense]) - many[dense]
            self.add_moments(taken[begin], moments(taken, begin, np.take(d, order[rows], axis=1), self.grid))
        self.pairs, self.n = [(keys[~rows], np.take(d, order[~rows], axis=1))], int((~rows).sum())

    def taken(self, last: bool = False):
        """(keys, sums, keys of pairs, pairs) to hand on, where too much is held, or all at the end."""
        none = (np.zeros(0, np.int64), np.zeros((0, KEPT)), np.zeros(0, np.int64), np.zeros((3, 0)))
        if not last and self.n < CHUNK and self.keys.size < MOST:
            return None
        self.fold()
        out = list(none)
        if last or self.keys.size >= MOST:
            out[0], out[1] = self.keys, self.sums
            self._clear()
        if self.n and (last or self.n >= CHUNK // 2):
            out[2], out[3] = self.pairs[0]
            self.pairs, self.n = [], 0
        return out


class Cells:
    """The cells of one block: their segments, middles and sums."""

    def __init__(self, data: bytes, grid: Grid):
        n = memoryview(data).nbytes // (8 * (KEPT + 1))
        self.grid = grid
        self.i, self.j, self.middle = grid.places(np.frombuffer(data, "<i8", n))
        self.sums = np.frombuffer(data, "<f8", offset=8 * n).reshape(n, KEPT)

    @staticmethod
    def packed(keys: np.ndarray, sums: np.ndarray) -> bytes:
        return keys.astype("<i8").tobytes() + sums.astype("<f8").tobytes()

    def weights(self, mu: np.ndarray, scale: float):
        """By some cells at a time: which, the sum of exp(-|e|^2 / scale) over their pairs, and of that times e by axis."""
        for lo in range(0, self.i.size, STEP):
            at = slice(lo, lo + STEP)
            u = (self.middle[:, at] - (mu[self.i[at]] - mu[self.j[at]]).T)[:, :, None] + NODES * (self.grid.size / 2.0)
            g = np.exp(u * u * (-1.0 / scale))
            (x, y, z), (fx, fy, fz) = g @ _SERIES, (g * u) @ _SERIES
            m, x, y, z = self.sums[at], x[:, _KA], y[:, _KB], z[:, _KC]
            mx, yz = m * x, y * z
            add = lambda a, b: np.einsum("ij,ij->i", a, b)
            yield at, add(mx, yz), np.stack([add(m * fx[:, _KA], yz), add(mx * fy[:, _KB], z), add(mx * y, fz[:, _KC])])
