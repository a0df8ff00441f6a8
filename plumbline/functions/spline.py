"""Coefficients of cubic splines. There is a row per segment, so they are solved on the driver; evaluation is distributed."""

from __future__ import annotations

import numpy as np


def _solve(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A tridiagonal system, with several right-hand sides in the columns of d (Thomas' elimination)."""
    b, d = b.astype(float).copy(), d.astype(float).copy()
    for i in range(1, b.size):
        f = a[i] / b[i - 1]
        b[i] -= f * c[i - 1]
        d[i] -= f * d[i - 1]
    x = np.empty_like(d)
    x[-1] = d[-1] / b[-1]
    for i in range(b.size - 2, -1, -1):
        x[i] = (d[i] - c[i] * x[i + 1]) / b[i]
    return x


def second_derivatives(x: np.ndarray, y: np.ndarray, natural: bool) -> np.ndarray:
    """At the knots. Otherwise than ``natural``: not-a-knot, which is a line for two knots and a parabola for three."""
    n, h = x.size, np.diff(x)
    m = np.zeros_like(y)
    if n < 3:
        return m
    slope = np.diff(y, axis=0) / h[:, None]
    if n == 3 and not natural:
        m[:] = 2 * (slope[1] - slope[0]) / (x[2] - x[0])
        return m
    a, b, c = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    d = 6 * np.diff(slope, axis=0)
    if not natural:  # M0 = M1 + h0 / h1 (M1 - M2), and the same from the other end, put into the inner equations
        r, s = h[0] / h[1], h[-1] / h[-2]
        b[0] += h[0] * (1 + r)
        c[0] -= h[0] * r
        b[-1] += h[-1] * (1 + s)
        a[-1] -= h[-1] * s
    m[1:-1] = _solve(a, b, c, d)
    if not natural:
        m[0] = m[1] + r * (m[1] - m[2])
        m[-1] = m[-2] + s * (m[-2] - m[-3])
    return m


def pieces(x: np.ndarray, y: np.ndarray, natural: bool = False, straight_ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where each cubic piece begins, and its coefficients (pieces, axes, powers 0 to 3) around that point.

    One knot gives a constant. ``straight_ends`` carries the end slopes on as lines.
    """
    x, y = np.asarray(x, float), np.asarray(y, float).reshape(len(x), -1)
    if x.size == 0:
        raise ValueError("no knots")
    if x.size == 1:
        return x, np.stack([y, *[np.zeros_like(y)] * 3], 2)
    if (np.diff(x) <= 0).any():
        raise ValueError("knots must ascend")
    h, m = np.diff(x)[:, None], second_derivatives(x, y, natural)
    c = np.stack([y[:-1], (y[1:] - y[:-1]) / h - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, (m[1:] - m[:-1]) / (6 * h)], 2)
    start = x[:-1]
    if straight_ends:
        end = c[-1, :, 1] + h[-1] * (2 * c[-1, :, 2] + 3 * h[-1] * c[-1, :, 3])
        line = lambda v, s: np.stack([v, s, np.zeros_like(v), np.zeros_like(v)], 1)[None]
        before = line(y[0] - (x[1] - x[0]) * c[0, :, 1], c[0, :, 1])
        start, c = np.concatenate([[2 * x[0] - x[1]], start, [x[-1]]]), np.concatenate([before, c, line(y[-1], end)])
    return start, c


def evaluate(start: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """On the driver, for a few points: (points, axes)."""
    k = np.clip(np.searchsorted(start, at, "right") - 1, 0, start.size - 1)
    t = (np.asarray(at, float) - start[k])[:, None]
    p = c[k]
    return ((p[:, :, 3] * t + p[:, :, 2]) * t + p[:, :, 1]) * t + p[:, :, 0]
