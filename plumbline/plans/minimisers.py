"""Minimisers for objectives that cost a job an evaluation. They run on the driver over three numbers per segment.

``lbfgsb`` follows Byrd, Lu, Nocedal and Zhu (1995): the quadratic model of limited memory in compact form, its first
minimum along the projected gradient (the generalized Cauchy point), minimisation over what is free there, and a line
search for the strong Wolfe conditions after Moré and Thuente (1994). ``dfp`` is the unbounded variant: the whole inverse
Hessian, updated by BFGS, with cubic backtracking. ``projected`` is a plain bounded one to compare with.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]
EPS = float(np.finfo(float).eps)


class _Model:
    """B = theta I - W M W', from the last steps and changes of the gradient."""

    def __init__(self, n: int, memory: int):
        self.n, self.memory = n, memory
        self.forget()

    def forget(self) -> None:
        self.s, self.y, self.theta = [], [], 1.0
        self.w, self.m = np.zeros((self.n, 0)), np.zeros((0, 0))

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        if s @ y <= EPS * (y @ y):
            return  # no curvature to learn from
        self.s, self.y = [*self.s, s][-self.memory :], [*self.y, y][-self.memory :]
        self.theta = float(y @ y) / float(s @ y)
        sm, ym = np.stack(self.s, 1), np.stack(self.y, 1)
        sy = sm.T @ ym
        low = np.tril(sy, -1)
        self.w = np.hstack([ym, self.theta * sm])
        try:
            self.m = np.linalg.inv(np.block([[-np.diag(np.diag(sy)), low.T], [low, self.theta * (sm.T @ sm)]]))
        except np.linalg.LinAlgError:
            self.forget()

    def cauchy(self, x: np.ndarray, g: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
        """The first minimum of the model along the gradient bent at the bounds, and W' of the way there."""
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(g < 0, (x - hi) / g, np.where(g > 0, (x - lo) / g, np.inf))
        d = np.where(t > 0, -g, 0.0)
        at, p, c = x.copy(), self.w.T @ d, np.zeros(self.w.shape[1])
        slope = -float(d @ d)
        bend = first = -self.theta * slope - float(p @ self.m @ p)
        best, now = (-slope / bend if bend > 0 else 0.0), 0.0
        order = np.flatnonzero((t > 0) & np.isfinite(t))
        for b in order[np.argsort(t[order], kind="stable")]:
            if best < t[b] - now:
                break
            dt, now = t[b] - now, t[b]
            at[b] = hi if d[b] > 0 else lo
            z, gb, wb = at[b] - x[b], g[b], self.w[b]
            c += dt * p
            slope += dt * bend + gb * gb + self.theta * gb * z - gb * float(wb @ self.m @ c)
            bend -= self.theta * gb * gb + 2 * gb * float(wb @ self.m @ p) + gb * gb * float(wb @ self.m @ wb)
            bend = max(bend, EPS * first)
            p = p + gb * wb
            d[b] = 0.0
            best = -slope / bend if bend > 0 else 0.0
        best = max(best, 0.0)
        moving = d != 0
        at[moving] = np.clip(x[moving] + (now + best) * d[moving], lo, hi)
        return at, c + best * p

    def over_free(self, x: np.ndarray, g: np.ndarray, at: np.ndarray, c: np.ndarray, lo: float, hi: float) -> np.ndarray:
        """The model's minimum over the variables that are within their bounds at the Cauchy point, brought within them."""
        free = (at > lo) & (at < hi)
        if not free.any() or not self.s:
            return at
        r = (g + self.theta * (at - x) - self.w @ (self.m @ c))[free]
        wz = self.w[free]
        v = self.m @ (wz.T @ r)
        try:
            v = np.linalg.solve(np.eye(v.size) - self.m @ (wz.T @ wz) / self.theta, v)
        except np.linalg.LinAlgError:
            return at
        step = -r / self.theta - wz @ v / self.theta**2
        out = at.copy()
        out[free] = np.clip(at[free] + step, lo, hi)
        if (out - x) @ g < 0:
            return out
        with np.errstate(divide="ignore"):  # the bent step does not lead down: a shorter straight one does
            room = np.where(step > 0, (hi - at[free]) / step, np.where(step < 0, (lo - at[free]) / step, np.inf))
        out[free] = at[free] + min(1.0, float(room.min())) * step
        return np.clip(out, lo, hi)


def _cubic(a: float, fa: float, ga: float, b: float, fb: float, gb: float) -> float:
    """Where the cubic through two places with slopes has its minimum; NaN if it has none."""
    d1 = ga + gb - 3 * (fa - fb) / (a - b)
    square = d1 * d1 - ga * gb
    if square < 0:
        return float("nan")
    d2 = np.copysign(np.sqrt(square), b - a)
    under = gb - ga + 2 * d2
    return b - (b - a) * (gb + d2 - d1) / under if under else float("nan")


def strong_wolfe(phi: Callable[[float], tuple[float, float]], f0: float, g0: float, step: float, most: float, trials: int = 40, down: float = 1e-3, flat: float = 0.9, close: float = 0.1) -> float | None:
    """A step with enough descent and a slope flat enough, from values and slopes of ``phi``; None if none is found.

    The interval [a, b] holds such a step once the best place a and a worse one b enclose it; until then steps grow.
    While no step has shown enough descent with a rising slope, the function less the line of least descent stands in.
    """
    a, fa, ga = 0.0, f0, g0
    b, fb, gb = 0.0, f0, g0
    enclosed, first, width, before = False, True, most, 2 * most
    lowest, highest = 0.0, step + 4 * step
    for _ in range(trials):
        f, g = phi(step)
        line = f0 + step * down * g0
        if first and f <= line and g >= 0:
            first = False
        if f <= line and abs(g) <= flat * -g0:
            return step
        if step >= most and f <= line and g <= down * g0:
            return step  # it goes on downwards, but there is no more room
        if enclosed and (step <= lowest or step >= highest or highest - lowest <= close * EPS * highest):
            return step if f <= line else None
        k = down * g0 if first and f <= fa and f > line else 0.0
        va, sa, vb, sb, v, s = fa - a * k, ga - k, fb - b * k, gb - k, f - step * k, g - k
        # the next trial: by where the new value and slope stand against the best place
        if v > va or not np.isfinite(v):
            cubic = _cubic(a, va, sa, step, v, s) if np.isfinite(v) else float("nan")
            square = a + (step - a) * sa / ((va - v) / (step - a) + sa) / 2 if np.isfinite(v) else float("nan")
            if not np.isfinite(cubic):
                cubic = square if np.isfinite(square) else a + 0.1 * (step - a)
            following = cubic if not np.isfinite(square) or abs(cubic - a) < abs(square - a) else cubic + (square - cubic) / 2
            enclosed, b, fb, gb = True, step, f, g
        else:
            if np.sign(s) * np.sign(sa) < 0:
                cubic, secant = _cubic(a, va, sa, step, v, s), step - s * (step - a) / (s - sa)
                following = cubic if np.isfinite(cubic) and abs(cubic - step) > abs(secant - step) else secant
                enclosed, b, fb, gb = True, a, fa, ga
            elif abs(s) <= abs(sa):
                cubic, secant = _cubic(a, va, sa, step, v, s), step + (step - a) * s / (sa - s) if sa != s else float("inf")
                ahead = np.isfinite(cubic) and (cubic - step) * (step - a) > 0
                far = highest if step > a else lowest
                options = [x for x in ((cubic if ahead else far), secant) if np.isfinite(x)] or [far]
                if enclosed:
                    following = min(options, key=lambda x: abs(x - step))
                    edge = step + 0.66 * (b - step)
                    following = min(edge, following) if step > a else max(edge, following)
                else:
                    following = min(max(max(options, key=lambda x: abs(x - step)), lowest), highest)
            elif enclosed:
                cubic = _cubic(step, v, s, b, vb, sb)
                following = cubic if np.isfinite(cubic) else (step + b) / 2
            else:
                following = highest if step > a else lowest
            a, fa, ga = step, f, g
        if enclosed:
            if abs(b - a) >= 0.66 * before:  # the interval has hardly shrunk
                following = a + 0.5 * (b - a)
            before, width = width, abs(b - a)
            lowest, highest = min(a, b), max(a, b)
        else:
            lowest, highest = following + 1.1 * (following - a), following + 4 * (following - a)
        step = min(max(following, 0.0), most)
        if enclosed and (step <= lowest or step >= highest) or step == 0:
            step = a + 0.5 * (b - a) if enclosed else a
    return None


def lbfgsb(f: Objective, x0: np.ndarray, bound: float, gtol: float = 1e-5, ftol: float = 1e3 * EPS, memory: int = 10, max_rounds: int = 15_000, max_trials: int = 40) -> tuple[np.ndarray, float, bool, int]:
    """Minimum of f within [-bound, bound]: (x, value, whether it ended well, number of evaluations)."""
    x = np.clip(np.asarray(x0, float), -bound, bound)
    value, g = f(x)
    calls, model = 1, _Model(x.size, memory)
    flat = lambda x, g: np.abs(x - np.clip(x - g, -bound, bound)).max(initial=0.0)
    for round_ in range(max_rounds):
        if flat(x, g) <= gtol:
            return x, value, True, calls
        at, c = model.cauchy(x, g, -bound, bound)
        d = model.over_free(x, g, at, c, -bound, bound) - x
        slope = float(g @ d)
        if not slope < 0:
            if not model.s:
                return x, value, False, calls
            model.forget()
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            room = float(np.where(d > 0, (bound - x) / d, np.where(d < 0, (-bound - x) / d, np.inf)).min(initial=np.inf))
        most = 1.0 if round_ == 0 and np.isfinite(bound) else min(max(room, 1.0), 1e10)
        seen: dict[float, tuple[np.ndarray, float, np.ndarray]] = {}

        def phi(step: float) -> tuple[float, float]:
            new = np.clip(x + step * d, -bound, bound)  # noqa: B023
            v, h = f(new)
            seen[step] = (new, v, h)  # noqa: B023
            return float(v), float(h @ d)  # noqa: B023

        first = min(1.0, most) if model.s else min(1.0 / float(np.linalg.norm(d)), most)
        step = strong_wolfe(phi, value, slope, first, most, max_trials)
        calls += len(seen)
        if step is None:
            if model.s:  # start again from the gradient
                model.forget()
                continue
            return x, value, flat(x, g) <= 1e2 * gtol, calls
        new, got, h = seen[step]
        model.learn(new - x, h - g)
        small = value - got <= ftol * max(abs(value), abs(got), 1.0)
        x, value, g = new, float(got), h
        if small:
            return x, value, True, calls
    return x, value, False, calls


def _size(value: float) -> float:
    return max(value, -1e-3 * value, 1.0)


def dfp(f: Objective, x0: np.ndarray, gtol: float = 1e-7, max_rounds: int = 100, largest: int = 10_000) -> tuple[np.ndarray, float, bool, int]:
    """Minimum of f without bounds: (x, value, whether it ended well, number of evaluations).

    The inverse Hessian is held as a whole: ``largest`` variables at most. The gradient is held against the size of the
    value: of a cost under 0, which adds up over ever more pairs, a thousandth, so that its rounding does not keep the
    rounds going.
    """
    x = np.array(x0, float)
    if x.size > largest:
        raise ValueError(f"{x.size} variables, more than {largest}: the whole inverse Hessian is too large")
    value, g = f(x)
    calls, inverse, d = 1, np.eye(x.size), -g
    longest = 100.0 * max(float(np.linalg.norm(x)), x.size)
    for _ in range(max_rounds):
        d = d * min(1.0, longest / max(float(np.linalg.norm(d)), 1e-300))
        slope = float(g @ d)
        if slope >= 0:
            return x, value, np.abs(g).max(initial=0.0) <= gtol * _size(value), calls
        if -slope <= EPS * abs(value):
            return x, value, True, calls  # what is left to gain is less than the value's rounding
        least = EPS / max(float((np.abs(d) / np.maximum(np.abs(x), 1.0)).max()), 1e-300)
        step, last = 1.0, None
        while True:
            new = x + step * d
            got, h = f(new)
            calls += 1
            if step < least:
                return x, value, True, calls  # no step left that changes x
            if np.isfinite(got) and got <= value + 1e-4 * step * slope:
                break
            if last is None or not np.isfinite(got) or not np.isfinite(last[1]):
                next_step = -slope * step * step / (2 * (got - value - slope * step)) if np.isfinite(got) else 0.1 * step
            else:  # the cubic through this trial and the last, with the value and slope at 0
                r1, r2 = got - value - step * slope, last[1] - value - last[0] * slope
                a = (r1 / step**2 - r2 / last[0] ** 2) / (step - last[0])
                b = (-last[0] * r1 / step**2 + step * r2 / last[0] ** 2) / (step - last[0])
                root = b * b - 3 * a * slope
                next_step = -slope / (2 * b) if a == 0 else 0.5 * step if root < 0 else (-b + np.sqrt(root)) / (3 * a) if b <= 0 else -slope / (b + np.sqrt(root))
            last = (step, got)
            step = min(max(next_step, 0.1 * step), 0.5 * step)
        s, y = new - x, h - g
        x, value, g = new, float(got), h
        weight = np.maximum(np.abs(x), 1.0)
        if (np.abs(s) / weight).max() < 4 * EPS or (np.abs(g) * weight).max() / _size(value) < gtol:
            return x, value, True, calls
        hy, sy = inverse @ y, float(s @ y)
        if sy > np.sqrt(EPS * float(y @ y) * float(s @ s)):
            yhy = float(y @ hy)
            u = s / sy - hy / yhy
            inverse += np.outer(s, s) / sy - np.outer(hy, hy) / yhy + yhy * np.outer(u, u)
        d = -inverse @ g
    return x, value, bool(np.abs(g).max() <= 1e2 * gtol * _size(value)), calls  # out of rounds, but flat all the same


def projected(f: Objective, x0: np.ndarray, bound: float, gtol: float = 1e-5, ftol: float = 1e3 * EPS, memory: int = 10, max_rounds: int = 15_000, max_trials: int = 40) -> tuple[np.ndarray, float, bool, int]:
    """Minimum of f within [-bound, bound]: (x, value, whether it ended well, number of evaluations).

    Limited-memory BFGS directions on the free variables, projected backtracking steps.
    """
    clip = lambda v: np.clip(v, -bound, bound)
    x = clip(np.asarray(x0, float))
    value, g = f(x)
    calls, pairs = 1, []
    for _ in range(max_rounds):
        if np.abs(x - clip(x - g)).max(initial=0.0) <= gtol:
            return x, value, True, calls
        held = ((x <= -bound) & (g > 0)) | ((x >= bound) & (g < 0))
        q = np.where(held, 0.0, g)
        back = []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            q -= a * y
            back.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(np.linalg.norm(q), 1e-300)
        for (s, y, rho), a in zip(pairs, reversed(back), strict=True):
            q += s * (a - rho * (y @ q))
        d = np.where(held, 0.0, -q)
        if g @ d >= 0:
            d, pairs = np.where(held, 0.0, -g), []
        step = 1.0
        for _ in range(max_trials):
            new = clip(x + step * d)
            got, h = f(new)
            calls += 1
            if np.isfinite(got) and got <= value + 1e-4 * (g @ (new - x)):
                break
            step *= 0.5
        else:
            # no descent to be had: a flat place if the last model was all there is, else start from the gradient again
            if not pairs:
                return x, value, np.abs(x - clip(x - g)).max() <= 1e2 * gtol, calls
            pairs = []
            continue
        s, y = new - x, h - g
        if s @ y > 1e-10 * (y @ y):
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        small = value - got <= ftol * max(abs(value), abs(got), 1.0)
        x, value, g = new, got, h
        if small:
            return x, value, True, calls
    return x, value, False, calls
