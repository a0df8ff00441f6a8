"""The coarse-to-fine schedule that drives a minimiser. It runs on the driver over three numbers per segment; the objective
is whatever is called (a Spark job over cached pair blocks, as a rule)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .minimisers import Objective, dfp, lbfgsb, projected


def reflect_boxcar(mu: np.ndarray, width: int) -> np.ndarray:
    """Moving average over segments (rows), mirrored at the ends."""
    if width < 1:
        raise ValueError("the width must be 1 or more")
    n = len(mu)
    out = np.zeros_like(mu)
    for k in range(-((width - 1) // 2), width // 2 + 1):
        q = np.mod(np.arange(n) + k, 2 * n)
        out += mu[np.where(q >= n, 2 * n - 1 - q, q)]
    return out / width


def optimized(f: Objective, x0: np.ndarray, bound: float, optimizer: str = "lbfgsb") -> tuple[np.ndarray, float, bool, int]:
    """By name: "lbfgsb" within the bounds; "bfgs" without bounds, with the whole inverse Hessian, for 100 rounds at most;
    "projected" within the bounds, by steps that are cut off at them.
    """
    if optimizer == "lbfgsb":
        return lbfgsb(f, x0, bound)
    if optimizer == "bfgs":
        return dfp(f, x0)
    if optimizer == "projected":
        return projected(f, x0, bound)
    raise ValueError(f"no optimizer called {optimizer!r}")


def one_level(f: Objective, start: np.ndarray, bound: float, width: int = 3) -> np.ndarray:
    """One minimisation at one width, from a smoothed start: the drift of the segments."""
    mu = reflect_boxcar(start, width)
    return lbfgsb(f, mu.ravel(), bound, ftol=1e-12)[0].reshape(mu.shape)


def anneal(
    objective: Callable[[float], Objective], segments: int, sigma0: float, target: float, bound: float, width: int = 1, criterion: str = "median", refine: bool = True, start: np.ndarray | None = None,
    optimizer: str = "lbfgsb", on_failure: str = "retry", on_round: Callable[[dict, np.ndarray], None] | None = None,
) -> tuple[np.ndarray, list[dict]]:
    """Minimises at ever smaller widths; (drift of the segments, trace).

    It ends at the first width at or under the target where the change grows again or the width is 1 or less; the last
    solution is then dropped for the smoothed one that it started from. With ``on_failure`` "retry", a minimisation that
    fails is tried again twice as it is, then at twice the width; after the sixth failure it is given up with an error.
    With "restart", the second failure starts again from no drift at twice the first width, and the sixth ends the run
    with the drift that it has. ``on_round`` is told of every round.
    """
    if on_failure not in ("retry", "restart"):
        raise ValueError(f"no policy called {on_failure!r}")
    mu = np.zeros((segments, 3)) if start is None else np.array(start, float)
    factor, before, failures, trace = 1.0, np.inf, 0, []
    while True:
        mu = reflect_boxcar(mu, width)
        sigma = sigma0 * factor
        x, value, good, calls = optimized(objective(sigma), mu.ravel(), bound, optimizer)
        x = x.reshape(mu.shape)
        change = (x - mu) ** 2
        delta = float(np.median(change)) if criterion == "median" else float(np.sqrt(change.mean()))
        trace.append({"iteration": len(trace), "sigma": sigma, "delta": delta, "cost": float(value), "evaluations": calls, "good": bool(good), "failures": failures + (not good)})
        if on_round:
            on_round(trace[-1], x)
        if good:
            if not refine:
                return x, trace
            if (delta > before or criterion == "median" and sigma <= 1) and (criterion != "median" or sigma <= target):
                return mu, trace
            if criterion != "median" and sigma <= target:
                return x, trace
            factor, before, mu = factor / 1.5, delta, x
            continue
        failures += 1
        if on_failure == "restart":
            if failures > 5:
                return mu, trace
            if failures == 2:
                mu, before, factor = np.zeros_like(mu), np.inf, 2.0
        else:
            if failures > 5:
                raise RuntimeError("the minimisation failed six times")
            if failures > 2:
                factor *= 2
