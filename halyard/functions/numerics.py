"""Small dense numerics in NumPy: matrix exponential, bounded least squares, roots."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor polynomial and repeated squaring."""
    norm = np.abs(a).sum(0).max() if a.size else 0.0
    squarings = max(0, int(np.ceil(np.log2(norm))) + 4) if norm > 0 else 0
    scaled, out, term = a / 2.0**squarings, np.eye(len(a)), np.eye(len(a))
    for k in range(1, 19):
        term = term @ scaled / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def propagate(k: np.ndarray, p0: np.ndarray, time: np.ndarray) -> np.ndarray:
    """P at each time of a uniform grid, one product with the step's propagator a row."""
    steps = np.diff(time)
    if len(steps) and (steps.max() - steps.min()) > 1e-6 * abs(steps.mean()):
        raise ValueError("the time grid is not uniform")
    out = np.empty((len(time), len(p0)))
    out[0] = p0
    if len(steps):
        step = expm(k * steps.mean())
        for i in range(1, len(time)):
            out[i] = step @ out[i - 1]
    return out


def least_squares(residual: Callable[[np.ndarray], np.ndarray], x0: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200):
    """Levenberg-Marquardt projected on a box. Returns x, cost, Jacobian, converged."""

    def jacobian(x, r):
        j = np.empty((len(r), len(x)))
        for i in range(len(x)):
            h = 1e-6 * max(1.0, abs(x[i]))
            h = -h if x[i] + h > high[i] else h
            y = x.copy()
            y[i] += h
            j[:, i] = (residual(y) - r) / h
        return j

    x = np.clip(np.asarray(x0, float), low, high)
    r = residual(x)
    cost, damping = 0.5 * r @ r, 1e-3
    j, converged = jacobian(x, r), False
    for _ in range(rounds):
        grad, curve = j.T @ r, j.T @ j
        free = ~(((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0)))
        if not free.any() or np.abs(grad[free]).max() < 1e-14:
            converged = True
            break
        step = np.zeros_like(x)
        inner = curve[np.ix_(free, free)]
        step[free] = -np.linalg.solve(inner + damping * np.diag(np.diag(inner) + 1e-12), grad[free])
        y = np.clip(x + step, low, high)
        ry = residual(y)
        new = 0.5 * ry @ ry
        if np.isfinite(new) and new < cost:
            done = cost - new <= 1e-14 * max(cost, 1e-300) or np.abs(y - x).max() < 1e-10
            x, r, cost, damping = y, ry, new, max(damping / 5, 1e-12)
            j = jacobian(x, r)
            if done:
                converged = True
                break
        else:
            damping *= 4
            if damping > 1e12:
                converged = True
                break
    return x, cost, j, converged


def bisect(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-12) -> float:
    """A root of f between a and b, whose values have different signs."""
    fa = f(a)
    for _ in range(200):
        mid = 0.5 * (a + b)
        if b - a <= tolerance * max(1.0, abs(mid)):
            break
        fm = f(mid)
        if (fm > 0) == (fa > 0):
            a, fa = mid, fm
        else:
            b = mid
    return 0.5 * (a + b)


def propagated(step: np.ndarray, p0: np.ndarray, n: int) -> np.ndarray:
    """n rows from p0 on, each the step's product with the one before; twice as many in each round."""
    out = p0[None]
    while len(out) < n:
        out, step = np.vstack([out, out @ step.T]), step @ step
    return out[:n]


def null_space(j: np.ndarray, rows: int | None = None) -> tuple[int, np.ndarray]:
    """Rank, and how far each column takes part in the null space. rows: those of the matrix that j is a
    triangular factor of."""
    if not j.size:
        return 0, np.zeros(j.shape[1])
    _, s, vt = np.linalg.svd(j, full_matrices=True)
    limit = (s.max() if len(s) else 0.0) * max(rows or 0, *j.shape) * np.sqrt(np.finfo(float).eps)
    rank = int((s > limit).sum())
    return rank, np.linalg.norm(vt[rank:], axis=0)
