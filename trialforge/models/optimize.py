"""Bounded minimisation, least squares, and the matrix exponential, in numpy alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Found:
    x: np.ndarray
    value: float
    rounds: int
    converged: bool


def numeric_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Central differences, one-sided at a bound."""
    g = np.empty_like(x)
    for i in range(len(x)):
        h = 6e-6 * max(1.0, abs(x[i]))
        a, b = x.copy(), x.copy()
        a[i], b[i] = min(hi[i], x[i] + h), max(lo[i], x[i] - h)
        g[i] = (f(a) - f(b)) / (a[i] - b[i])
    return g


def minimise(f: Callable, x0: np.ndarray, bounds: list[tuple[float, float]] | None = None, gradient: Callable | None = None, rounds: int = 200, tol: float = 1e-7, memory: int = 8) -> Found:
    """Projected limited-memory quasi-Newton descent within box bounds, with backtracking.

    Variables held at a bound by the gradient keep still for a step; the others move along the two-loop direction.
    """
    x = np.array(x0, float)
    lo = np.array([b[0] for b in bounds]) if bounds else np.full(len(x), -np.inf)
    hi = np.array([b[1] for b in bounds]) if bounds else np.full(len(x), np.inf)
    x = np.clip(x, lo, hi)
    grad = gradient or (lambda z: numeric_gradient(f, z, lo, hi))
    value, g, pairs = float(f(x)), grad(x), []
    for k in range(rounds):
        free = ~((x <= lo) & (g > 0) | (x >= hi) & (g < 0))
        if not free.any() or np.abs(g[free]).max() < tol * max(1.0, abs(value)):
            return Found(x, value, k, True)
        q, scale = np.where(free, g, 0.0), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            scale.append(a)
            q = q - a * y
        if pairs:
            s, y, _ = pairs[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y, r), a in zip(pairs, reversed(scale)):
            q = q + (a - r * (y @ q)) * s
        step = np.where(free, -q, 0.0)
        if step @ g >= 0:
            step, pairs = np.where(free, -g, 0.0), []
        if not pairs:
            step = step / max(1.0, np.abs(step).max())
        t = 1.0
        while True:
            new = np.clip(x + t * step, lo, hi)
            nv = float(f(new))
            if np.isfinite(nv) and nv <= value + 1e-4 * (g @ (new - x)):
                break
            t *= 0.5
            if t < 1e-12:
                if not pairs:
                    return Found(x, value, k, True)
                pairs, t, step = [], 1.0, np.where(free, -g, 0.0) / max(1.0, np.abs(g).max())
        ng = grad(new)
        s, y = new - x, ng - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        done = abs(value - nv) <= 1e-12 * max(1.0, abs(value))
        x, value, g = new, nv, ng
        if done:
            return Found(x, value, k + 1, True)
    return Found(x, value, rounds, False)


def least_squares(residual: Callable[[np.ndarray], np.ndarray], x0: np.ndarray, rounds: int = 100, tol: float = 1e-10) -> Found:
    """Damped Gauss-Newton steps with a numeric Jacobian."""
    x, damp = np.array(x0, float), 1e-3
    r = residual(x)
    for k in range(rounds):
        jac = np.empty((len(r), len(x)))
        for i in range(len(x)):
            h = 1e-6 * max(1.0, abs(x[i]))
            z = x.copy()
            z[i] += h
            jac[:, i] = (residual(z) - r) / h
        a, b = jac.T @ jac, jac.T @ r
        while True:
            step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), -b)
            rn = residual(x + step)
            if np.isfinite(rn).all() and rn @ rn < r @ r:
                break
            damp *= 10
            if damp > 1e12:
                return Found(x, float(r @ r) / 2, k, True)
        better = r @ r - rn @ rn
        x, r, damp = x + step, rn, max(damp / 10, 1e-12)
        if better <= tol * (r @ r + 1e-300):
            return Found(x, float(r @ r) / 2, k + 1, True)
    return Found(x, float(r @ r) / 2, rounds, False)


def expm(a: np.ndarray) -> np.ndarray:
    """The matrix exponential: a diagonal Pade quotient of the matrix halved until small, then squared back."""
    norm = np.abs(a).sum(axis=1).max(initial=0.0)
    squarings = max(0, int(np.ceil(np.log2(max(norm, 1e-300)))) + 1)
    x = a / 2**squarings
    top = bottom = term = np.eye(len(a))
    n = 8
    c = 1.0
    for k in range(1, n + 1):
        c *= (n - k + 1) / (k * (2 * n - k + 1))
        term = term @ x
        top = top + c * term
        bottom = bottom + (-1) ** k * c * term
    out = np.linalg.solve(bottom, top)
    for _ in range(squarings):
        out = out @ out
    return out


def logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out.item() if axis is None else np.squeeze(out, axis)
