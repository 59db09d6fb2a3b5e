"""Response models as kernels per (target, responder) pair, fitted from sums of outer products.

The loss over pairs p and animals: c'Gc + 2c'Xb - 2c'y + lam |c|^2 per pair, and b'Qb - 2b'q + yy per animal, where c
are a pair's kernel weights on the basis and b the animals' nuisance weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS, SWEEPS, TOL, DELAYS = 1e-9, 200, 1e-7, (0, -1, 1, -2, 2)
RIDGES = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)


@dataclass
class Stats:
    """G (P, M, M), X (P, M, K), y (P, M) per pair; Q (K, K), q (K), yy, n over all."""

    pairs: list
    G: np.ndarray
    X: np.ndarray
    y: np.ndarray
    Q: np.ndarray
    q: np.ndarray
    yy: float
    n: int

    @property
    def ridge_unit(self) -> float:
        """The median trace of G over M: what a relative ridge is multiplied by."""
        return float(np.median(np.trace(self.G, axis1=1, axis2=2))) / self.G.shape[1] if len(self.G) else 1.0


@dataclass
class Fit:
    family: str
    c: np.ndarray
    b: np.ndarray
    extra: dict

    def kernel(self, stats: Stats, pair) -> np.ndarray:
        """The weights of a pair; zero for one that wasn't seen."""
        return self.c[stats.pairs.index(pair)] if pair in stats.pairs else np.zeros(self.c.shape[1])


def moments(rows: DataFrame, group: list[str], m: int, k: int) -> DataFrame:
    """group and flat G, X, y, Q, q, yy, n: sums over the rows (x array<double>[m], z array<double>[k], v double) of each
    group, added up in each task before they meet."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema) + ", stat array<double>, n long"

    def part(batches):
        for p in batches:
            for key, g in p.groupby(group, dropna=False):
                a = np.column_stack([np.stack(g["x"]), np.stack(g["z"]), g["v"].to_numpy()])
                yield pd.DataFrame([[*(key if isinstance(key, tuple) else (key,)), (a.T @ a).ravel(), len(g)]], columns=[*group, "stat", "n"])

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*[p[c].iloc[0] for c in group], np.sum(np.stack(p["stat"]), axis=0), p["n"].sum()]], columns=[*group, "stat", "n"])

    return rows.select(*group, "x", "z", "v").mapInPandas(part, schema).groupBy(*group).applyInPandas(whole, schema)


def stack(rows: pd.DataFrame, pair: list[str], m: int, k: int) -> Stats:
    """Stats from the rows of moments(), those of one pair (over animals) added up."""
    d = m + k + 1
    by = {}
    for key, g in rows.groupby(pair):
        by[key] = (np.sum(np.stack(g["stat"]), axis=0).reshape(d, d), int(g["n"].sum()))
    keys = sorted(by)
    a = np.stack([by[x][0] for x in keys]) if keys else np.zeros((0, d, d))
    total = a.sum(axis=0) if len(a) else np.zeros((d, d))
    return Stats(keys, a[:, :m, :m], a[:, :m, m : m + k], a[:, :m, -1], total[m : m + k, m : m + k], total[m : m + k, -1], float(total[-1, -1]), sum(by[x][1] for x in keys))


def loss(s: Stats, c: np.ndarray, b: np.ndarray, lam: float = 0.0) -> float:
    each = np.einsum("pm,pmn,pn->", c, s.G, c) + 2 * np.einsum("pm,pmk,k->", c, s.X, b) - 2 * np.einsum("pm,pm->", c, s.y)
    return float(each + lam * (c * c).sum() + b @ s.Q @ b - 2 * b @ s.q + s.yy)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a + EPS * (1 + np.trace(a) / max(1, len(a))) * np.eye(len(a)), b)


def fit_null(s: Stats, ridge: float = 0.0) -> Fit:
    """No response: only the nuisance weights."""
    return Fit("null", np.zeros((len(s.G), s.G.shape[1])), _solve(s.Q, s.q), {})


def fit_independent(s: Stats, ridge: float) -> Fit:
    """A kernel of its own for each pair, the nuisance weights profiled out of all pairs together."""
    lam = ridge * s.ridge_unit
    m = s.G.shape[1]
    inv = np.linalg.inv(s.G + (lam + EPS) * np.eye(m))
    iy, ix = np.einsum("pmn,pn->pm", inv, s.y), np.einsum("pmn,pnk->pmk", inv, s.X)
    b = _solve(s.Q - np.einsum("pmk,pml->kl", s.X, ix), s.q - np.einsum("pmk,pm->k", s.X, iy))
    return Fit("independent", iy - ix @ b, b, {"lam": lam})


def shift(m: int, knots: np.ndarray, lag: int) -> np.ndarray:
    """The matrix that moves a piecewise linear kernel by lag samples, read again at its knots, zero before the first."""
    out = np.zeros((m, m))
    for i, at in enumerate(knots):
        x = at - lag
        if x < knots[0] or x > knots[-1]:
            continue
        j = int(np.clip(np.searchsorted(knots, x, side="right") - 1, 0, m - 2))
        w = (x - knots[j]) / (knots[j + 1] - knots[j])
        out[i, j] += 1 - w
        out[i, j + 1] += w
    return out


def targets_of(pairs: list) -> np.ndarray:
    """The number of each pair's target, its first part; all one where a pair is a single name."""
    firsts = [p[0] if isinstance(p, tuple) and len(p) > 1 else None for p in pairs]
    return np.unique([repr(f) for f in firsts], return_inverse=True)[1] if firsts else np.zeros(0, int)


def _leading(c: np.ndarray) -> np.ndarray:
    """The first right singular vector of c, its largest entry positive; without one, the first unit vector."""
    if not c.any():
        return np.eye(c.shape[1])[0]
    v = np.linalg.svd(c, full_matrices=False)[2][0]
    return v if v[np.argmax(np.abs(v))] > 0 else -v


def fit_shared(s: Stats, ridge: float, knots: np.ndarray | None = None, start: np.ndarray | None = None, groups: np.ndarray | None = None) -> Fit:
    """One kernel for each target, shared by its pairs, an amplitude (and with knots a whole delay) for each pair, by
    alternating least squares.

    groups: number of each pair's target; start: kernels to begin from, else the leading shapes of the independent fit.
    Ties between delays go to the one nearest to zero.
    """
    lam, (p, m) = ridge * s.ridge_unit, s.y.shape
    groups = targets_of(s.pairs) if groups is None else groups
    of = np.eye(int(groups.max()) + 1 if p else 1)[groups].T if p else np.zeros((1, 0))  # group by pair
    moves = np.stack([shift(m, knots, d) for d in DELAYS]) if knots is not None else np.eye(m)[None]
    if start is None:
        own = fit_independent(s, ridge)
        k, b = np.stack([_leading(own.c[g > 0]) for g in of]) if p else np.eye(m)[:1], own.b
    else:
        k, b = np.array(start, float), _solve(s.Q, s.q)
    tie = 1e-12 * np.abs(np.arange(len(moves)))
    gl, pick, amp, last = s.G + lam * np.eye(m), np.zeros(p, int), np.zeros(p), np.inf
    for _ in range(SWEEPS if knots is None else 60):
        r = s.y - s.X @ b
        v = np.einsum("dmn,pn->pdm", moves, k[groups])
        num, den = np.einsum("pdm,pm->pd", v, r), np.einsum("pdm,pmn,pdn->pd", v, gl, v) + EPS
        pick = np.argmax(num**2 / den - tie, axis=1)
        amp = num[np.arange(p), pick] / den[np.arange(p), pick]
        moved = moves[pick]
        left = np.einsum("gp,pnm,pno,pol->gml", of * amp**2, moved, gl, moved, optimize=True) + EPS * np.eye(m)
        k = np.linalg.solve(left, np.einsum("gp,pnm,pn->gm", of * amp, moved, r, optimize=True)[..., None])[..., 0]
        size = np.linalg.norm(k, axis=1)
        size[size == 0] = 1.0
        k, amp = k / size[:, None], amp * size[groups]
        c = amp[:, None] * np.einsum("pmn,pn->pm", moved, k[groups])
        b = _solve(s.Q, s.q - np.einsum("pmk,pm->k", s.X, c))
        now = loss(s, c, b, lam)
        if abs(last - now) <= TOL * max(1.0, abs(now)):
            break
        last = now
    delay = np.array(DELAYS)[pick] if knots is not None else np.zeros(p, int)
    return Fit("shared" if knots is None else "shared+delay", c, b, {"kernels": k, "amplitude": amp, "delay": delay, "lam": lam})


def fit_low_rank(s: Stats, ridge: float, rank: int) -> Fit:
    """Kernels in a common subspace of few dimensions, by alternating least squares, in an orthonormal basis."""
    lam, (p, m) = ridge * s.ridge_unit, s.y.shape
    rank = min(rank, m, p)
    b = _solve(s.Q, s.q)
    B = np.linalg.svd(fit_independent(s, max(ridge, 1.0)).c, full_matrices=False)[2][:rank].T
    last = np.inf
    for _ in range(SWEEPS):
        r = s.y - np.einsum("pmk,k->pm", s.X, b)
        H = np.einsum("mi,pmn,nj->pij", B, s.G, B) + (lam + EPS) * np.eye(rank)
        A = np.linalg.solve(H, (r @ B)[..., None])[..., 0]
        big = np.einsum("pi,pmn,pj->minj", A, s.G + lam * np.eye(m), A).reshape(m * rank, m * rank)
        B = _solve(big, np.einsum("pm,pi->mi", r, A).ravel()).reshape(m, rank)
        B, R = np.linalg.qr(B)
        sign = np.where(np.diag(R) < 0, -1.0, 1.0)  # the triangle's diagonal is positive
        B, A = B * sign, A @ (R * sign[:, None]).T
        c = A @ B.T
        b = _solve(s.Q, s.q - np.einsum("pmk,pm->k", s.X, c))
        now = loss(s, c, b, lam)
        if last - now <= TOL * max(1.0, abs(now)):
            break
        last = now
    return Fit(f"rank{rank}", c, b, {"basis": B, "weights": A, "lam": lam})


FAMILIES = {"null": fit_null, "independent": fit_independent, "shared": fit_shared} | {f"rank{k}": partial(fit_low_rank, rank=k) for k in (1, 2, 4, 8)}
