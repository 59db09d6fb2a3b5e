"""Masked AR(1) residuals: likelihood, block means, fits and calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .optimize import minimise

LEAST_VAR = 1e-12
#: Ranges of the fitted log a, log b over its scale, atanh phi and nu.
BOUNDS = {"log_a": (-12.0, 6.0), "log_b": (-20.0, 6.0), "atanh_phi": (-4.0, 4.0), "nu": (1.0, 1000.0)}


@dataclass(frozen=True)
class Noise:
    """sd = sqrt(a^2 s^2 + b^2) for a trace of baseline spread s; phi: lag-1 correlation; nu: of Student-t, or None."""

    a: float
    b: float
    phi: float
    nu: float | None = None

    def sd(self, s: np.ndarray) -> np.ndarray:
        s = np.nan_to_num(np.asarray(s, float), nan=0.0)
        return np.sqrt(self.a**2 * s**2 + self.b**2)


def gaps(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous valid position or -1, distance to it) for each sample of (traces, samples) masks."""
    at = np.where(mask, np.arange(mask.shape[1]), -1)
    last = np.maximum.accumulate(at, axis=1)
    prev = np.concatenate([np.full((len(mask), 1), -1), last[:, :-1]], axis=1)
    return prev, np.arange(mask.shape[1]) - prev


def trace_nll(e: np.ndarray, mask: np.ndarray, s: np.ndarray, noise: Noise) -> np.ndarray:
    """Negative log likelihood of each trace's valid residuals e, exact over gaps."""
    prev, gap = gaps(mask)
    before = np.where(prev >= 0, np.take_along_axis(np.where(mask, e, 0.0), np.maximum(prev, 0), 1), 0.0)
    rho = np.where(prev >= 0, noise.phi ** np.maximum(gap, 0).astype(float), 0.0)
    var = np.maximum(1 - rho**2, LEAST_VAR) * noise.sd(s)[:, None] ** 2
    r2 = (e - rho * before) ** 2 / var
    if noise.nu is None:
        one = 0.5 * (math.log(2 * math.pi) + np.log(var) + r2)
    else:
        nu = noise.nu
        one = math.lgamma(nu / 2) - math.lgamma((nu + 1) / 2) + 0.5 * math.log(nu * math.pi) + 0.5 * np.log(var) + (nu + 1) / 2 * np.log1p(r2 / nu)
    return np.where(mask, one, 0.0).sum(axis=1)


def fit_noise(e: np.ndarray, mask: np.ndarray, s: np.ndarray, student: bool = False, starts: tuple[float, ...] = (0.2, 0.7)) -> Noise:
    """Maximum likelihood within BOUNDS, best of the starts for phi."""
    spread = max(float(np.sqrt(np.mean(e[mask] ** 2))) if mask.any() else 1.0, 1e-9)

    def unpack(z: np.ndarray) -> Noise:
        return Noise(math.exp(z[0]), math.exp(z[1]) * spread, math.tanh(z[2]), math.exp(z[3]) if student else None)

    def loss(z: np.ndarray) -> float:
        return float(trace_nll(e, mask, s, unpack(z)).sum()) / max(1, int(mask.sum()))

    box = [BOUNDS["log_a"], BOUNDS["log_b"], BOUNDS["atanh_phi"]] + [tuple(map(math.log, BOUNDS["nu"]))] * student
    runs = [minimise(loss, np.array([0.0, math.log(0.5), math.atanh(p)] + [math.log(8.0)] * student), box) for p in starts]
    return unpack(min(runs, key=lambda r: r.value).x)


def block_moments(mask: np.ndarray, phi: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Per trace and block of samples: how many are valid, and the variance of their mean in units of sd^2."""
    n = -(-mask.shape[1] // block)
    m = np.pad(mask, ((0, 0), (0, n * block - mask.shape[1]))).reshape(len(mask), n, block).astype(float)
    k = phi ** np.abs(np.subtract.outer(np.arange(block), np.arange(block)))
    count = m.sum(axis=2)
    return count, np.einsum("tbi,ij,tbj->tb", m, k, m) / np.maximum(count, 1) ** 2


def calibration(e: np.ndarray, mask: np.ndarray, s: np.ndarray, noise: Noise, levels: dict[str, float]) -> dict[str, float]:
    """Share of valid residuals within each quantile of their marginal spread."""
    z = np.abs(e / noise.sd(s)[:, None])[mask]
    return {k: float((z <= q).mean()) if len(z) else float("nan") for k, q in levels.items()}


def paired_bootstrap(a: dict[str, float], b: dict[str, float], seed: int, draws: int = 10_000, level: float = 0.95) -> dict[str, float]:
    """Mean of a - b over the same animals and its percentile interval; other key sets are an error."""
    if set(a) != set(b):
        raise ValueError("the two sides have different animals")
    d = np.array([a[k] - b[k] for k in sorted(a)])
    rng = np.random.Generator(np.random.PCG64(seed))
    means = d[rng.integers(0, len(d), (draws, len(d)))].mean(axis=1)
    lo, hi = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return {"mean": float(d.mean()), "lo": float(lo), "hi": float(hi), "n": len(d)}


def drop_one(d: dict[str, float]) -> dict[str, float]:
    """The mean without each animal in turn."""
    total, n = sum(d.values()), len(d)
    return {k: (total - v) / (n - 1) for k, v in d.items()} if n > 1 else {}
