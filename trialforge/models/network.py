"""A linear network over the connectome as a response model, and the indicator's impulse response."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .optimize import Found, expm, least_squares, minimise

MARGIN, LEAST_TAU = 0.99, 0.1


@dataclass
class Network:
    """Normalised weights: chem[i, j] signed, from j to i; gap symmetric."""

    names: list[str]
    chem: np.ndarray
    gap: np.ndarray

    @classmethod
    def from_edges(cls, chem: list[tuple[str, str, float]], gap: list[tuple[str, str, float]]) -> "Network":
        names = sorted({x for a, b, _ in [*chem, *gap] for x in (a, b)})
        at = {x: i for i, x in enumerate(names)}
        c, g = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
        for pre, post, w in chem:
            c[at[post], at[pre]] += w
        for a, b, w in gap:
            i, j = at[a], at[b]
            g[i, j] = g[j, i] = max(g[i, j], w)
        norm = lambda x: x / max(np.abs(x).sum(axis=1).max(initial=0.0), 1e-300) if len(x) else x
        return cls(names, norm(c), norm(g))

    def system(self, tau: float, chem: float, gap: float) -> np.ndarray:
        """The rate matrix (-1 + chem C + gap (G - deg G)) / tau. Couplings are scaled so that it stays stable."""
        g = self.gap - np.diag(self.gap.sum(axis=1))
        scale = min(1.0, MARGIN / max(abs(chem), 1e-300))
        return (-np.eye(len(self.names)) + chem * scale * self.chem + gap * g) / tau

    def kernels(self, tau: float, chem: float, gap: float, pairs: list[tuple[str, str]], times: np.ndarray) -> np.ndarray:
        """(pairs, times): the responder's value after a unit impulse at the target; unmapped pairs are zero."""
        a, at = self.system(tau, chem, gap), {x: i for i, x in enumerate(self.names)}
        out = np.zeros((len(pairs), len(times)))
        ok = [k for k, (t, r) in enumerate(pairs) if t in at and r in at]
        targets = sorted({pairs[k][0] for k in ok})
        state, last = np.eye(len(a))[:, [at[t] for t in targets]], 0.0
        column = {t: i for i, t in enumerate(targets)}
        for j, t in enumerate(times):
            if t > last:
                state, last = expm(a * (t - last)) @ state, t
            for k in ok:
                out[k, j] = state[at[pairs[k][1]], column[pairs[k][0]]]
        return out


def fit_network(net: Network, pairs: list[tuple[str, str]], times: np.ndarray, want: np.ndarray, weight: np.ndarray | None = None) -> tuple[dict[str, float], Found]:
    """tau, chem, gap and one gain, least weighted squares against wanted kernels."""
    w = np.ones_like(want) if weight is None else weight

    def unpack(z):
        return LEAST_TAU + math.exp(z[0]), MARGIN * math.tanh(z[1]), math.exp(z[2])

    def cost(z):
        k = net.kernels(*unpack(z), pairs, times)
        gain = (w * k * want).sum() / max((w * k * k).sum(), 1e-300)
        return float((w * (want - gain * k) ** 2).sum())

    best = min((minimise(cost, np.array(s), [(-6, 4), (-3, 3), (-8, 3)], rounds=60) for s in ((0.0, 0.3, -1.0), (1.0, 0.0, -3.0))), key=lambda f: f.value)
    tau, chem, gap = unpack(best.x)
    k = net.kernels(tau, chem, gap, pairs, times)
    return {"tau": tau, "chem": chem, "gap": gap, "gain": float((w * k * want).sum() / max((w * k * k).sum(), 1e-300))}, best


def impulse(t: np.ndarray, rise: float, decay: float) -> np.ndarray:
    """exp(-t/decay) - exp(-t/rise), 1 at its peak; the limit t exp(-t) form where the two meet."""
    if abs(decay - rise) < 1e-9 * decay:
        return t / rise * np.exp(1 - t / rise)
    at = rise * decay / (decay - rise) * math.log(decay / rise)
    return (np.exp(-t / decay) - np.exp(-t / rise)) / (math.exp(-at / decay) - math.exp(-at / rise))


def saturate(c: np.ndarray, top: float) -> np.ndarray:
    return c / (1 + np.abs(c) / top)


def fit_indicator(t: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Amplitude, rise and decay of the mean autoresponse, best of four starts."""

    def times(z):
        rise, more = math.exp(min(max(z[1], -6.0), 6.0)), math.exp(min(max(z[2], -6.0), 8.0))
        return rise, rise + more

    def residual(z):
        return z[0] * impulse(t, *times(z)) - y

    top = float(np.max(np.abs(y))) or 1.0
    best = min((least_squares(residual, np.array([top, math.log(r), math.log(d)])) for r, d in ((0.3, 1.0), (0.5, 3.0), (1.0, 5.0), (2.0, 10.0))), key=lambda f: f.value)
    rise, decay = times(best.x)
    return {"amplitude": float(best.x[0]), "rise": rise, "decay": decay, "cost": best.value}


def bandwidth(kernel: np.ndarray, dt: float, noise_sd: float, trials: int) -> float:
    """The highest frequency at which the mean response's spectrum stands out of the noise of so many trials, in Hz."""
    n = 8 * len(kernel)
    power = np.abs(np.fft.rfft(kernel, n)) ** 2
    seen = np.flatnonzero(power >= noise_sd**2 * len(kernel) / trials)
    return float(np.fft.rfftfreq(n, dt)[seen[-1]]) if len(seen) else 0.0


def synthetic(seed: int, shared: bool, animals: int = 16, targets: int = 4, responders: int = 6, repeats: int = 2, missing: float = 0.2, phi: float = 0.5) -> dict[str, np.ndarray]:
    """Trials of a known truth: one kernel for all pairs with amplitudes, or a kernel for each; correlated noise, gaps."""
    rng = np.random.Generator(np.random.PCG64(seed))
    t = np.arange(60)
    one = impulse(t * 0.5, 1.0, 4.0)
    kernels = {(a, r): (rng.normal() * one if shared else impulse(t * 0.5, rng.uniform(0.3, 2), rng.uniform(2.5, 8)) * rng.normal()) for a in range(targets) for r in range(responders)}
    rows = {"animal": [], "target": [], "responder": [], "input": [], "y": [], "mask": [], "s": []}
    for animal in range(animals):
        for a in range(targets):
            for _ in range(repeats):
                u = np.concatenate([np.zeros(10), impulse(t * 0.5, 0.5, rng.uniform(1.5, 3))])
                for r in range(responders):
                    s = rng.uniform(0.01, 0.03)
                    e = rng.normal(size=60)
                    for i in range(1, 60):
                        e[i] = phi * e[i - 1] + math.sqrt(1 - phi**2) * e[i]
                    y = np.convolve(u[10:], kernels[a, r])[:60] * 0.1 + s * e
                    for k, v in zip(rows, (animal, a, r, u, y, rng.random(60) >= missing, s)):
                        rows[k].append(v)
    return {k: np.array(v) for k, v in rows.items()} | {"kernels": np.array([kernels[k] for k in sorted(kernels)])}
