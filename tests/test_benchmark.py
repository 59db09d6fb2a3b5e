"""Nested evaluation: what it writes, and its scores against one trace at a time."""

import numpy as np
import pytest

from trialforge.models import benchmark
from trialforge.models.noise import Noise, trace_nll
from trialforge.plans import numeric

SAMPLES = np.arange(2, 60)


def test_only_kernels_noises_and_scores_are_stored(spark, sf, monkeypatch):
    """Residuals, as many as traces and cases together, are not; the scores are those of each trace's residuals."""
    written = []
    scratch = benchmark.scratch
    monkeypatch.setattr(benchmark, "scratch", lambda df: written.append(scratch(df)) or written[-1])
    got = numeric.kernel_folds(spark, sf).collect()
    assert written and not [t.columns for t in written if {"e", "mask", "y"} & set(t.columns)]
    fitted = next(t for t in written if "c" in t.columns).toPandas()
    noise = {tuple(r[c] for c in benchmark.CASE): r for r in next(t for t in written if "phi" in t.columns).collect()}
    traces = numeric._traces(spark, sf).collect()
    x, seen = np.column_stack([np.exp(-SAMPLES / 5.0), np.exp(-SAMPLES / 20.0)]), set()
    for r in got:
        case = (r["outer"], r["family"], benchmark.REFIT, r["ridge"])
        f = fitted[np.all([fitted[c] == v for c, v in zip(benchmark.CASE, case)], axis=0)]
        kernels, bias, nll, n = {p: c for p, c in zip(f["pair"], f["c"]) if p is not None}, f[f["pair"].isna()]["b"].iloc[0][0], 0.0, 0
        own = [t for t in traces if f"a{t.recording_id % 12}" == r["animal"]]
        for t in own:
            c = kernels.get(f"p{t.event_index % 3}")
            y, mask = np.array([t["at"].get(int(o), 0.0) for o in SAMPLES]), np.array([int(o) in t["at"] for o in SAMPLES])
            e = y - (0.0 if c is None else x @ np.array(c)) - bias
            q = noise[case]
            nll, n = nll + trace_nll(e[None], mask[None], np.array([0.3]), Noise(q["a"], q["b"], q["phi"]))[0], n + int(mask.sum())
        assert (r["samples"], r["traces"]) == (n, len(own)) and r["nll"] == pytest.approx(nll, rel=1e-9)
        seen.add((r["family"], r["animal"]))
    assert len(seen) == len(got) == 36


def test_traces_are_the_valid_samples_of_windows(spark, sf):
    got = {(r.trial_id, o, v) for r in numeric._traces(spark, sf).collect() for o, v in r["at"].items()}
    want = numeric._dff(spark, sf).filter("offset >= 2 and dff_valid").select("trial_id", "offset", "dff").collect()
    assert got == {tuple(r) for r in want} and len(got) == len(want) > 0
