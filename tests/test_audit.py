"""The audit of a made-up import against plain loops over its traces, and as a command."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge import audit as au
from trialforge.__main__ import main
from trialforge.operators import splits
from trialforge.sources import layout

from .test_layout import save

N, ROIS, FRAMES = 7, 5, 420
T = au.Thresholds(draws=200, schemes=(("group3", 3, 2), ("loao", None, 3)))


def build(spark, folder):
    """Seven recordings of five regions; the first region answers its own stimulus and region 1 answers region 0."""
    rng, obs, tried, own = np.random.default_rng(2), [], [], []
    for k in range(N):
        rec, stims = f"d:r{k}", sorted(rng.choice(np.arange(12, 400), 8, replace=False).tolist())
        g = rng.normal(50, 1.5, (FRAMES, ROIS))
        for i, f in enumerate(stims):
            target = int(rng.integers(0, 3)) if i else 0
            g[f + 2 : f + 12, target] += 25 * np.exp(-np.arange(len(g[f + 2 : f + 12])) / 5)
            if target == 0:
                g[f + 2 : f + 30, 1] += 8
            nxt = stims[i + 1] if i + 1 < len(stims) else None
            gone = rng.random() < 0.1  # no identified target
            tried.append((f"{rec}:stim{i}", f"d:animal:r{k}", rec, rec, i, f, nxt, 0.5 * f, "roi", target, None if gone else f"N{target}", None if gone else f"N{target}", 0.5 * (f - stims[i - 1]) if i else None, ["odd"] if i == 3 else []))
        ok = rng.random((FRAMES, ROIS)) > 0.12
        obs += [(rec, r, f, float(g[f, r]) if ok[f, r] else None, bool(ok[f, r])) for f in range(FRAMES) for r in range(ROIS)]
        own += [(t[0], f, 0.5 * (f - t[5]), bool(ok[f, t[9]])) for t in tried if t[2] == rec for f in range(t[5] - 5, t[6] or FRAMES)]
    names = "trial_id string, animal_id string, session_id string, recording_id string, stim_index_in_recording long, stim_frame long, next_stim_frame long, stimulus_start_s double, target_code string, target_roi_index int, target_label string, target_neuron_id string, time_since_previous_s double, trial_qc_flags array<string>"
    regions = [(f"d:r{k}", r, f"N{r}" if r < 4 else None, "name" if r < 4 else "blank") for k in range(N) for r in range(ROIS)]
    save(
        spark, folder, trials=spark.createDataFrame(tried, names), observations=spark.createDataFrame(obs, "recording_id string, roi_index int, frame int, gcamp double, gcamp_valid boolean"),
        autoresponses=spark.createDataFrame(own, "trial_id string, frame int, time_rel_s double, gcamp_valid boolean"), neurons=spark.createDataFrame(regions, "recording_id string, roi_index int, neuron_id string, label_status string"),
        animals=spark.createDataFrame([(f"d:animal:r{k}", f"d:r{k}", f"d:r{k}", "wt", FRAMES, 8, 0.5) for k in range(N)], "animal_id string, session_id string, recording_id string, genotype string, n_frames long, n_stimulations long, volume_interval_s double"),
    )
    spark.range(1).write.parquet(f"{folder}/manifest")
    return tried, obs, own


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("audit")
    tried, obs, own = build(spark, str(base / "in"))
    layout.prepare(spark, str(base / "in"), str(base / "laid"), 4)
    tables = {k: v.toPandas() for k, v in au.audit(spark, str(base / "in"), str(base / "laid"), T).items()}
    return base, tried, obs, own, tables


@pytest.fixture(scope="module")
def plain(made):
    """Amplitude of each trace by a loop, with what else the checks need."""
    _, tried, obs, own, _ = made
    value = {(o[0], o[1], o[2]): o[3] for o in obs if o[4]}
    ends = defaultdict(list)
    for trial, _, rel, ok in own:
        if rel >= 0:
            ends[trial].append(ok)
    valid = {t for t, x in ends.items() if np.mean(x) >= T.own_valid}
    traces = {}
    for t in tried:
        for r in range(ROIS):
            at = {o: value[t[2], r, t[5] + o] for o in range(-10, 60) if (t[2], r, t[5] + o) in value and (o < 0 or t[6] is None or t[5] + o < t[6])}
            base = [x for o, x in at.items() if o < -1]
            y = {o: x / np.mean(base) - 1 for o, x in at.items() if abs(o) > 1} if len(base) >= 4 else {}
            hit = [y[o] for o in range(2, 31) if o in y]
            traces[t[0], r] = np.mean(hit) if len(hit) >= 14.5 else None
    return valid, traces


def test_pairs_and_targets(made, plain):
    _, tried, *_, tables = made
    valid, traces = plain
    groups = defaultdict(lambda: defaultdict(list))
    for t in tried:
        for r in range(4):
            if t[11] and r != t[9] and traces[t[0], r] is not None:
                groups[t[11], f"N{r}"][t[1]].append(traces[t[0], r])
    got = {(r.target, r.responder): r for r in tables["pair_coverage"].itertuples()}
    assert set(got) == set(groups) and len(got) == 9
    multi, strong = Counter(), Counter()
    for key, by in groups.items():
        x, k = np.concatenate(list(by.values())), len(by)
        n, r = len(x), got[key]
        t = x.mean() / (x.std(ddof=1) / np.sqrt(n))
        assert (r.n_trials, r.n_animals) == (n, k)
        assert [r.mean_amplitude, r.sd_amplitude, r.t_statistic, r.between_animal_sd_of_means] == pytest.approx([x.mean(), x.std(ddof=1), t, np.std([np.mean(v) for v in by.values()], ddof=1)])
        within = sum(np.sum((v - np.mean(v)) ** 2) for v in by.values()) / (n - k)
        ssb = sum(len(v) * (np.mean(v) - x.mean()) ** 2 for v in by.values())
        between = max(0, (ssb / (k - 1) - within) / ((n - sum(len(v) ** 2 for v in by.values()) / n) / (k - 1)))
        assert [r.within_animal_variance, r.between_animal_variance] == pytest.approx([within, between], abs=1e-12)
        multi[key[0]] += k >= 2
        strong[key[0]] += k >= 2 and abs(t) >= 3
    for r in tables["target_eligibility"].itertuples():
        mine = [t for t in tried if t[11] == r.target]
        own = {t[1] for t in mine if t[0] in valid}
        assert (r.n_animals, r.n_trials, r.n_animals_valid_own) == (len({t[1] for t in mine}), len(mine), len(own))
        assert (r.responders_multi_animal, r.responsive_pairs, r.eligible) == (multi[r.target], strong[r.target], len(own) >= 3 and multi[r.target] >= 2)


def test_folds(spark, made, plain):
    _, tried, *_, tables = made
    valid, _ = plain
    animals = spark.createDataFrame([(f"d:animal:r{k}",) for k in range(N)], "animal_id string")
    eligible = set(tables["target_eligibility"].query("eligible").target)
    for name, k, inner in T.schemes:
        folds = splits.nested(animals, "animal_id", k or 0, inner, T.seed, None if k else splits.leave_one_out(animals, "animal_id")).toPandas()
        assert folds.outer.nunique() == (k or N)
        for r in tables["fold_coverage"].query("scheme == @name").itertuples():
            own = {t[1] for t in tried if t[0] in valid and t[11] == r.target}
            ok = []
            for _, f in folds.groupby("outer"):
                if own & set(f[f.role == "test"].animal_id):
                    tr = f[f.role == "train"]
                    ok.append(sum(bool(own & set(tr[tr.inner == i].animal_id)) and bool(own & set(tr[tr.inner != i].animal_id)) for i in range(inner)))
            assert (r.outer_test_folds, r.test_animals, r.least_inner, r.covered) == (len(ok), len(own), min(ok), min(ok) >= 1)
            assert r.mean_inner == pytest.approx(np.mean(ok)) and r.target in eligible


def test_facts(made, plain):
    _, tried, obs, own, tables = made
    valid, traces = plain
    got = {(s, n): v for s, n, v in tables["facts"][["section", "name", "value"]].itertuples(index=False)}
    assert got["counts", "trials"] == 8 * N and got["counts", "rois"] == ROIS * N and got["roi_label_status", "blank"] == N
    assert got["counts", "trials_with_identified_target"] == sum(t[11] is not None for t in tried)
    assert got["quality", "own_traces_valid"] == len(valid) and got["quality", "without_amplitude"] == sum(v is None for v in traces.values())
    assert got["quality", "own_with_amplitude"] == sum(traces[t[0], t[9]] is not None for t in tried)
    assert got["trial_flags", "odd"] == N and got["animals_by_genotype", "wt"] == N
    gaps = [t[12] for t in tried if t[12] is not None]
    assert [got["spread", f"inter_stimulus_s.{q}"] for q in ("n", *au.QUARTILES)] == pytest.approx([len(gaps), *np.quantile(gaps, list(au.QUARTILES.values()))])
    post = [min(t[6] - t[5], 60) for t in tried if t[6]]
    assert got["spread", "volumes_before_next.median"] == np.median(post) and got["spread", "recording_s.max"] == FRAMES / 2
    same = sum(a[2] == b[2] and a[11] is not None and a[11] == b[11] for a, b in zip(tried, tried[1:]))
    assert got["stimulus", "same_target_as_before"] == same
    assert got["kinetics", "strong"] > 5 and got["go", "targets"] >= 1 and sum(k[0] == "chosen" for k in got) == 1
    assert got["pairs_by_n_animals", "5-9"] + got["pairs_by_n_animals", "3-4"] == got["pairs", "pairs"] == 9
    slopes = []
    for k in range(N):
        x = [(t[4], traces[t[0], t[9]]) for t in tried if t[2] == f"d:r{k}" and t[0] in valid and traces[t[0], t[9]] is not None]
        if len(x) >= 5:
            slopes.append(np.polyfit(*zip(*x), 1)[0])
    r = tables["drift"].set_index("measure").loc["own_amplitude_by_index"]
    assert r.n == len(slopes) and r["mean"] == pytest.approx(np.mean(slopes)) and r.lo <= r["mean"] <= r.hi


def test_command(spark, made, tmp_path, capsys):
    base = made[0]
    out = str(tmp_path / "out")
    assert main(["audit", str(base / "in"), out, str(tmp_path / "report.md"), "--draws", "50"]) == 0
    assert capsys.readouterr().out.startswith("go ")
    text = (tmp_path / "report.md").read_text()
    assert "## quality" in text and "facts counts/trials on" in text and "## drift" in text
    assert spark.read.parquet(f"{out}/pair_coverage").count() == 9


def test_nothing_tried(spark, made, tmp_path):
    src = str(tmp_path / "in")
    tables = {n: spark.read.parquet(f"{made[0]}/in/{n}") for n in ("trials", "observations", "autoresponses", "neurons", "animals")}
    save(spark, src, **{n: df if n == "animals" else df.limit(0) for n, df in tables.items()})
    layout.prepare(spark, src, str(tmp_path / "laid"), 2)
    got = au.audit(spark, src, str(tmp_path / "laid"), T)
    assert got["pair_coverage"].count() == got["target_eligibility"].count() == 0
    assert {r["name"]: r["value"] for r in got["facts"].filter("section = 'counts'").collect()}["trials"] == 0
