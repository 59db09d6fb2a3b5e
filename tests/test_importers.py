"""Recordings made here, with traces from both extractions, odd labels and codes, imported and compared with plain loops."""

import io
import pickle
import sys
import tarfile
import types

import numpy as np
import pytest

from trialforge.__main__ import main
from trialforge.importers import recordings as rec
from trialforge.importers import sheets
from trialforge.schemas import TABLES

NAMES = ("pumpprobe_20200102_101112", "pumpprobe_20200304_131415")
LABELS = (["AVAL", "", "RIG", "RIG", "", ""], ["SMDVL", "41", "smthng else", "AWBL"])
FRAMES, CODES = ([5, 25, 15, 33], [10, 20, 20]), ([0, -3, 2, -1], [-2, 3, -3])
MANUAL = (["# codes", "0", "1:x", "2", "-1"], ["2", "3", "-3"])
COMMENTS = ("", "0:no\n-1\n-3: ASKL \n")


def held(module, name, **state):
    parts = module.split(".")
    names = [".".join(parts[: i + 1]) for i in range(len(parts))]
    sys.modules.update({n: types.ModuleType(n) for n in names})
    kind = type(name, (), {"__module__": module})
    setattr(sys.modules[module], name, kind)
    try:
        x = kind()
        x.__dict__.update(state)
        return pickle.dumps(x)
    finally:
        for n in names:
            del sys.modules[n]


def show(m):
    return "\n".join(" ".join("nan" if np.isnan(v) else repr(float(v)) for v in row) for row in m) + "\n"


def write(folder, spoil=None):
    """Two recordings as text and in an archive, with a third in the archive alone; returns their matrices."""
    rng, out = np.random.default_rng(4), []
    text = folder / "text"
    text.mkdir()
    with tarfile.open(folder / "full.tar.gz", "w:gz") as tar:

        def add(name, data):
            info = tarfile.TarInfo(f"exported_data_full/{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))

        for i, name in enumerate((*NAMES, "pumpprobe_20210101_000000")):
            green, red, ml = (rng.normal(50, 5, (40, 4)).round(3) for _ in range(3))
            green[rng.random((40, 4)) < 0.2] = np.nan
            red[rng.random((40, 4)) < 0.2] = np.nan
            gcamp = green.copy()
            if i == 0:
                gcamp[:, 3] = ml[:, 3]
            head = "# {\"method\": \"box\"}\n"
            parts = {"green.txt": head + show(green), "red.txt": head + show(red), "green_matchless.txt": head + show(ml), "red_matchless.txt": head + show(-ml)}
            for k, v in parts.items():
                add(f"{name}/{k}", v.encode())
            if i < 2:
                out.append((gcamp, np.where(np.arange(4) == 3, -ml, red) if i == 0 else red))
                add(f"{name}/targets_manually_located.txt", ("\n".join(MANUAL[i]) + "\n").encode())
                add(f"{name}/targets_manually_located_comments.txt", COMMENTS[i].encode())
                n = len(FRAMES[i])
                add(f"{name}/recording.pickle", held("wormdatamodel.data.recording", "recording", nVolume=40, Dt=0.5, optogeneticsN=n if i == 0 else 9))
                add(f"{name}/fconn.pickle", held("pumpprobe.Fconn", "Fconn", n_neurons=4, stim_indices=np.array(FRAMES[i]), stim_neurons=np.array(CODES[i])))
                files = {"gcamp": show(gcamp), "t": "\n".join(str(0.5 * k) for k in range(40)) + "\n", "labels": "\n".join(LABELS[i]) + "\n", "stim_neurons": "\n".join(map(str, CODES[i])), "stim_volume_i": "\n".join(map(str, FRAMES[i])), "ds_name": f"/data/{name}/\n"}
                files |= (spoil or {}).get(i, {})
                for k, v in files.items():
                    (text / f"{i}_{k}.txt").write_text(v)
    return str(text), str(folder / "full.tar.gz"), out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    text, archive, matrices = write(tmp_path_factory.mktemp("export"))
    return {k: v.collect() for k, v in rec.import_recordings(spark, text, archive).items()}, matrices


def test_observations(made):
    tables, matrices = made
    got = {(r.recording_id, r.roi_index, r.frame): r for r in tables["observations"]}
    assert len(got) == 2 * 160 and tables["observations"][0].__fields__ == [c.split()[0] for c in TABLES["observations"].split(", ")]
    for name, (g, red) in zip(NAMES, matrices):
        for f in range(40):
            for i in range(4):
                r = got[f"randi2023:{name}", i, f]
                assert r.time_s == 0.5 * f and np.array_equal([r.gcamp, r.red], [g[f, i], red[f, i]], equal_nan=True)
                assert (r.gcamp_valid, r.red_valid) == (not np.isnan(g[f, i]), not np.isnan(red[f, i]))


def test_neurons_and_animals(made):
    got = {(r.recording_id[-6:], r.roi_index): (r.label, r.label_status, r.label_duplicated, r.neuron_id, r.trace_source) for r in made[0]["neurons"]}
    assert [got["101112", i] for i in range(4)] == [("AVAL", "name", False, "AVAL", "matched"), (None, "blank", False, None, "matched"), ("RIG", "name", True, None, "matched"), ("RIG", "name", True, None, "matchless")]
    assert [got["131415", i] for i in range(4)] == [("SMDVL", "name", False, "SMDVL", "matched"), ("41", "numeric", False, None, "matched"), ("smthng else", "other", False, None, "matched"), ("AWBL", "name", False, "AWBL", "matched")]
    a = {r.recording_id: r for r in made[0]["animals"]}[f"randi2023:{NAMES[1]}"]
    assert (a.animal_id, a.acquisition_date, a.n_frames, a.n_rois, a.n_stimulations, a.volume_interval_s) == (f"randi2023:animal:{NAMES[1]}", "2020-03-04", 40, 4, 3, 0.5)


def test_trials(made):
    rows = {(r.recording_id[-6:], r.event_index_in_file): r for r in made[0]["trials"]}
    pick = lambda i, e: (lambda r: (r.stim_index_in_recording, r.target_code, r.target_roi_index, r.target_label, r.target_neuron_id, r.next_stim_frame, r.trial_qc_flags))(rows[i, e])
    assert pick("101112", 0) == (0, "roi", 0, "AVAL", "AVAL", 15, [])
    assert pick("101112", 1) == (2, "roi", 1, None, None, 33, ["file_order_differs_from_time_order", "target_code_reconciled_from_manual_file"])
    assert pick("101112", 2) == (1, "roi", 2, "RIG", None, 25, ["file_order_differs_from_time_order"])
    assert pick("101112", 3) == (3, "not_located", None, None, None, None, ["target_not_located"])
    assert pick("131415", 0) == (0, "failed_targeting", None, None, None, 20, ["target_failed_targeting", "manual_target_superseded_by_export", "acquisition_metadata_unjoined"])
    assert pick("131415", 1) == (1, "roi", 3, "AWBL", "AWBL", 20, ["duplicate_stim_frame", "acquisition_metadata_unjoined"])
    assert pick("131415", 2) == (2, "identified_untracked", None, "ASKL", None, None, ["target_identified_untracked", "duplicate_stim_frame", "acquisition_metadata_unjoined"])
    r = rows["131415", 2]
    assert (r.previous_trial_id, r.previous_target_label, r.time_since_previous_s, r.stimulus_start_s) == (f"randi2023:{NAMES[1]}:stim001", "AWBL", 0.0, 10.0)
    g = made[1][0][0]
    assert rows["101112", 2].autoresponse_valid_fraction == pytest.approx(np.isfinite(g[15:25, 2]).mean())


def test_autoresponses(made):
    got = {}
    for r in made[0]["autoresponses"]:
        got.setdefault(r.trial_id[-30:], []).append((r.frame, r.time_rel_s))
    spans = {f"{NAMES[0]}:stim000"[-30:]: (0, 15, 5), f"{NAMES[0]}:stim001"[-30:]: (15, 33, 25), f"{NAMES[0]}:stim002"[-30:]: (5, 25, 15), f"{NAMES[1]}:stim001"[-30:]: (10, 20, 20)}
    assert {k: sorted(v) for k, v in got.items()} == {k: [(f, 0.5 * (f - s)) for f in range(a, b)] for k, (a, b, s) in spans.items()}


def test_checks(made):
    rows = {r.recording_id[-6:]: r for r in made[0]["checks"]}
    assert all(rows["101112"][1:]) and all(rows["131415"][1:5]) and not rows["131415"].acquisition_count_matches_events


@pytest.mark.parametrize(("spoil", "message"), [
    ({"gcamp": show(np.ones((40, 4)))}, "equals neither"), ({"stim_volume_i": "5\n25\n15\n40"}, "outside the recording"), ({"labels": "A\nB\nC\nD\nE\n"}, "not blank"),
    ({"t": "\n".join(["0"] * 40)}, "strictly increasing"), ({"ds_name": "/x/other"}, "unexpected recording name"), ({"stim_neurons": "0\n1"}, "no target code"),
])
def test_bad_exports(spark, tmp_path, spoil, message):
    text, archive, _ = write(tmp_path, {0: spoil})
    with pytest.raises(Exception, match=message):
        for df in rec.import_recordings(spark, text, archive).values():
            df.collect()


def cells(spark, sheets):
    rows = [("f", s, k, i, j, t) for k, (s, table) in enumerate(sheets.items()) for i, row in enumerate(table) for j, t in enumerate(row) if t is not None]
    return spark.createDataFrame(rows, "path string, sheet string, position int, row int, col int, text string")


def test_sheets(spark):
    wang = [["title"], [None, None, None], ["Class", "x", "Neuron", "Class", "Neurotransmitter(s)", "Comments"], ["AVA", None, "AVAL", None, " ACh ", "seen"], [None, None, "AVAR", None, "ACh"], [None, "x", None], [None, None, "RIGL", "RIG", "Glu"], [None, None, "RIGR"]]
    got = [tuple(r)[2:] for r in sheets.transmitter_sheet(cells(spark, {"a": wang})).orderBy("row").collect()]
    assert got == [("AVAL", "AVA", False, "ACh", "seen"), ("AVAR", "AVA", True, "ACh", None), ("RIGL", "RIG", False, "Glu", None), ("RIGR", "RIG", True, None, None)]
    for bad in ([["x"]], [["Class", "x", "Neuron"]]):
        with pytest.raises(ValueError):
            sheets.transmitter_sheet(cells(spark, {"a": bad}))
    info = [["Neuron", "b", "Type", "Segment"], ["units"], [" AVAL", None, "inter ", " "], [None, None, "x"], ["AVAR"]]
    assert [tuple(r)[2:] for r in sheets.neuron_sheet(cells(spark, {"Neuron information": info})).orderBy("row").collect()] == [("AVAL", "inter", None), ("AVAR", None, None)]
    with pytest.raises(ValueError):
        sheets.neuron_sheet(cells(spark, {"Neuron information": [["Name"]]}))
    book = {
        "1. NT": [["Neuron", "d", "a"], ["AVAL", "ACh", "Glu"], ["note: x", "y"], ["AVAR", "ACh"]], "3. Rec": [["Neurons"], ["AVAL", "glr-1", None, "acr-2"]],
        "4. Types": [["h"], ["h"], ["AVAL", *[None] * 6, "interneuron"], ["AVAR"]], "5. Sign": [["h"], ["h"], ["AVAL", None, None, "AVAR", "2.5", "chem", *[None] * 10, "+"], ["AVAL", None, None, "AVAR", "1", "chem"]],
    }
    out = {k: [tuple(r)[2:] for r in v.orderBy("row").collect()] for k, v in sheets.prediction_sheets(cells(spark, book)).items()}
    assert out == {"transmitters": [("AVAL", "ACh", "Glu"), ("AVAR", "ACh", None)], "receptors": [("AVAL", ["glr-1", "acr-2"])], "types": [("AVAL", "interneuron")], "signs": [("AVAL", "AVAR", 2.5, "chem", "+")]}


def test_ganglia_and_positions(spark):
    texts = spark.createDataFrame([("g", '{"A": ["x", "y"], "B": ["z"], "head": ["A"], "pharynx": []}')], "path string, value string")
    assert sorted(tuple(r)[1:] for r in sheets.ganglia(texts).collect()) == [("A", "x", True, False), ("A", "y", True, False), ("B", "z", False, False)]
    at = spark.createDataFrame([("p", "# AVAL AVAR\n1 2 3\n 4 5.5 -6\n\n")], "path string, value string")
    assert sorted(tuple(r)[1:] for r in sheets.positions(at).collect()) == [("AVAL", 1.0, 2.0, 3.0), ("AVAR", 4.0, 5.5, -6.0)]
    for bad in ("AVAL\n1 2 3", "# AVAL AVAR\n1 2 3\n"):
        with pytest.raises(Exception, match="don't match"):
            sheets.positions(spark.createDataFrame([("p", bad)], "path string, value string")).collect()


def test_commands(spark, tmp_path, capsys):
    text, archive, _ = write(tmp_path)
    assert main(["import", text, archive, str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert "observations 320" in said and "disagree: acquisition_count_matches_events" in said and spark.read.parquet(str(tmp_path / "out/trials")).count() == 7
    (tmp_path / "s.csv").write_text("animal,day,rule,baseline,nothing,rule_trimmed,baseline_trimmed,null_rule,null_baseline,null_samples\n" + "".join(f"a{i},d{i % 2},1,2,3,1,2,1,1,10\n" for i in range(6)))
    (tmp_path / "c.csv").write_text("level,rule,baseline\n0.5,0.5,0.5\n")
    assert main(["control", str(tmp_path / "s.csv"), str(tmp_path / "c.csv")]) == 0 and '"holds": true' in capsys.readouterr().out
    (tmp_path / "e.toml").write_text('tier = "G0"\nmax_nodes = 3\nmax_registers = 1\nops = ["add", "stimulus", "const"]\nconstants = [1]\nregister_init = [0]\n')
    assert main(["search", str(tmp_path / "e.toml")]) == 0 and '"generated": 9' in capsys.readouterr().out
