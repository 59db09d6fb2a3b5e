"""The command line, the table cache and reports."""

import json

import pytest

from trialforge.__main__ import main
from trialforge.sources.cache import Cell, Report, bars, cached

RULE = "wrl 0.1\ntier G1\nstate v : 1 = 0\nnext v = leaky_integrate(v, stimulus, 0.5[s])\nobserve identity_v1(v)\n"


def test_rule_and_simulate(tmp_path, capsys):
    (tmp_path / "a.wrl").write_text(RULE)
    assert main(["rule", "canon", str(tmp_path / "a.wrl")]) == 0
    text = capsys.readouterr().out
    (tmp_path / "b.wrl").write_text(text)
    main(["rule", "inspect", str(tmp_path / "b.wrl")])
    data = capsys.readouterr().out
    (tmp_path / "b.json").write_text(data)
    (tmp_path / "case.json").write_text(json.dumps({"dt": 0.1, "n_steps": 2, "graph": {"neurons": [{"id": "A"}]}, "stimulus": [{"neuron": "A", "start": 0, "end": 9, "amplitude": 1}]}))
    outs = []
    for f in ("a.wrl", "b.json"):
        assert main(["simulate", "--program", str(tmp_path / f), "--case", str(tmp_path / "case.json")]) == 0
        outs.append(json.loads(capsys.readouterr().out))
    assert outs[0]["observation"] == outs[1]["observation"] and outs[0]["program_hash"] == outs[1]["program_hash"] == json.loads(data)["program_hash"]
    (tmp_path / "bad.wrl").write_text(RULE.replace("stimulus", "nothing"))
    assert main(["rule", "canon", str(tmp_path / "bad.wrl")]) == 1


def test_queries_splits_search_sources(spark, sf, tmp_path, capsys):
    assert main(["query", "--list"]) == 0 and "pair_coverage" in capsys.readouterr().out
    assert main(["query", "strata", "--tables", sf, "--out", str(tmp_path / "q")]) == 0 and spark.read.parquet(str(tmp_path / "q")).count() == 1
    spark.createDataFrame([(f"a{i}",) for i in range(12)], "animal string").write.parquet(str(tmp_path / "animals"))
    assert main(["splits", str(tmp_path / "animals"), "animal", str(tmp_path / "split.json"), "--k", "3"]) == 0
    with pytest.raises(FileExistsError):
        main(["splits", str(tmp_path / "animals"), "animal", str(tmp_path / "split.json")])
    (tmp_path / "c.json").write_text(json.dumps({"tier": "G0", "max_nodes": 3, "max_registers": 1, "ops": ["add", "stimulus", "const"], "constants": [1]}))
    capsys.readouterr()
    assert main(["search", str(tmp_path / "c.json")]) == 0
    n = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert n["unique"] + n["duplicates"] == n["generated"] == 9
    (tmp_path / "x").write_text("x")
    (tmp_path / "reg.json").write_text(json.dumps({"sources": [{"id": "s", "assets": [{"path": "x", "url": (tmp_path / "x").as_uri(), "bytes": 1}]}]}))
    assert main(["sources", "verify", str(tmp_path / "reg.json"), "--folder", str(tmp_path / "d")]) == 1
    assert main(["sources", "fetch", str(tmp_path / "reg.json"), "--folder", str(tmp_path / "d")]) == 0
    assert main(["sources", "verify", str(tmp_path / "reg.json"), "--folder", str(tmp_path / "d")]) == 0


def test_cache_and_report(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    for inputs in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert cached(spark, str(tmp_path), inputs, make).count() == 5
    assert len(made) == 2
    r = Report("Coverage").table("Pairs", ["target", "n"], [[Cell("T1", "abcdef0123456789", "pair_coverage", "T1"), Cell(3, "abcdef0123456789", "pair_coverage", "T1")]])
    assert "T1 <sup>c1</sup>" in r.text() and r.trace("c2").value == 3
    assert bars("a < b", {"x": 1.0, "y": -2.0}).count("<rect") == 2
