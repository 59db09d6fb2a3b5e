"""Readers on files made here, and integrity tools, with damaged and hostile input."""

import io
import os
import pickle
import sys
import tarfile
import types
import zipfile
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.schemas import TABLES, conform, schema
from trialforge.sources import archive as archive_source
from trialforge.sources import integrity, readers


def test_matrix_and_vector(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# {"dt": 0.5}\n1 nan 3e2\n -4.5\t5 6\n')
    got = {(r.row, r.col): r.value for r in readers.read_matrix(spark, str(tmp_path / "m.txt")).collect()}
    assert got[0, 2] == 300 and got[1, 0] == -4.5 and np.isnan(got[0, 1]) and len(got) == 6
    assert readers.read_matrix(spark, str(tmp_path / "m.txt")).first().header == '{"dt": 0.5}'
    for bad in ("1 inf", "1 x"):
        (tmp_path / "b.txt").write_text(bad)
        with pytest.raises(Exception, match="not a finite number"):
            readers.read_matrix(spark, str(tmp_path / "b.txt")).collect()
    (tmp_path / "v.txt").write_text("AVAL\n\nRIG\nRIG\n")
    assert [r.value for r in readers.read_vector(spark, str(tmp_path / "v.txt"), "string").orderBy("pos").collect()] == ["AVAL", "", "RIG", "RIG"]


def test_recordings(spark, tmp_path):
    for s in readers.SUFFIXES:
        (tmp_path / f"0_{s}.txt").write_text("1")
    rows = readers.recordings(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and set(rows[0].files) == set(readers.SUFFIXES)
    (tmp_path / "1_t.txt").write_text("1")
    with pytest.raises(Exception, match="recording lacks"):
        readers.recordings(spark, str(tmp_path)).select(F.size("files")).collect()


def archive(path, names):
    with tarfile.open(path, "w:gz") as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = len(n)
            t.addfile(info, io.BytesIO(n.encode()))


def test_archives(spark, tmp_path):
    archive(tmp_path / "a.tgz", ["r1/x.txt", "r1/y.txt", "r2/x.txt"])
    rows = readers.read_archives(spark, str(tmp_path / "a.tgz"), r"x\.txt$")
    assert sorted((r.folder, r.member, bytes(r.content)) for r in rows.collect()) == [("r1", "x.txt", b"r1/x.txt"), ("r2", "x.txt", b"r2/x.txt")]
    readers.require_members(rows, ["x.txt"])
    with pytest.raises(ValueError, match="z.txt"):
        readers.require_members(rows, ["x.txt", "z.txt"])
    archive(tmp_path / "b.tgz", ["r1/x", "r2/x", "r1/y"])
    with pytest.raises(Exception, match="two parts"):
        readers.read_archives(spark, str(tmp_path / "b.tgz")).collect()


def test_archive_by_offsets(spark, tmp_path):
    """Plain tars and zips are dealt out by bytes, several archives at once, and name their rows in the manifest."""
    names = [f"r{i}/{n}.txt" for i in range(12) for n in "ab"]
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for n in names:
            info = tarfile.TarInfo(n)
            data = (n + "\n\nx\n").encode() * 3
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("q/c.bin", b"\0\1")
        z.writestr("q/d.csv", b"1,2\n3,4")
    rows = archive_source.read_archives(spark, str(tmp_path / "*.*"), part_bytes=100)
    assert rows.rdd.getNumPartitions() > 10
    got = {(r["folder"], r["member"], r["rows"], r["bytes"]) for r in archive_source.member_manifest(rows).collect()}
    assert got == {(*n.split("/"), 6, 3 * len(n) + 12) for n in names} | {("q", "c.bin", None, 2), ("q", "d.csv", 2, 7)}
    uri = archive_source.read_archives(spark, f"file://{tmp_path}/a.tar", "r1/a")
    assert {bytes(r["content"]) for r in uri.collect()} == {b"r1/a.txt\n\nx\n" * 3}
    with pytest.raises(Exception, match="nothing.tar"):
        archive_source.read_archives(spark, str(tmp_path / "nothing.tar")).collect()


def test_archive_beyond_two_gib(spark, tmp_path):
    """A sparse archive of 2.5 GiB, its large member skipped by a seek; that member itself is refused by name."""
    path, size = tmp_path / "large.tar", 5 << 29
    with open(path, "wb") as f:
        for name, n in (("r1/raw.bin", size), ("r1/green.txt", 4), ("r2/green.txt", 6)):
            info = tarfile.TarInfo(name)
            info.size = n
            f.write(info.tobuf(tarfile.GNU_FORMAT))
            if n < 100:
                f.write(b"1\n2\n3\n"[:n] + bytes(512 - n))
            else:
                f.seek(n, 1)
        f.write(bytes(1024))
    assert path.stat().st_size > 2**31
    rows = archive_source.read_archives(spark, str(path), r"green\.txt$")
    found = archive_source.member_manifest(rows).collect()
    assert sorted((r["folder"], r["bytes"], r["rows"]) for r in found) == [("r1", 4, 2), ("r2", 6, 3)]
    with pytest.raises(Exception, match="raw.bin"):
        archive_source.read_archives(spark, str(path), "raw").select("bytes").collect()


def test_metrics_come_with_the_write(spark, tmp_path):
    """Counts are those of the written table; odd names; an empty table; once only."""
    rows = spark.createDataFrame([(i, None if i % 3 else i, i % 4 == 0 if i % 5 else None) for i in range(60)], "id int, `a.b ``c` int, ok boolean").repartition(3)
    seen = integrity.write_observed(rows, f"{tmp_path}/a")
    assert [(r["column"], r["rows"], r["nulls"], r["true"]) for r in seen] == [("id", 60, 0, None), ("a.b `c", 60, 40, None), ("ok", 60, 12, 12)]
    assert [r["rows"] for r in integrity.write_observed(rows.limit(0), f"{tmp_path}/b")] == [0, 0, 0]
    with pytest.raises(Exception, match="(?i)exists"):
        integrity.write_observed(rows, f"{tmp_path}/a")
    assert integrity.observed_manifest(spark, {"a": seen}).filter("`table` = 'a' and rows = 60").count() == 3


class Evil:
    def __reduce__(self):
        return os.system, ("true",)


def upstream(module, name, **state):
    """A pickle of an object of a class that isn't here."""
    kind = type(name, (), {"__module__": module})
    parts = module.split(".")
    names = [".".join(parts[: i + 1]) for i in range(len(parts))]
    sys.modules.update({n: types.ModuleType(n) for n in names})
    setattr(sys.modules[module], name, kind)
    try:
        x = kind()
        x.__dict__.update(state)
        return pickle.dumps(x)
    finally:
        for n in names:
            del sys.modules[n]


def test_pickles():
    got = readers.load_attributes(upstream("pumpprobe.Fconn", "Fconn", m=np.arange(3), s=np.float64(2.5), names=["a"]))
    assert got["m"].tolist() == [0, 1, 2] and got["s"] == 2.5 and got["names"] == ["a"]
    assert readers.load_attributes(upstream("wormdatamodel.data.recording", "recording", a=1)) == {"a": 1}
    bad = [pickle.dumps(Evil()), b"cbuiltins\neval\n(S'1'\ntR.", pickle.dumps({"a": 1}), pickle.dumps(OrderedDict(a=1)), upstream("pumpprobe.Other", "Fconn", a=1), upstream("elsewhere", "Thing", a=1)]
    for x in bad:
        with pytest.raises(pickle.UnpicklingError):
            readers.load_attributes(x)


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>A</t></r><r><t>VAL</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="AA3"><v>2.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    rows = readers.read_workbook(workbook())["S1"]
    assert rows[0] == ["name", None, "in"] and rows[1] == [] and rows[2][1] == "AVAL" and rows[2][26] == "2.5"
    (tmp_path / "w.xlsx").write_bytes(workbook())
    assert {(r.row, r.col): r.text for r in readers.read_workbooks(spark, str(tmp_path / "w.xlsx")).collect()} == {(0, 0): "name", (0, 2): "in", (2, 1): "AVAL", (2, 26): "2.5"}


def test_tables(spark, tmp_path):
    m = spark.createDataFrame([(["A", "B"], "[[0, 2], [1.5, 0]]")], "n array<string>, m string")
    assert {tuple(r) for r in readers.adjacency(m, "n", "m").collect()} == {("A", "B", 2.0), ("B", "A", 1.5)}
    w = spark.createDataFrame([("A", 0.0, 2.0), ("B", 1.0, 0.0)], "who string, A double, B double")
    assert {tuple(r) for r in readers.labelled_matrix(w, "who").collect()} == {("A", "B", 2.0), ("B", "A", 1.0)}
    (tmp_path / "e.tsv").write_text("pre\tpost\nA\tB\n#x\ty\n")
    assert readers.read_csv(spark, str(tmp_path / "e.tsv"), ["pre", "post"], "\t", "#").count() == 1
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "e.tsv"), ["a", "b"], "\t")
    f = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, line int, v string")
    assert {(r.k, r.v) for r in readers.first_rows(f, "k", "line").collect()} == {("a", "y"), ("b", "z")}
    assert readers.static_lists("A = ['x', 'y']\nB: list = ('z',)\nC = [1]\nraise SystemExit\n") == {"A": ["x", "y"], "B": ["z"]}


def test_schemas(spark):
    for t in TABLES:
        assert len(schema(t)) > 5
    x = spark.createDataFrame([("t", 1, 0.5, 1.0, 2.0, True, False)], "trial_id string, frame long, time_rel_s double, gcamp double, red double, gcamp_valid boolean, red_valid boolean")
    assert conform(x, "autoresponses").schema == schema("autoresponses")
    with pytest.raises(ValueError, match="lacks red_valid"):
        conform(x.drop("red_valid"), "autoresponses")


def test_frozen_folders(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    for n in "abc":
        (d / n).write_text(n)
    frozen = spark.createDataFrame(integrity.manifest(spark, str(d)).collect())
    integrity.verify_frozen(frozen, integrity.manifest(spark, str(d)))
    (d / "b").write_text("B")
    (d / "c").unlink()
    (d / "n").write_text("n")
    with pytest.raises(ValueError, match="not as frozen"):
        integrity.verify_frozen(frozen, integrity.manifest(spark, str(d)))
    assert {r.path[-1]: r.change for r in integrity.changes(frozen, integrity.manifest(spark, str(d))).collect()} == {"b": "changed", "c": "gone", "n": "new"}


def test_runs_and_logs(spark, tmp_path):
    run = integrity.run_manifest(tmp_path / "r", {"a": 1})
    assert run == integrity.run_manifest(tmp_path / "r", {"a": 1})
    with pytest.raises(ValueError):
        integrity.run_manifest(tmp_path / "r", {"a": 2})
    rows = spark.createDataFrame([(i, f"f{i}", 0.5 * i) for i in range(4)], "fold int, family string, mse double")
    log = str(tmp_path / "log")
    assert integrity.append_log(rows.limit(0).union(rows.filter("fold < 2")), log, ["fold", "family"]) == 2
    assert integrity.append_log(rows, log, ["fold", "family"]) == 2 and integrity.append_log(rows, log, ["fold", "family"]) == 0
    assert spark.read.json(log).count() == 4
    integrity.write_once(rows, str(tmp_path / "p"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        integrity.write_once(rows, str(tmp_path / "p"))


def test_fetch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "x").write_text("hello")
    good = integrity.Asset("x", (src / "x").as_uri(), 5, integrity.hashlib.sha256(b"hello").hexdigest())
    bad = integrity.Asset("y", (src / "x").as_uri(), 5, "0" * 64)
    lost = integrity.Asset("z", (src / "nope").as_uri())
    out = integrity.fetch([integrity.Source("s", [good, bad, lost])], tmp_path / "to", retries=2, wait=0)
    assert out["s/x"] == "fetched" and out["s/y"].startswith("failed") and out["s/z"].startswith("failed")
    assert sorted(os.listdir(tmp_path / "to/s")) == ["x"]
    (tmp_path / "to/s/x").write_text("other")
    assert integrity.fetch([integrity.Source("s", [good])], tmp_path / "to") == {"s/x": "differs, left as it is"}
    assert (tmp_path / "to/s/x").read_text() == "other"
    calls = []

    def flaky(url, to):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("busy")
        integrity.copy_local(url, to)

    assert integrity.fetch([integrity.Source("t", [good])], tmp_path / "to", get=flaky, wait=0) == {"t/x": "fetched"} and len(calls) == 3
    files = {r.path: r.bytes for r in integrity.files_frame(spark, tmp_path / "to").collect()}
    assert files == {"s/x": 5, "t/x": 5}
