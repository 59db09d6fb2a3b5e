"""Scans of the formats that recordings and annotations come in; each gives a long DataFrame with explicit positions."""

from __future__ import annotations

import ast
import io
import pickle
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import read_archives  # noqa: F401

#: What a recording's files are called, and which of them it must have.
SUFFIXES = ("gcamp", "t", "labels", "stim_neurons", "stim_volume_i", "ds_name")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """path, header, row, col, value: whitespace-separated numbers, with an optional first line of # and JSON.

    nan is a value; an infinite or unreadable number is an error. Rows are numbered from 0 after the header.
    """
    return matrix_cells(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def matrix_cells(texts: DataFrame) -> DataFrame:
    """What read_matrix gives, of texts (path, value)."""
    text = texts.select("path", F.split(F.rtrim("value"), "\r?\n").alias("lines"))
    has = F.substring(F.col("lines")[0], 1, 1) == "#"
    text = text.select("path", F.when(has, F.trim(F.expr("substring(lines[0], 2)"))).alias("header"), F.expr("if(substring(lines[0], 1, 1) = '#', slice(lines, 2, size(lines)), lines)").alias("lines"))
    cells = text.select("path", "header", F.posexplode("lines").alias("row", "line")).filter(F.trim("line") != "").select("path", "header", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "t"))
    value = F.expr("try_cast(t as double)")
    bad = value.isNull() | (F.abs(value) == float("inf"))
    return cells.select("path", "header", "row", "col", F.when(bad, F.raise_error(F.concat(F.lit("not a finite number: "), "t"))).otherwise(value).alias("value"))


def read_vector(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """path, pos, value: one value per line, in order; trailing blank lines don't count."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.rtrim("value") if kind != "string" else F.regexp_replace("value", r"\r?\n$", ""), "\r?\n").alias("lines"))
    rows = text.select("path", F.posexplode("lines").alias("pos", "t"))
    return rows.select("path", "pos", F.col("t").cast(kind).alias("value"))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """index and its files by suffix; a recording that lacks one of SUFFIXES is an error."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", r"(\d+)_(\w+)\.txt$", 1).alias("i"), F.regexp_extract("path", r"(\d+)_(\w+)\.txt$", 2).alias("suffix")).filter("i <> ''")
    by = files.groupBy(F.col("i").cast("int").alias("index")).agg(F.map_from_entries(F.collect_list(F.struct("suffix", "path"))).alias("files"))
    lacks = F.array_except(F.array(*map(F.lit, SUFFIXES)), F.map_keys("files"))
    return by.withColumn("files", F.when(F.size(lacks) > 0, F.raise_error(F.concat(F.lit("recording lacks "), F.array_join(lacks, ", ")))).otherwise(F.col("files")))


def require_members(found: DataFrame, wanted: list[str]) -> DataFrame:
    """found, or an error that names the wanted members it lacks."""
    want = found.sparkSession.createDataFrame([(w,) for w in wanted], "member string")
    lost = [r.member for r in want.join(found.select("member"), "member", "left_anti").collect()]  # a part of wanted
    if lost:
        raise ValueError(f"missing members: {', '.join(sorted(lost))}")
    return found


class _Held:
    """Stands for an object of a class that isn't loaded: its attributes and nothing else."""

    def __setstate__(self, state):
        if not isinstance(state, dict):
            raise pickle.UnpicklingError("an object's state must be a dict of its attributes")
        self.__dict__.update(state)


class _Allowed(pickle.Unpickler):
    """Only what is on the lists can be made; everything else in a pickle is refused."""

    #: Classes whose objects are held by attributes, and what arrays are made with.
    HELD = (("wormdatamodel.data.recording", "recording"), ("pumpprobe.Fconn", "Fconn"))
    ARRAYS = (("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "scalar"))

    def find_class(self, module: str, name: str):
        if (module, name) in self.HELD:
            return _Held
        if (module, name) in self.ARRAYS:
            return super().find_class(module.replace("numpy.core", "numpy._core"), name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def load_attributes(content: bytes) -> dict:
    """The attributes of a pickled object of a listed class, without running any code of it; other pickles are refused."""
    out = _Allowed(io.BytesIO(content)).load()
    if not isinstance(out, _Held):
        raise pickle.UnpicklingError(f"not an object of a listed class but {type(out).__name__}")
    return dict(vars(out))


def read_workbook(content: bytes) -> dict[str, list[list[str | None]]]:
    """Sheet name to rows of cell texts; gaps in a row are None. Shared and inline strings, no formulas' sources."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parse = lambda name: ElementTree.fromstring(z.read(name))
        local = lambda e: e.tag.rpartition("}")[2]
        text_of = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
        shared = [text_of(si) for si in parse("xl/sharedStrings.xml") if local(si) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        links = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
        out = {}
        for sheet in (e for e in parse("xl/workbook.xml").iter() if local(e) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            rows: list[list[str | None]] = []
            for row in (e for e in parse("xl/" + target.removeprefix("/xl/")).iter() if local(e) == "row"):
                number = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(number - len(rows))]
                cells = rows[number - 1]
                for c in row:
                    at = column_index(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = next((v.text for v in c if local(v) == "v"), None)
                    cells[at] = text_of(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value
            out[sheet.get("name")] = rows
        return out


def column_index(cell: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for ch in cell:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, position (of the sheet), row, col, text: all cells that hold something, of all workbooks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                cells = [(name, s, k, i, j, t) for k, (s, rows) in enumerate(read_workbook(content).items()) for i, row in enumerate(rows) for j, t in enumerate(row) if t is not None]
                cols = list(zip(*cells)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["path", "sheet", "position", "row", "col", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, "path string, sheet string, position int, row int, col int, text string")


def adjacency(df: DataFrame, names: str, matrix: str) -> DataFrame:
    """pre, post, weight of the nonzero entries of a square matrix: names array<string>, matrix JSON text of arrays."""
    m = df.select(F.col(names).alias("n"), F.posexplode(F.from_json(matrix, "array<array<double>>")).alias("i", "r")).select("n", "i", F.posexplode("r").alias("j", "weight"))
    return m.filter("weight <> 0").select(F.element_at("n", F.col("i") + 1).alias("pre"), F.element_at("n", F.col("j") + 1).alias("post"), "weight")


def labelled_matrix(df: DataFrame, label: str) -> DataFrame:
    """pre, post, weight of the nonzero entries of a wide table: a label column and one column per target."""
    targets = [c for c in df.columns if c != label]
    return df.unpivot([label], targets, "post", "weight").withColumnRenamed(label, "pre").filter("weight <> 0")


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", comment: str | None = None) -> DataFrame:
    """A headered text table as strings; other header names than columns are an error."""
    df = spark.read.csv(path, header=True, sep=sep, comment=comment)
    if df.columns != columns:
        raise ValueError(f"header is {df.columns}, not {columns}")
    return df


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order."""
    picked = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("row"))
    return picked.select("row.*")


def static_lists(source: str) -> dict[str, list[str]]:
    """Names of lists of string literals in Python source, and what they hold; the source is parsed, never run."""
    out = {}
    for node in ast.walk(ast.parse(source)):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        value = getattr(node, "value", None)
        if isinstance(value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in value.elts):
            out |= {t.id: [e.value for e in value.elts] for t in targets if isinstance(t, ast.Name)}
    return out
