"""Tables from workbooks and small annotation files, as frames over their cells (see sources.readers.read_workbooks).

The layouts are fixed by the published files; a file of another layout is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import fill_down

#: Names that are neurons', sheets by the start of their names, columns by number.
NAME = r"^[A-Z][A-Za-z0-9]*$"
SHEETS = {"transmitters": "1.", "receptors": "3.", "types": "4.", "signs": "5."}


def rows_of(cells: DataFrame, sheet: Column) -> DataFrame:
    """path, row and c, a map from column number to text, trimmed, of the rows of a sheet that hold something."""
    found = cells.filter(sheet).select("path", "row", "col", F.trim("text").alias("text")).filter("text <> ''")
    return found.groupBy("path", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("c"))


def _cell(i: Column | int) -> Column:
    return F.try_element_at("c", i if isinstance(i, Column) else F.lit(i))


def _needed(found: DataFrame, paths: DataFrame, what: str) -> None:
    """An error that names the files for which found has no row."""
    lost = [r.path for r in paths.select("path").distinct().join(found.select("path").distinct(), "path", "left_anti").collect()]
    if lost:
        raise ValueError(f"{what}: {', '.join(sorted(lost))}")


def transmitter_sheet(cells: DataFrame) -> DataFrame:
    """path, row, neuron, cell_class, class_filled_down, transmitter, comments of a workbook's first sheet.

    The header is the first row with Neuron in its third column; a class is written on the first row of its group and
    filled down from there, which is said.
    """
    first = cells.groupBy("path").agg(F.min_by("sheet", "position").alias("first"))
    rows = rows_of(cells.join(first, "path").filter("sheet = first"), F.lit(True))
    heads = rows.filter(_cell(2) == "Neuron").groupBy("path").agg(F.min_by(F.struct("row", "c"), "row").alias("h")).select("path", F.col("h.row").alias("at"), F.map_entries("h.c").alias("names"))
    _needed(heads, cells, "no header row with Neuron")
    where = lambda test: F.array_sort(F.transform(F.filter("names", test), lambda e: e["key"]))
    heads = heads.select("path", "at", where(lambda e: e["value"] == "Class").alias("classes"), where(lambda e: e["value"].startswith("Neurotransmitter")).alias("nt"), where(lambda e: e["value"] == "Comments").alias("notes"))
    _needed(heads.filter("size(nt) > 0"), cells, "no column of transmitters")
    x = rows.join(heads, "path").filter(F.col("row") > F.col("at")).withColumn("neuron", _cell(2)).filter("neuron is not null")
    own = F.when(F.size("classes") > 0, F.coalesce(_cell(F.element_at("classes", -1)), _cell(F.element_at("classes", 1))))
    x = x.select("path", "row", "neuron", own.alias("own"), _cell(F.get("nt", F.lit(0))).alias("transmitter"), F.when(F.size("notes") > 0, _cell(F.element_at("notes", 1))).alias("comments"))
    x = fill_down(x, ["path"], ["row"], F.col("own"))
    return x.select("path", "row", "neuron", F.col("filled").alias("cell_class"), (F.col("own").isNull() & F.col("filled").isNotNull()).alias("class_filled_down"), "transmitter", "comments")


def neuron_sheet(cells: DataFrame) -> DataFrame:
    """path, row, neuron, cell_type, segment of the sheet Neuron information: two rows of header, columns 0, 2 and 3."""
    rows = rows_of(cells, F.col("sheet") == "Neuron information")
    _needed(rows.filter((F.col("row") == 0) & (_cell(0) == "Neuron")), cells, "unexpected layout")
    return rows.filter("row >= 2").select("path", "row", _cell(0).alias("neuron"), _cell(2).alias("cell_type"), _cell(3).alias("segment")).filter("neuron is not null")


def prediction_sheets(cells: DataFrame) -> dict[str, DataFrame]:
    """transmitters, receptors, types and signs of a workbook with a sheet for each, found by the start of its name."""
    of = {k: rows_of(cells, F.col("sheet").startswith(v)) for k, v in SHEETS.items()}
    named = lambda df: df.withColumn("neuron", _cell(0)).filter(F.col("neuron").rlike(NAME))
    out = {
        "transmitters": named(of["transmitters"].filter("row >= 1")).select("path", "row", "neuron", _cell(1).alias("dominant"), _cell(2).alias("alternative")),
        "receptors": named(of["receptors"]).filter(~F.col("neuron").startswith("Neuron")).select("path", "row", "neuron", F.transform(F.array_sort(F.filter(F.map_entries("c"), lambda e: e["key"] > 0)), lambda e: e["value"]).alias("genes")),
        "types": named(of["types"].filter("row >= 2")).select("path", "row", "neuron", _cell(7).alias("type")).filter("type is not null"),
    }
    signs = of["signs"].filter("row >= 2").select("path", "row", _cell(0).alias("pre"), _cell(3).alias("post"), _cell(4).cast("double").alias("weight"), _cell(5).alias("kind"), _cell(16).alias("sign"))
    out["signs"] = signs.dropna()
    for k in ("transmitters", "signs"):
        _needed(out[k], cells, f"no rows of {k}")
    return out


def ganglia(texts: DataFrame) -> DataFrame:
    """path, ganglion, neuron, in_head, in_pharynx from files (path, value) that hold JSON of names to lists; the lists
    head and pharynx name ganglia."""
    x = texts.select("path", F.from_json("value", "map<string,array<string>>").alias("m"))
    member = x.select("path", F.col("m")["head"].alias("head"), F.col("m")["pharynx"].alias("pharynx"), F.explode(F.map_filter("m", lambda k, _: ~k.isin("head", "pharynx"))).alias("ganglion", "neurons"))
    within = lambda c: F.coalesce(F.array_contains(c, F.col("ganglion")), F.lit(False))
    return member.select("path", "ganglion", F.explode("neurons").alias("neuron"), within("head").alias("in_head"), within("pharynx").alias("in_pharynx"))


def positions(texts: DataFrame) -> DataFrame:
    """path, neuron, x, y, z from files (path, value): names after # in the first line, a line of coordinates for each."""
    lines = F.filter(F.split("value", "\r?\n"), lambda s: F.trim(s) != "")
    x = texts.select("path", lines.alias("l")).withColumn("names", F.split(F.trim(F.regexp_replace(F.col("l")[0], "^#+", "")), r"\s+"))
    bad = ~F.col("l")[0].startswith("#") | (F.size("names") != F.size("l") - 1)
    x = x.select("path", F.when(bad, F.raise_error(F.concat("path", F.lit(": names and coordinates don't match")))).otherwise(F.arrays_zip("names", F.expr("slice(l, 2, size(l) - 1)").alias("at"))).alias("z"))
    each = x.select("path", F.explode("z").alias("z")).select("path", F.col("z.names").alias("neuron"), F.split(F.trim("z.at"), r"\s+").alias("c"))
    return each.select("path", "neuron", *[F.col("c")[i].cast("double").alias(k) for i, k in enumerate("xyz")])

