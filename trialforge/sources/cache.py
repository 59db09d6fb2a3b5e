"""Tables kept under a key of their inputs, and reports whose numbers say where they come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame, SparkSession

from .integrity import content_id, write_once


def cached(spark: SparkSession, folder: str, inputs: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made from these inputs before, or made now and kept; folder may be in any store that Spark knows."""
    path = f"{folder}/{content_id(inputs)}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        write_once(make(), path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Cell:
    """A number of a report and the inputs it was made from: manifest hash, query, key."""

    value: float | int | str | None
    source: str
    query: str
    key: str = ""


class Report:
    """Tables in Markdown whose cells have ids; trace() says what a cell was made from."""

    def __init__(self, title: str):
        self.lines, self.cells = [f"# {title}", ""], {}

    def table(self, heading: str, columns: list[str], rows: list[list[Cell]]) -> "Report":
        self.lines += [f"## {heading}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        for row in rows:
            shown = []
            for c in row:
                name = f"c{len(self.cells) + 1}"
                self.cells[name] = c
                shown.append(f"{'-' if c.value is None else f'{c.value:.6g}' if isinstance(c.value, float) else c.value} <sup>{name}</sup>")
            self.lines.append("| " + " | ".join(shown) + " |")
        self.lines.append("")
        return self

    def trace(self, name: str) -> Cell:
        return self.cells[name]

    def text(self) -> str:
        notes = [f"- {n}: {c.query} {c.key}".rstrip() + f" on {c.source[:12]}" for n, c in self.cells.items()]
        return "\n".join([*self.lines, "## Sources of the cells", "", *notes]) + "\n"


def bars(title: str, values: dict[str, float], width: int = 480, height: int = 24) -> str:
    """A horizontal bar chart as SVG."""
    top = max([abs(v) for v in values.values()] + [1e-300])
    rows = []
    for i, (k, v) in enumerate(values.items()):
        y = 28 + i * height
        rows.append(f'<text x="4" y="{y + 15}">{escape(k)}</text><rect x="140" y="{y + 3}" width="{abs(v) / top * (width - 220):.1f}" height="{height - 8}" fill="{"#456" if v >= 0 else "#a54"}"/><text x="{width - 70}" y="{y + 15}">{v:.4g}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{36 + height * len(values)}" font-family="sans-serif" font-size="12"><text x="4" y="16" font-weight="bold">{escape(title)}</text>{"".join(rows)}</svg>'
