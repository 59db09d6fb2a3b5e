"""Gates, nested selection over folds, freezing, and evaluation that can be done once."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import RuleError
from ..rules.program import Program
from ..sim.arrays import simulate
from ..sources.integrity import content_id, read_locked, write_locked
from ..tables import ordered

MOST_RESPONSE, KERNEL_BITS = 1e3, 32


class Candidate(Protocol):
    """What a search compares: choices made on inner folds, a final fit, a score on data it hasn't seen."""

    key: str

    def inner_select(self, train, inner_folds) -> float: ...

    def fit_final(self, train) -> None: ...

    def score(self, test) -> float: ...


def structure_gate(p: Program) -> str | None:
    """Why a program can't answer a stimulus through the network, or None."""
    ops = {n.op for n in p.nodes}
    if "stimulus" not in ops:
        return "ignores the stimulus"
    if "sum_in" not in ops and "count_in" not in ops and p.gap is None:
        return "doesn't couple"
    return None


def dynamics_gate(p: Program, spec: dict) -> str | None:
    """Why a run of spec disqualifies a program, or None."""
    try:
        out = simulate(p, spec)
    except RuleError as e:
        return f"fails: {e.code}"
    return "too large" if np.abs(out.observation).max(initial=0) > MOST_RESPONSE else None


def response_kernels(p: Program, spec: dict, neuron: str, pulse: float, knots: tuple[int, ...], dt: float) -> np.ndarray:
    """(knots, neurons): the response to a pulse held for one volume less the run without it, over the pulse, read one
    volume later at each knot. A volume longer than the rule's dt_max is cut into equal steps."""
    sub = max(1, int(np.ceil(dt / p.dt_max))) if p.dt_max else 1
    ticks = [(k + 1) * sub for k in knots]
    base = spec | {"dt": dt / sub, "n_steps": ticks[-1], "sample_ticks": ticks}
    on = base | {"stimulus": [{"neuron": neuron, "start": 0, "end": sub, "amplitude": pulse}]}
    return (simulate(p, on).observation - simulate(p, base | {"stimulus": []}).observation) / pulse


def rank(rows: DataFrame) -> DataFrame:
    """rows (outer, key, inner_nll, l_total) with place, by (inner_nll, l_total, key) within each outer fold."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("outer").orderBy("inner_nll", "l_total", "key")))


def pareto(rows: DataFrame, cost: str, price: str, group: str) -> DataFrame:
    """The rows of a group that no other beats: in order of price, those whose cost is under all cheaper ones'."""
    cheaper = ordered(rows.groupBy(group, price).agg(F.min(cost).alias("__c")), [group], [price], None, least={"__before": "__c"})
    x = rows.join(cheaper, [group, price])
    return x.filter((F.col(cost) == F.col("__c")) & (F.col("__before").isNull() | (F.col(cost) < F.col("__before")))).select(*rows.columns)


@dataclass
class Views:
    """A fold's training and test trials as frames of their own; what is handed to a candidate holds nothing of the test."""

    train: DataFrame
    test: DataFrame

    @classmethod
    def of(cls, trials: DataFrame, folds: DataFrame, outer: int, group: str = "animal") -> "Views":
        part = lambda role: trials.join(folds.filter((F.col("outer") == outer) & (F.col("role") == role)).select(group), group, "left_semi")
        return cls(part("train"), part("test"))


def freeze_selection(path: str | Path, selection: dict) -> str:
    """Write down what was chosen before anything is scored; never overwritten."""
    return write_locked(path, selection)


class Locked:
    """Scores each fold of a frozen selection once: a lock file for the fold is made first, and its presence refuses."""

    def __init__(self, selection: str | Path, folder: str | Path, score: Callable[[dict, int], float]):
        self.selection, self.folder, self._score = read_locked(selection), Path(folder), score
        self.folder.mkdir(parents=True, exist_ok=True)

    def score(self, fold: int) -> float:
        if str(fold) not in {str(f) for f in self.selection["folds"]}:
            raise ValueError(f"fold {fold} isn't in the selection")
        try:
            fd = os.open(self.folder / f"fold-{fold}.{content_id(self.selection)[:12]}.lock", os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            raise PermissionError(f"fold {fold} was scored before") from None
        os.close(fd)
        return self._score(self.selection, fold)
