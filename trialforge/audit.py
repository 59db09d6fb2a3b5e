"""Audit of an import: what was recorded, which pairs and targets carry enough of it, and whether a split can hold animals out.

Everything is computed from the imported tables and the traces that sources.layout cuts. Tables of pairs, targets and
folds stay tables; single numbers are rows (section, name, value), of which there are some per measure and category.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import resample, splits, windows
from .sources import layout
from .tables import quantiles, scratch


@dataclass(frozen=True)
class Thresholds:
    """Fixed before any model is scored. own_valid: valid share of a target's own trace; over_noise: its peak in
    standard deviations of its baseline; schemes: name, outer folds (none: an animal each), inner folds."""

    own_valid: float = 0.8
    over_noise: float = 3.0
    responder_animals: int = 2
    target_animals: int = 3
    target_responders: int = 2
    pair_t: float = 3.0
    seed: int = 20261008
    draws: int = 2000
    schemes: tuple[tuple[str, int | None, int], ...] = (("group5", 5, 3), ("group10", 10, 3), ("loao", None, 5))


TRACE = ["trial_id", "recording_id", "roi_index", "neuron_id", "target_neuron_id", "is_target", "f0", "pre_sd"]
QUARTILES = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}
STRATA = {"1": (1, 1), "2": (2, 2), "3-4": (3, 4), "5-9": (5, 9), "10+": (10, 1 << 62)}


def _facts(section: str, row: DataFrame) -> DataFrame:
    """A row of numbers as one row each."""
    numbers = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return numbers.unpivot([], numbers.columns, "name", "value").select(F.lit(section).alias("section"), "name", "value")


def _tally(section: str, rows: DataFrame, by: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(by.cast("string"), F.lit("none")).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "value")


def _spread(section: str, measures: list[DataFrame]) -> DataFrame:
    """n and quartiles of each measure, from frames of (measure, value)."""
    found = quantiles(reduce(DataFrame.unionByName, measures), "measure", "value", QUARTILES)
    flat = found.select("measure", *[F.col(c).cast("double").alias(c) for c in ("n", *QUARTILES)]).unpivot(["measure"], ["n", *QUARTILES], "of", "value")
    return flat.select(F.lit(section).alias("section"), F.concat_ws(".", "measure", "of").alias("name"), "value")


def _measure(rows: DataFrame, name: str, value: Column | str) -> DataFrame:
    return rows.select(F.lit(name).alias("measure"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"))


def pair_coverage(per: DataFrame) -> DataFrame:
    """Per target and responder, both identified and different: trials, animals, amplitude, t, and the variance within
    and between animals (one-way random effects; null without two animals and a repeat), from sums by animal."""
    seen = per.filter("amplitude is not null and not is_target and neuron_id <> target_neuron_id")
    by = seen.groupBy(F.col("target_neuron_id").alias("target"), F.col("neuron_id").alias("responder"), "animal_id").agg(F.count("*").alias("n"), F.avg("amplitude").alias("m"), F.var_pop("amplitude").alias("v"))
    n, k, total = F.sum("n"), F.count("*"), F.sum(F.col("n") * F.col("m"))
    x = by.groupBy("target", "responder").agg(n.alias("n_trials"), k.alias("n_animals"), (total / n).alias("mean_amplitude"), F.stddev_samp("m").alias("between_animal_sd_of_means"), F.sum(F.col("n") * F.col("v")).alias("__w"), F.greatest(F.sum(F.col("n") * F.col("m") * F.col("m")) - total * total / n, F.lit(0.0)).alias("__b"), F.sum(F.col("n") * F.col("n")).alias("__nn"))
    n, k = F.col("n_trials"), F.col("n_animals")
    sd = F.sqrt((F.col("__w") + F.col("__b")) / F.nullif(n - 1, F.lit(0)))
    x = x.withColumn("sd_amplitude", sd).withColumn("t_statistic", F.col("mean_amplitude") / F.nullif(F.col("sd_amplitude") / F.sqrt(n), F.lit(0.0)))
    within = F.when(k > 1, F.col("__w") / F.nullif(n - k, F.lit(0)))
    x = x.withColumn("within_animal_variance", within)
    size = (n - F.col("__nn") / n) / F.nullif(k - 1, F.lit(0))
    between = F.when(F.col("within_animal_variance").isNotNull(), F.greatest((F.col("__b") / F.nullif(k - 1, F.lit(0)) - F.col("within_animal_variance")) / size, F.lit(0.0)))
    return x.withColumn("between_animal_variance", between).drop("__w", "__b", "__nn")


def target_eligibility(tried: DataFrame, pairs: DataFrame, t: Thresholds) -> DataFrame:
    """Per identified target: animals, trials, responders, and whether it is eligible or why not.

    tried: trials with own_ok, whether the target's own trace is valid often enough.
    """
    own = tried.filter("target_neuron_id is not null").groupBy(F.col("target_neuron_id").alias("target")).agg(F.count_distinct("animal_id").alias("n_animals"), F.count_distinct(F.when(F.col("own_ok"), F.col("animal_id"))).alias("n_animals_valid_own"), F.count("*").alias("n_trials"))
    multi = F.col("n_animals") >= t.responder_animals
    near = pairs.groupBy("target").agg(F.count("*").alias("responders_any"), F.count_if(multi).alias("responders_multi_animal"), F.count_if(multi & (F.abs("t_statistic") >= t.pair_t)).alias("responsive_pairs"))
    x = own.join(near, "target", "left").fillna(0, ["responders_any", "responders_multi_animal", "responsive_pairs"])
    few = F.when(F.col("n_animals_valid_own") < t.target_animals, f"fewer than {t.target_animals} animals with a valid own trace")
    alone = F.when(F.col("responders_multi_animal") < t.target_responders, f"fewer than {t.target_responders} responders in {t.responder_animals} animals")
    return x.withColumn("exclusion_reasons", F.array_compact(F.array(few, alone))).withColumn("eligible", F.size("exclusion_reasons") == 0)


def fold_coverage(animals: DataFrame, held: DataFrame, t: Thresholds) -> DataFrame:
    """Per scheme and target: the outer folds that test it, and the inner folds of these that can both fit and validate
    it (animals of it on both sides). covered: each fold that tests it has such an inner fold.

    animals: animal_id of all; held: target and animal_id, distinct.
    """
    out = []
    for name, k, inner in t.schemes:
        outer = None if k else splits.leave_one_out(animals, "animal_id")
        folds = scratch(splits.nested(animals, "animal_id", k or 0, inner, t.seed, outer))
        x = held.join(folds, "animal_id")
        tested = x.filter("role = 'test'").groupBy("target", "outer").agg(F.count("*").alias("tests"))
        by = x.filter("role = 'train'").groupBy("target", "outer", "inner").agg(F.count("*").alias("n"))
        rest = F.sum("n").over(Window.partitionBy("target", "outer")) - F.col("n")
        usable = by.withColumn("ok", (rest > 0).cast("int")).groupBy("target", "outer").agg(F.sum("ok").alias("usable"))
        per = tested.join(usable, ["target", "outer"], "left").fillna(0, ["usable"]).groupBy("target").agg(F.count("*").alias("outer_test_folds"), F.sum("tests").alias("test_animals"), F.min("usable").alias("least_inner"), F.avg("usable").alias("mean_inner"))
        n = folds.agg(F.count_distinct("outer").alias("outer_folds"))
        out.append(per.crossJoin(F.broadcast(n)).select(F.lit(name).alias("scheme"), "*", (F.col("least_inner") >= 1).alias("covered")))  # n: one row
    return reduce(DataFrame.unionByName, out)


def drift(per: DataFrame, tried: DataFrame, t: Thresholds) -> DataFrame:
    """measure, n, mean, lo, hi: the mean over animals of each one's slope (of five trials or more) and its interval."""
    by = per.groupBy("trial_id").agg(F.max(F.when(F.col("is_target"), F.col("amplitude"))).alias("own"), F.avg(F.when(~F.col("is_target"), F.abs("amplitude"))).alias("others"), F.avg(F.when(F.col("f0") > 0, F.ln("f0"))).alias("f0"))
    x = tried.select("trial_id", "animal_id", "own_ok", F.col("stim_index_in_recording").cast("double").alias("i"), (F.col("stimulus_start_s") / 60).alias("minute")).join(by, "trial_id")
    points = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(a).alias("x"), b.alias("y")) for m, a, b in (("own_amplitude_by_index", "i", F.when(F.col("own_ok"), F.col("own"))), ("responder_amplitude_by_index", "i", F.col("others")), ("log_baseline_by_minute", "minute", F.col("f0")))]))
    rows = x.select("animal_id", points.alias("p")).select("animal_id", "p.*").filter("x is not null and y is not null")
    slopes = rows.groupBy("measure", "animal_id").agg(F.regr_slope("y", "x").alias("slope"), F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("width")).filter("n >= 5 and width > 0")
    return resample.intervals(slopes, ["measure"], "animal_id", "slope", t.draws, t.seed)


def kinetics(rows: DataFrame, tried: DataFrame, interval: float, t: Thresholds) -> tuple[list[DataFrame], DataFrame]:
    """Latency of the peak, time to half of it and from it to half, in seconds, of strong own traces, and how many there
    are and of how many the decay isn't seen. A trace needs 15 valid samples of its first 20."""
    own = rows.filter("is_target and dff_valid and offset >= 0 and pre_sd > 0").join(tried.filter("own_ok").select("trial_id"), "trial_id", "left_semi")
    enough = own.filter("offset < 20").groupBy("trial_id").count().filter("count >= 15").select("trial_id")
    shape = windows.peak_shape(own.join(enough, "trial_id", "left_semi"), ["trial_id", "pre_sd"], "offset", "dff")
    strong = scratch(shape.filter(F.col("peak") >= t.over_noise * F.col("pre_sd")))
    measures = [_measure(strong, n, F.col(c) * interval) for n, c in (("peak_latency_s", "latency"), ("time_to_half_peak_s", "half_rise"), ("half_decay_s", "half_decay"))]
    return measures, strong.agg(F.count("*").alias("strong"), F.count_if(F.col("half_decay").isNull()).alias("decay_not_seen"))


def audit(spark: SparkSession, folder: str, laid: str, t: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """pair_coverage, target_eligibility, fold_coverage, artifact, drift and facts of the import in folder, whose windows
    and samples were laid out below laid. Regions without a sample in a window have no trace there. Empty tables of trials or
    neurons give empty tables and counts of 0."""
    base = layout.analysis_tables(spark, folder)
    trials, neurons, animals = base["trials"], base["neurons"], base["animals"]
    interval = animals.select("volume_interval_s").first()[0]
    rows = scratch(layout.traces(spark, folder, laid))
    own = spark.read.parquet(f"{folder}/autoresponses").filter("time_rel_s >= 0").groupBy("trial_id").agg(F.avg(F.col("gcamp_valid").cast("double")).alias("own_valid"))
    tried = scratch(trials.join(own, "trial_id", "left").withColumn("own_ok", F.coalesce(F.col("own_valid") >= t.own_valid, F.lit(False))))
    per = scratch(windows.amplitude(rows, TRACE).join(tried.select("trial_id", "animal_id"), "trial_id"))
    pairs = scratch(pair_coverage(per))
    targets = scratch(target_eligibility(tried, pairs, t))
    eligible = targets.filter("eligible").select("target")
    held = tried.filter("own_ok").select(F.col("target_neuron_id").alias("target"), "animal_id").distinct().join(eligible, "target", "left_semi")
    folds = scratch(fold_coverage(animals.select("animal_id").distinct(), held, t))
    schemes = folds.groupBy("scheme").agg(F.count_if("covered").alias("covered"), F.max("outer_folds").alias("folds"))
    best = splits.best_scheme(schemes.withColumn("all", F.lit(1)), "all").select("scheme")
    go = targets.filter("eligible and responsive_pairs > 0").join(folds.filter("covered").join(F.broadcast(best), "scheme"), "target", "left_semi")  # best: one row
    raw = rows.filter("raw is not null and offset between -3 and 4")
    artifact = raw.groupBy("is_target", "offset").agg(F.count("*").alias("n"), F.avg("raw").alias("mean_dff"))
    last = F.lag("target_label").over(Window.partitionBy("recording_id").orderBy("stim_index_in_recording"))
    again = tried.select((last == F.col("target_label")).alias("again"))
    shapes, strong = kinetics(rows, tried, interval, t)
    share = F.col("between_animal_variance") / F.nullif(F.col("between_animal_variance") + F.col("within_animal_variance"), F.lit(0.0))
    facts = [
        _facts("counts", animals.agg(F.count_distinct("animal_id").alias("animals"), F.count("*").alias("recordings"), F.count_distinct("session_id").alias("sessions"))),
        _facts("counts", tried.agg(F.count("*").alias("trials"), F.count("target_neuron_id").alias("trials_with_identified_target"), F.count_distinct("target_neuron_id").alias("identified_targets"))),
        _facts("counts", neurons.agg(F.count("*").alias("rois"), F.count_if(F.col("label_status") != "name").alias("uncertain_rois"))),
        _tally("animals_by_genotype", animals, F.col("genotype")), _tally("trials_by_target_code", tried, F.col("target_code")), _tally("roi_label_status", neurons, F.col("label_status")),
        _tally("trial_flags", tried.select(F.explode("trial_qc_flags").alias("flag")), F.col("flag")),
        _facts("quality", tried.agg(F.count("own_valid").alias("own_traces"), F.count_if("own_ok").alias("own_traces_valid"))),
        _facts("quality", per.agg(F.count("*").alias("traces"), F.count_if(F.col("f0").isNull()).alias("without_baseline"), F.count_if(F.col("amplitude").isNull()).alias("without_amplitude"), F.count_if(F.col("is_target") & F.col("amplitude").isNotNull()).alias("own_with_amplitude"))),
        _facts("quality", rows.agg(F.count_if("dff_valid").alias("valid_samples"))),
        _facts("pairs", pairs.agg(F.count("*").alias("pairs"), *[F.count_if(F.col("n_animals") >= k).alias(f"in_{k}_animals") for k in (2, 3, 5)], F.count("within_animal_variance").alias("estimable"), F.avg("within_animal_variance").alias("pooled_within"), F.avg(F.when(F.col("within_animal_variance").isNotNull(), F.col("between_animal_variance"))).alias("pooled_between"))),
        *[_facts(f"pairs_by_{c}", pairs.agg(*[F.count_if(F.col(c).between(*ends)).alias(k) for k, ends in STRATA.items()])) for c in ("n_animals", "n_trials")],
        _facts("targets", targets.agg(F.count("*").alias("targets"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & (F.col("responsive_pairs") > 0)).alias("eligible_with_responsive_pair"))),
        _tally("exclusions", targets.select(F.explode("exclusion_reasons").alias("why")), F.col("why")),
        _facts("stimulus", again.agg(F.count_if("again").alias("same_target_as_before"))), _facts("kinetics", strong),
        _spread("spread", [_measure(tried, "inter_stimulus_s", "time_since_previous_s"), _measure(tried, "volumes_before_next", F.when(F.col("next_stim_frame").isNotNull(), F.least(F.col("next_stim_frame") - F.col("stim_frame"), F.lit(windows.POST)))), _measure(animals, "stimulations_per_recording", "n_stimulations"), _measure(animals, "recording_s", F.col("n_frames") * interval), _measure(targets, "responders_per_target", "responders_any"), _measure(targets, "multi_animal_responders_per_target", "responders_multi_animal"), _measure(pairs, "between_animal_share", share), *shapes]),
        schemes.select(F.lit("schemes").alias("section"), F.col("scheme").alias("name"), F.col("covered").cast("double").alias("value")),
        best.select(F.lit("chosen").alias("section"), F.col("scheme").alias("name"), F.lit(1.0).alias("value")),
        _facts("go", go.agg(F.count("*").alias("targets"))),
    ]
    return {"pair_coverage": pairs, "target_eligibility": targets, "fold_coverage": folds, "artifact": artifact, "drift": drift(per, tried, t), "facts": reduce(DataFrame.unionByName, facts)}


def write(tables: dict[str, DataFrame], out: str, source: str, t: Thresholds = Thresholds()) -> str:
    """Write each table once below out and return the report, whose cells name the table and key they were read from.

    Only facts and drift come to the driver: some rows per measure and category.
    """
    from .sources.cache import Cell, Report
    from .sources.integrity import write_once

    for name, df in tables.items():
        write_once(df, f"{out}/{name}")
    spark = tables["facts"].sparkSession
    report = Report("Data audit")
    found: dict[str, list] = {}
    for r in spark.read.parquet(f"{out}/facts").orderBy("section", "name").collect():
        found.setdefault(r["section"], []).append(r)
    for section, rows in found.items():
        report.table(section, ["name", "value"], [[Cell(r["name"], source, "facts", section), Cell(r["value"], source, "facts", f"{section}/{r['name']}")] for r in rows])
    moved = spark.read.parquet(f"{out}/drift").orderBy("measure").collect()
    report.table("drift", ["measure", "animals", "mean", "lo", "hi"], [[Cell(r[c], source, "drift", r["measure"]) for c in ("measure", "n", "mean", "lo", "hi")] for r in moved])
    report.table("thresholds", ["name", "value"], [[Cell(k, source, "thresholds"), Cell(str(v), source, "thresholds", k)] for k, v in asdict(t).items()])
    return report.text()
