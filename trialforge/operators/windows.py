"""Event-aligned trial windows and ordered-series operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import WHOLE, scan

#: Volumes before and after a stimulus, masked offsets, and what a usable baseline needs.
PRE, POST, MASKED, LEAST_BASE, LEAST_F0 = 10, 60, (-1, 0, 1), 4, 1e-6
#: Offsets of the response and the share of them that must be valid.
RESPONSE, LEAST_SHARE = (2, 30), 0.5
#: Frames that are dealt together: some windows long, so that few windows touch two.
BLOCK = 256


def schedule(stimuli: DataFrame, key: str = "recording_id", frame: str = "stim_frame", tie: str = "event_index") -> DataFrame:
    """stimuli with stim_index, trial_id, and the next and previous stimulus of the recording, in order (frame, tie)."""
    w = Window.partitionBy(key).orderBy(frame, tie)
    out = stimuli.withColumn("stim_index", F.row_number().over(w) - 1)
    out = out.withColumn("trial_id", F.format_string("%s:trial%03d", F.col(key).cast("string"), "stim_index"))
    return out.withColumns({
        "next_stim_frame": F.lead(frame).over(w), "previous_stim_frame": F.lag(frame).over(w), "previous_trial_id": F.lag("trial_id").over(w),
        "same_frame": F.count("*").over(Window.partitionBy(key, frame)),
    })


def align(trials: DataFrame, samples: DataFrame, key: str = "recording_id", pre: int = PRE, post: int = POST) -> DataFrame:
    """One row per trial and sample in its window, with offset, as an equi join on (recording, frame).

    A trial's window is exploded into its frames, so the interval join needs no range comparison. Frames from the next
    stimulus on are left out, unless they come before the trial's own.
    """
    frames = trials.withColumn("frame", F.explode(F.sequence(F.greatest(F.col("stim_frame") - pre, F.lit(0)), F.col("stim_frame") + post - 1)))
    kept = frames.filter(F.col("next_stim_frame").isNull() | (F.col("frame") < F.col("next_stim_frame")) | (F.col("frame") < F.col("stim_frame")))
    return kept.join(samples, [key, "frame"]).withColumn("offset", F.col("frame") - F.col("stim_frame"))


def between(trials: DataFrame, samples: DataFrame, first: str, past: str, key: str = "recording_id") -> DataFrame:
    """One row per trial and sample with first <= frame < past, again as an equi join."""
    frames = trials.filter(F.col(past) > F.col(first)).withColumn("frame", F.explode(F.sequence(F.col(first), F.col(past) - 1)))
    return frames.join(samples, [key, "frame"])


def in_blocks(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """samples with the number of their block of so many frames; null without a frame."""
    return samples.withColumn("block", F.floor(F.col("frame") / block).cast("int"))


def window_blocks(trials: DataFrame, pre: int = PRE, post: int = POST, block: int = BLOCK) -> DataFrame:
    """trials, once for each block of frames that their windows touch."""
    first, last = F.greatest(F.col("stim_frame") - pre, F.lit(0)), F.col("stim_frame") + post - 1
    at = lambda frame: F.floor(frame / block).cast("int")
    return trials.filter(last >= 0).withColumn("block", F.explode(F.sequence(at(first), at(last))))


def align_blocks(trials: DataFrame, samples: DataFrame, key: str = "recording_id", pre: int = PRE, post: int = POST) -> DataFrame:
    """As align, of window_blocks() and in_blocks(): an equi join on (recording, block), in which a sample meets only the
    windows that touch its block. Tables laid out by these two columns are merged where they lie."""
    offset = F.col("frame") - F.col("stim_frame")
    met = trials.hint("merge").join(samples, [key, "block"]).withColumn("offset", offset).drop("block")
    inside = F.col("offset").between(-pre, post - 1)
    return met.filter(inside & (F.col("next_stim_frame").isNull() | (F.col("frame") < F.col("next_stim_frame")) | (F.col("offset") < 0)))


def masked(offset: Column) -> Column:
    return offset.isin(*MASKED)


def with_baseline(windows: DataFrame, keys: list[str], value: str = "value", valid: str = "valid") -> DataFrame:
    """windows with f0 and pre_sd of their trace (see baseline), beside the rows in one pass: a trace has few rows, and sums
    over them in order of offset, so the last bit of f0 doesn't hang on how rows arrive."""
    w = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.when((F.col("offset") < 0) & F.col(valid) & ~masked(F.col("offset")), F.col(value))
    out = windows.withColumns({"__f": F.avg(x).over(w), "__s": F.stddev_pop(x).over(w), "__n": F.count(x).over(w)})
    good = (F.col("__n") >= LEAST_BASE) & (F.col("__f") > LEAST_F0)
    return out.withColumns({"f0": F.when(good, F.col("__f")), "pre_sd": F.when(good, F.col("__s") / F.col("__f"))}).drop("__f", "__s", "__n")


def baseline(windows: DataFrame, keys: list[str], value: str = "value", valid: str = "valid") -> DataFrame:
    """f0 and pre_sd (population, of dF/F) per trace, null where the baseline isn't usable, and n_base."""
    pre = (F.col("offset") < 0) & F.col(valid) & ~masked(F.col("offset"))
    x = F.when(pre, F.col(value))
    out = windows.groupBy(*keys).agg(F.avg(x).alias("f0"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n_base"))
    good = (F.col("n_base") >= LEAST_BASE) & (F.col("f0") > LEAST_F0)
    return out.select(*keys, "n_base", F.when(good, F.col("f0")).alias("f0"), F.when(good, F.col("sd") / F.col("f0")).alias("pre_sd"))


def dff(windows: DataFrame, keys: list[str], value: str = "value", valid: str = "valid") -> DataFrame:
    """windows with dF/F; 0 and not valid where masked, invalid or without a usable baseline."""
    out = with_baseline(windows, keys, value, valid)
    good = F.col(valid) & ~masked(F.col("offset")) & F.col("f0").isNotNull()
    return out.withColumns({"dff": F.when(good, F.try_divide(F.col(value) - F.col("f0"), F.col("f0"))).otherwise(0.0), "dff_valid": good})


def amplitude(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean dF/F over the response offsets where enough of them are valid, else null."""
    lo, hi = RESPONSE
    x = F.when(F.col("offset").between(lo, hi) & F.col("dff_valid"), F.col("dff"))
    return rows.groupBy(*keys).agg(F.when(F.count(x) >= LEAST_SHARE * (hi - lo + 1), F.avg(x)).alias("amplitude"), F.count(x).alias("n_response"))


def previous_valid(rows: DataFrame, keys: list[str], order: list[str], value: str, valid: str, short: bool = False) -> DataFrame:
    """rows with pos, prev_value and gap: the row's place, the latest valid sample before it, and how long ago that was: in
    steps of the order where it is one whole number, as frames are, else in rows. short: a series is a trace of few rows,
    for which one window does (and gap counts rows)."""
    if short:
        w = Window.partitionBy(*keys).orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        out, good = rows.withColumn("pos", F.row_number().over(w) - 1), F.col(valid)
        return out.withColumns({"prev_value": F.last(F.when(good, F.col(value)), True).over(before), "gap": F.col("pos") - F.last(F.when(good, F.col("pos")), True).over(before)})
    out = scan(rows, keys, order, sums={"pos": F.lit(1).cast("long")}, past={"__good": F.when(F.col(valid), F.struct(F.col(value).alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]))})
    if len(order) == 1 and dict(rows.dtypes)[order[0]] in WHOLE:
        return out.withColumns({"prev_value": F.col("__good.v"), "gap": F.col(order[0]) - F.col("__good.o0")}).drop("__good")
    out = scan(out.drop("__good"), keys, order, past={"__good": F.when(F.col(valid), F.struct(F.col(value).alias("v"), F.col("pos").alias("at")))})
    return out.withColumns({"prev_value": F.col("__good.v"), "gap": F.col("pos") - F.col("__good.at")}).drop("__good")


def fill_down(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """rows with filled: value, or the last one above that isn't null; filled_from_above says which."""
    out = scan(rows.withColumn("__own", value), keys, order, past={"__above": F.col("__own")})
    return out.withColumns({"filled": F.coalesce("__own", "__above"), "filled_from_above": F.col("__own").isNull()}).drop("__own", "__above")


def interpolate(rows: DataFrame, keys: list[str], order: str, value: str, valid: str) -> DataFrame:
    """rows with interp: linear between valid neighbours in order, the nearest valid value at the ends."""
    good = F.when(F.col(valid), F.struct(F.col(value).cast("double").alias("v"), F.col(order).alias("p")))
    out = scan(rows.withColumn("__own", good), keys, [order], past={"__a": F.col("__own")}, future={"__b": F.col("__own")})
    at = lambda side, f: F.coalesce(F.col("__own")[f], F.col(side)[f])
    line = at("__a", "v") + (at("__b", "v") - at("__a", "v")) * (F.col(order) - at("__a", "p")) / F.nullif(at("__b", "p") - at("__a", "p"), F.lit(0))
    return out.withColumn("interp", F.coalesce(line, at("__a", "v"), at("__b", "v"))).drop("__own", "__a", "__b")


def peak_shape(rows: DataFrame, keys: list[str], offset: str, value: str, search: int = 20) -> DataFrame:
    """peak, its latency among the first search offsets, first offset at half of it, and first one after at or under."""
    span = F.col(offset).between(0, search - 1)
    peak = rows.filter(span).groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(offset)).alias("o"))).alias("top"))
    peak = peak.select(*keys, F.col("top.v").alias("peak"), (-F.col("top.o")).alias("latency"))
    seen = rows.filter(F.col(offset) >= 0).join(peak, keys)
    rise = F.min(F.when((F.col(offset) <= F.col("latency")) & (F.col(value) >= 0.5 * F.col("peak")), F.col(offset)))
    decay = F.min(F.when((F.col(offset) > F.col("latency")) & (F.col(value) <= 0.5 * F.col("peak")), F.col(offset)))
    return seen.groupBy(*keys, "peak", "latency").agg(rise.alias("half_rise"), (decay - F.col("latency")).alias("half_decay"))


def convolve(series: DataFrame, keys: list[str], order: str, value: str, basis: DataFrame, lags: int) -> DataFrame:
    """keys, order, k, x: causal convolution of each series with each basis function (lag, k, weight), for every sample
    and function. Only samples that aren't 0 are spread over the lags; basis has at most lags rows a function."""
    used = series.filter(F.col(value) != 0).select(*keys, F.col(order).alias("__s"), F.col(value).alias("__u"))
    spread = used.crossJoin(F.broadcast(basis.filter(F.col("lag") < lags))).select(*keys, (F.col("__s") + F.col("lag")).alias(order), "k", (F.col("__u") * F.col("weight")).alias("__x"))
    sums = spread.groupBy(*keys, order, "k").agg(F.sum("__x").alias("__x"))
    grid = series.select(*keys, order).crossJoin(F.broadcast(basis.select("k").distinct()))
    return grid.join(sums, [*keys, order, "k"], "left").select(*keys, order, "k", F.coalesce("__x", F.lit(0.0)).alias("x"))


def tents(knots: tuple[int, ...], n: int) -> list[tuple[int, int, float]]:
    """(lag, k, weight): piecewise linear functions, each 1 at its knot and 0 at the others, over lags 0 to n - 1."""
    out = []
    for k, at in enumerate(knots):
        left = knots[k - 1] if k else None
        right = knots[k + 1] if k + 1 < len(knots) else None
        for t in range(n):
            if t == at:
                out.append((t, k, 1.0))
            elif left is not None and left < t < at:
                out.append((t, k, (t - left) / (at - left)))
            elif right is not None and at < t < right:
                out.append((t, k, (right - t) / (right - at)))
    return out
