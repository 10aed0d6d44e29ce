"""Evidence factors, the gate, text rules, and the Bayesian combination into ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import fold_angle

#: Prior weight of each ship type; others have 1.
TYPE_PRIOR = {"Tanker": 1.4, "Bulk Carrier": 1.2, "Cargo": 1.0, "Tug": 1.0, "Fishing": 0.9, "Passenger": 0.7}
#: Wording that no output may hold.
BANNED_TERMS = ("guilty", "culprit", "responsible for", "the polluter is", "identified the vessel", "confirmed spill by")

#: Bounds of the factors, the wind window, and the limits of class and release mode.
NEUTRAL, MAX_GAP, MAX_SPEED, MAX_COURSE, MAX_ALIGNMENT = 1.0, 3.0, 2.0, 1.5, 3.0
WIND_MIN, WIND_MAX = 3.0, 12.0
OIL_THRESHOLD = 0.5
CONTINUOUS_ELONGATION, CONTINUOUS_OFFSET, INSTANT_ELONGATION = 4.0, 15.0, 2.5


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def gap_factor(observed_hours: Column, baseline_hours: Column) -> Column:
    """Silence against the local baseline, never against an absolute threshold."""
    ratio = observed_hours / F.greatest(baseline_hours, F.lit(0.25))
    value = clip(1.0 + 0.6 * F.log1p(F.greatest(ratio - 1.0, F.lit(0.0))), NEUTRAL, MAX_GAP)
    return F.when(observed_hours <= 0, NEUTRAL).otherwise(value)


def gap_note(observed_hours: Column, baseline_hours: Column) -> Column:
    reference = F.greatest(baseline_hours, F.lit(0.25))
    high = gap_factor(observed_hours, baseline_hours) > NEUTRAL + 1e-9
    return (
        F.when(observed_hours <= 0, "no silence in the window")
        .when(high, F.format_string("%.1f h of silence against a local baseline of %.1f h", observed_hours, reference))
        .otherwise(F.format_string("%.1f h of silence, within the local baseline of %.1f h", observed_hours, reference))
    )


def speed_factor(window_kn: Column, transit_kn: Column) -> Column:
    """Slowing against the mover's own median speed."""
    ratio = F.try_divide(window_kn, transit_kn)
    unknown = window_kn.isNull() | transit_kn.isNull() | (transit_kn <= 0.5)
    return F.when(unknown | (ratio >= 0.75), NEUTRAL).otherwise(clip(1.0 + 1.4 * (0.75 - ratio), NEUTRAL, MAX_SPEED))


def speed_note(window_kn: Column, transit_kn: Column) -> Column:
    unknown = window_kn.isNull() | transit_kn.isNull() | (transit_kn <= 0.5)
    usual = F.format_string("%.1f kn, near the usual %.1f kn", window_kn, transit_kn)
    return F.when(unknown, "too few speeds in the window").when(window_kn / transit_kn >= 0.75, usual).otherwise(F.format_string("slowed to %.1f kn from the usual %.1f kn", window_kn, transit_kn))


def course_factor(change_deg: Column) -> Column:
    return F.when(change_deg < 20, NEUTRAL).otherwise(clip(1.0 + change_deg / 240.0, NEUTRAL, MAX_COURSE))


def course_note(change_deg: Column) -> Column:
    return F.when(change_deg < 20, "steady course").otherwise(F.format_string("course changed by %.0f degrees", change_deg))


def type_note(ship_type: Column, factor: Column) -> Column:
    return F.when(factor == NEUTRAL, F.concat(F.lower(ship_type), F.lit(": no weight either way"))).otherwise(F.concat(F.lower(ship_type), F.format_string(": weight %.1f", factor)))


def type_factor(rows: DataFrame, ship_type: str = "ship_type") -> DataFrame:
    """rows with type_factor, looked up in the fixed table (six rows, broadcast); 1 for other types."""
    table = rows.sparkSession.createDataFrame(list(TYPE_PRIOR.items()), "_type string, _prior double")
    out = rows.join(F.broadcast(table), F.col(ship_type) == F.col("_type"), "left")
    return out.withColumn("type_factor", F.coalesce("_prior", F.lit(1.0))).drop("_type", "_prior")


def alignment_factor(heading_deg: Column, axis_deg: Column, tolerance_deg: float = 25.0) -> Column:
    offset = fold_angle(heading_deg, axis_deg)
    near = clip(1.0 + (MAX_ALIGNMENT - 1.0) * F.exp(-F.pow(offset / tolerance_deg, 2)), NEUTRAL, MAX_ALIGNMENT)
    return F.when(offset > 3 * tolerance_deg, NEUTRAL).otherwise(near)


def alignment_note(heading_deg: Column, axis_deg: Column, tolerance_deg: float = 25.0) -> Column:
    offset = fold_angle(heading_deg, axis_deg)
    return F.when(offset > 3 * tolerance_deg, F.format_string("heading %.0f degrees off the axis, not aligned", offset)).otherwise(F.format_string("heading within %.0f degrees of the axis", offset))


def behavioural_prior(*factors: Column) -> Column:
    out = factors[0]
    for one in factors[1:]:
        out = out * one
    return out


def wind_gate(wind: Column) -> Column:
    """Why no judgement is possible at this wind, or null; the bounds themselves allow one."""
    return (
        F.when(wind < WIND_MIN, F.format_string("Wind %.1f m/s is below the %.0f m/s threshold. Outside detectability window.", wind, F.lit(WIND_MIN)))
        .when(wind > WIND_MAX, F.format_string("Wind %.1f m/s is above the %.0f m/s threshold. Outside detectability window.", wind, F.lit(WIND_MAX)))
    )


def oil_probability(damping: Column, gradient_ratio: Column, elongation: Column, wind_gradient: Column, solidity: Column) -> Column:
    """Rule-based classifier: five saturating terms through a logistic."""
    score = (
        1.2 * F.tanh(F.greatest(damping, F.lit(0.0)) / 0.35) + 0.9 * F.tanh(gradient_ratio - 1.0) + 0.6 * F.tanh((elongation - 2.0) / 2.0)
        - 1.1 * F.tanh(wind_gradient / 0.05) - 0.5 * F.tanh((solidity - 0.85) / 0.1)
    )
    return 1.0 / (1.0 + F.exp(-score))


def classify(wind: Column, probability: Column, threshold: float = OIL_THRESHOLD) -> Column:
    outside = (wind < WIND_MIN) | (wind > WIND_MAX)
    return F.when(outside, "undetermined").when(probability >= threshold, "oil").otherwise("look_alike")


def class_reason(kind: Column, wind: Column, damping: Column, gradient_ratio: Column, elongation: Column, solidity: Column) -> Column:
    """Why a patch has its class; the gate's own wording outside the wind window."""
    clear = F.format_string("Wind %.1f m/s allows a judgement; damping %.2f, edge ratio %.2f and elongation %.1f speak for oil.", wind, damping, gradient_ratio, elongation)
    vague = F.format_string("Wind %.1f m/s allows a judgement; edge ratio %.2f, solidity %.2f and elongation %.1f speak for another surface feature.", wind, gradient_ratio, solidity, elongation)
    return F.when(kind == "undetermined", wind_gate(wind)).when(kind == "oil", clear).otherwise(vague)


def release_mode(elongation: Column, offset_deg: Column, n_components: Column) -> Column:
    """offset_deg is null where no track is near."""
    return (
        F.when((elongation >= CONTINUOUS_ELONGATION) & (offset_deg <= CONTINUOUS_OFFSET), "continuous")
        .when((elongation < CONTINUOUS_ELONGATION) & (elongation <= INSTANT_ELONGATION) & (n_components == 1), "instantaneous")
        .otherwise("indeterminate")
    )


def has_banned_language(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for term in BANNED_TERMS:
        found = found | F.contains(low, F.lit(term))
    return found


def log_sum_exp(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """log of the sum of exp(value) by keys, shifted by the maximum; minus infinity where no value is finite. Two hash
    aggregates on the same keys, so one shuffle."""
    finite = F.when(F.col(value) > float("-inf"), F.col(value))
    top = rows.groupBy(*keys).agg(F.max(finite).alias("_top"))
    joined = rows.join(top, keys)
    total = F.sum(F.exp(finite - F.col("_top")))
    summed = joined.groupBy(*keys).agg(F.first("_top").alias("_top"), total.alias("_sum"))
    return summed.withColumn(out, F.when(F.col("_top").isNull(), F.lit(float("-inf"))).otherwise(F.col("_top") + F.log("_sum"))).drop("_top", "_sum")


def best_window(rows: DataFrame, keys: list[str], value: str, window: str) -> DataFrame:
    """The window of the largest value; the first one of equals."""
    return rows.groupBy(*keys).agg(F.max_by(window, F.struct(F.col(value), -F.col(window))).alias("best_window"))


def marginalise(rows: DataFrame, keys: list[str], value: str, windows: str) -> DataFrame:
    """log mean over windows of exp(value), and the best window."""
    summed = log_sum_exp(rows, keys, value, "_lse")
    count = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = summed.join(count, keys).join(best_window(rows, keys, value, windows), keys)
    return out.withColumn("log_marginal", F.col("_lse") - F.log("_n")).drop("_lse", "_n")


def combine(candidates: DataFrame, dark_log_marginal: float | str, dark_prior: float, keys: list[str] | None = None) -> DataFrame:
    """probability of each candidate (prior, log_marginal) beside a source that does not transmit, whose share comes as
    dark_probability on every row. dark_log_marginal is a number, or names the column that has it for each case. keys: cases that
    are combined apart.

    Sums come from one aggregate a case, joined back, so no task holds all candidates.
    """
    keys = keys or []
    base = candidates if keys else candidates.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    finite = F.when(F.col("log_marginal") > float("-inf"), F.col("log_marginal"))
    dark = F.col(dark_log_marginal) if isinstance(dark_log_marginal, str) else F.lit(float(dark_log_marginal))
    some = F.when(dark > float("-inf"), dark)
    tops = base.groupBy(*by).agg(F.greatest(F.max(finite), F.max(some)).alias("_shift"), F.sum("prior").alias("_prior_sum"))
    rows = base.join(tops, by)
    weight = F.coalesce((1 - dark_prior) * F.try_divide("prior", "_prior_sum") * F.exp(finite - F.col("_shift")), F.lit(0.0))
    rows = rows.withColumn("_w", weight).withColumn("_dark", F.coalesce(dark_prior * F.exp(some - F.col("_shift")), F.lit(0.0)))
    sums = rows.groupBy(*by).agg(F.sum("_w").alias("_vessels"))
    rows = rows.join(sums, by)
    total = F.col("_vessels") + F.col("_dark")
    rows = rows.withColumn("probability", F.coalesce(F.try_divide("_w", total), F.lit(0.0))).withColumn("dark_probability", F.coalesce(F.try_divide("_dark", total), F.lit(0.0)))
    return rows.drop("_all", "_shift", "_prior_sum", "_w", "_dark", "_vessels")


def rank(candidates: DataFrame, tie: list[str], keys: list[str] | None = None) -> DataFrame:
    """rank: 1 to n by probability, largest first; tie columns settle equals."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("probability"), *tie)))


def rebalance(ranked: DataFrame, drift: float = 1e-12, keys: list[str] | None = None) -> DataFrame:
    """Push what a case's probabilities and its dark_probability miss to a sum of 1 to its first rank, kept in 0 to 1; no change
    below the drift. keys: the columns that tell cases apart. Sums come from one aggregate a case, joined back."""
    base = ranked if keys else ranked.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    sums = base.groupBy(*by).agg((1.0 - F.max("dark_probability") - F.sum("probability")).alias("_missing"))
    moved = F.least(F.greatest(F.col("probability") + F.col("_missing"), F.lit(0.0)), F.lit(1.0))
    out = base.join(sums, by).withColumn("probability", F.when((F.col("rank") == 1) & (F.abs("_missing") >= drift), moved).otherwise(F.col("probability")))
    return out.select(*ranked.columns)


def traffic_reduction(candidates: DataFrame, reported: Column, prefiltered: Column) -> DataFrame:
    counts = candidates.agg(F.count("*").alias("in_window"), F.count_if(prefiltered).alias("prefiltered"), F.count_if(reported).alias("reported"))
    return counts.withColumn("reduction_factor", F.col("in_window") / F.greatest("reported", F.lit(1)))
