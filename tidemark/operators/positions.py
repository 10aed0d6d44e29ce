"""Position logs: cleaning, deduplication, speed filter, sessionisation and gaps.

A log has mmsi (string), t_us (microseconds UTC), lon, lat, sog_kn, cog_deg, ship_type and ord, a unique order key that
settles ties. Every step is a window over one vessel's rows, so a plan shuffles once, on mmsi, and later windows on
(mmsi, track) reuse that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import KNOT_MS, haversine_m

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class CleaningParams:
    max_speed_kn: float = 40.0
    split_gap_hours: float = 6.0
    gap_threshold_hours: float = 0.5
    least_fixes: int = 3
    sane_drop_fraction: float = 0.5


def valid_coordinate() -> Column:
    return F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)


def dedupe_keep_first(log: DataFrame) -> DataFrame:
    """The first row, by ord, of each vessel and time."""
    order = Window.partitionBy("mmsi", "t_us").orderBy("ord")
    return log.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def implied_speed(log: DataFrame) -> DataFrame:
    """implied_kn: speed from the vessel's previous row, whether that is kept or not; null on the first one."""
    order = Window.partitionBy("mmsi").orderBy("t_us", "ord")
    before = lambda c: F.lag(c).over(order)
    seconds = (F.col("t_us") - before("t_us")) / 1e6
    metres = haversine_m(before("lon"), before("lat"), F.col("lon"), F.col("lat"))
    return log.withColumn("implied_kn", F.when(seconds > 0, metres / F.greatest(seconds, F.lit(1e-9)) / KNOT_MS).when(seconds.isNotNull(), 0.0))


def drop_speed_jumps(log: DataFrame, max_kn: float) -> DataFrame:
    return implied_speed(log).filter(F.coalesce("implied_kn", F.lit(0.0)) <= max_kn).drop("implied_kn")


def sessionise(log: DataFrame, split_hours: float) -> DataFrame:
    """track: number of a vessel's run of rows without a silence longer than split_hours, from 0."""
    order = Window.partitionBy("mmsi").orderBy("t_us", "ord")
    opens = F.when(F.col("t_us") - F.lag("t_us").over(order) > int(split_hours * HOUR_US), 1).otherwise(0)
    return log.withColumn("_opens", opens).withColumn("track", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def without(log: DataFrame, vessels: DataFrame) -> DataFrame:
    """log without the rows of vessels (mmsi), as where a trial hides the true source."""
    return log.join(vessels.select("mmsi"), "mmsi", "left_anti")


def at_least(log: DataFrame, keys: list[str], rows: int) -> DataFrame:
    return log.withColumn("_rows", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_rows") >= rows).drop("_rows")


def reconstruct(log: DataFrame, params: CleaningParams = CleaningParams()) -> DataFrame:
    """Cleaned rows of all tracks."""
    kept = drop_speed_jumps(dedupe_keep_first(log.filter(valid_coordinate())), params.max_speed_kn)
    kept = at_least(kept, ["mmsi"], params.least_fixes)
    return at_least(sessionise(kept, params.split_gap_hours), ["mmsi", "track"], params.least_fixes)


def gaps(tracks: DataFrame, threshold_hours: float) -> DataFrame:
    """(mmsi, track, gap_start, gap_end): silences longer than threshold_hours inside a track."""
    order = Window.partitionBy("mmsi", "track").orderBy("t_us", "ord")
    rows = tracks.select("mmsi", "track", F.lag("t_us").over(order).alias("gap_start"), F.col("t_us").alias("gap_end"))
    return rows.filter(F.col("gap_end") - F.col("gap_start") > int(threshold_hours * HOUR_US))


def track_summary(tracks: DataFrame, threshold_hours: float) -> DataFrame:
    """One row a track: span, fixes, median speed and its silences."""
    order = Window.partitionBy("mmsi", "track").orderBy("t_us", "ord")
    silence = F.col("t_us") - F.lag("t_us").over(order)
    silence = F.when(silence > int(threshold_hours * HOUR_US), silence)
    rows = tracks.withColumn("_gap", silence)
    return rows.groupBy("mmsi", "track").agg(
        F.min("t_us").alias("t_start"), F.max("t_us").alias("t_end"), F.count("*").alias("n_fixes"), F.median("sog_kn").alias("transit_kn"),
        F.count("_gap").alias("n_gaps"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("gap_us"), F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap_us"),
    )


def baseline_gap(tracks: DataFrame, threshold_hours: float) -> DataFrame:
    """baseline_us: median over tracks of the longest silence; 0 without tracks."""
    return track_summary(tracks, threshold_hours).agg(F.coalesce(F.median("longest_gap_us"), F.lit(0.0)).alias("baseline_us"))


def cleaning_report(log: DataFrame, params: CleaningParams = CleaningParams()) -> DataFrame:
    """One row of counts: what each step dropped, and what is left. All steps flag rows of one pass over the log."""
    rows = log.withColumn("_valid", valid_coordinate()).withColumn("_nth", F.when(F.col("_valid"), F.row_number().over(Window.partitionBy("_valid", "mmsi", "t_us").orderBy("ord"))))
    kept = implied_speed(rows.filter("_nth = 1"))
    kept = kept.withColumn("_jump", F.coalesce("implied_kn", F.lit(0.0)) > params.max_speed_kn)
    coarse = rows.agg(F.count("*").alias("rows_in"), F.count_if(~F.col("_valid")).alias("dropped_bad_position"), F.count_if(F.col("_nth") > 1).alias("dropped_duplicate"))
    jumps = kept.agg(F.count_if("_jump").alias("dropped_speed_jump"))
    slow = at_least(kept.filter(~F.col("_jump")), ["mmsi"], params.least_fixes)
    split = sessionise(slow, params.split_gap_hours)
    splits = split.groupBy("mmsi").agg((F.countDistinct("track") - 1).alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("tracks_split_on_gap"))
    out = at_least(split, ["mmsi", "track"], params.least_fixes)
    left = out.agg(F.count("*").alias("rows_out"), F.countDistinct("mmsi", "track").alias("tracks_out"), F.countDistinct("mmsi").alias("vessels_out"))
    return coarse.crossJoin(jumps).crossJoin(splits).crossJoin(left)  # one row each


def assert_sane(report: DataFrame, params: CleaningParams = CleaningParams()) -> DataFrame:
    """The report, or an error when it runs if the speed filter dropped more than the sane share of rows."""
    share = F.try_divide("dropped_speed_jump", "rows_in")
    return report.filter(F.when(share > params.sane_drop_fraction, F.raise_error(F.format_string("speed filter dropped %d of %d rows; check the time unit", "dropped_speed_jump", "rows_in")).isNull()).otherwise(True))


def case_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("messages"), F.countDistinct("mmsi").alias("vessels"))
