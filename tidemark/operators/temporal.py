"""Time-series joins and window statistics over tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import turn_deg
from tidemark.operators.positions import HOUR_US


def asof_interpolate(tracks: DataFrame, probes: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Positions of tracks at probe times: (mmsi, track, probe_us, lon, lat[, in_gap]).

    Probes (mmsi, track, probe_us) and fixes run through one sort per track: the last fix at or before a probe and the first
    one at or after it come from running windows, so nothing is paired up. Beyond a track's ends its end point holds. in_gap
    is true strictly inside a gap.
    """
    fixes = tracks.select("mmsi", "track", "t_us", F.struct("t_us", "lon", "lat").alias("fix"), F.lit(None).cast("long").alias("probe_us"))
    asked = probes.select("mmsi", "track", F.col("probe_us").alias("t_us"), F.lit(None).cast(fixes.schema["fix"].dataType).alias("fix"), "probe_us")
    both = fixes.unionByName(asked)
    run = Window.partitionBy("mmsi", "track").orderBy("t_us")
    before = F.last("fix", ignorenulls=True).over(run.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("fix", ignorenulls=True).over(run.rangeBetween(0, Window.unboundedFollowing))
    rows = both.select("mmsi", "track", "probe_us", before.alias("a"), after.alias("b")).filter("probe_us is not null")
    rows = rows.withColumn("a", F.coalesce("a", "b")).withColumn("b", F.coalesce("b", "a")).filter("a is not null")
    share = F.when(F.col("b.t_us") > F.col("a.t_us"), (F.col("probe_us") - F.col("a.t_us")) / (F.col("b.t_us") - F.col("a.t_us"))).otherwise(0.0)
    lerp = lambda c: F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))
    out = rows.select("mmsi", "track", "probe_us", lerp("lon").alias("lon"), lerp("lat").alias("lat"))
    if gaps is None:
        return out
    inside = (F.col("probe_us") > F.col("gap_start")) & (F.col("probe_us") < F.col("gap_end"))
    marked = out.select("mmsi", "track", "probe_us").distinct().join(gaps, ["mmsi", "track"]).filter(inside).select("mmsi", "track", "probe_us", F.lit(True).alias("in_gap")).distinct()
    return out.join(marked, ["mmsi", "track", "probe_us"], "left").withColumn("in_gap", F.coalesce("in_gap", F.lit(False)))


def gap_overlap(gaps: DataFrame, windows: DataFrame) -> DataFrame:
    """(mmsi, track, w_from, w_to, gap_hours): silent hours inside each window (mmsi, track, w_from, w_to)."""
    shared = F.greatest(F.lit(0), F.least("gap_end", "w_to") - F.greatest("gap_start", "w_from"))
    joined = windows.join(gaps, ["mmsi", "track"], "left")
    return joined.groupBy("mmsi", "track", "w_from", "w_to").agg((F.coalesce(F.sum(shared), F.lit(0)) / HOUR_US).alias("gap_hours"))


def in_window(tracks: DataFrame, windows: DataFrame) -> DataFrame:
    """Fixes of each window's track inside it, ends included."""
    return tracks.join(windows, ["mmsi", "track"]).filter(F.col("t_us").between(F.col("w_from"), F.col("w_to")))


def window_speed(tracks: DataFrame, windows: DataFrame) -> DataFrame:
    """speed_kn: median speed of the fixes in each window; null without one."""
    found = in_window(tracks, windows).groupBy("mmsi", "track", "w_from", "w_to").agg(F.median("sog_kn").alias("speed_kn"))
    return windows.join(found, ["mmsi", "track", "w_from", "w_to"], "left")


def course_change(tracks: DataFrame, windows: DataFrame) -> DataFrame:
    """course_change_deg: largest departure of the unwrapped course steps in each window; 0 with fewer than three fixes."""
    order = Window.partitionBy("mmsi", "track", "w_from", "w_to").orderBy("t_us", "ord")
    step = turn_deg(F.col("cog_deg"), F.lag("cog_deg").over(order))
    rows = in_window(tracks, windows).withColumn("_step", step)
    found = rows.groupBy("mmsi", "track", "w_from", "w_to").agg(F.count("*").alias("_n"), F.max("_step").alias("_most"))
    out = windows.join(found, ["mmsi", "track", "w_from", "w_to"], "left")
    return out.withColumn("course_change_deg", F.when(F.col("_n") >= 3, F.col("_most")).otherwise(0.0)).drop("_n", "_most")


def heading_near(tracks: DataFrame, moments: DataFrame, window_hours: float = 1.0) -> DataFrame:
    """heading_deg: circular mean course within window_hours of each moment (mmsi, track, t_mid), else of the nearest fixes."""
    rows = moments.join(tracks, ["mmsi", "track"]).withColumn("_d", F.abs(F.col("t_us") - F.col("t_mid")))
    near = F.min("_d").over(Window.partitionBy("mmsi", "track", "t_mid"))
    rows = rows.withColumn("_limit", F.greatest(near, F.lit(int(window_hours * HOUR_US)))).filter("_d <= _limit")
    angle = F.radians("cog_deg")
    mean = F.pmod(F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))), F.lit(360.0))
    return rows.groupBy("mmsi", "track", "t_mid").agg(mean.alias("heading_deg"))


def release_bins(spans: DataFrame, hours: float) -> DataFrame:
    """Start times of windows of so many hours over (lo_us, hi_us): at least one, the last may reach beyond the end."""
    step = int(hours * HOUR_US)
    many = F.greatest(F.lit(1), F.ceil((F.col("hi_us") - F.col("lo_us")) / step))
    return spans.select("*", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)).alias("bin")).withColumn("w_from", F.col("lo_us") + F.col("bin") * step).withColumn("w_to", F.col("w_from") + step)
