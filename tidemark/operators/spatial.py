"""Spatial joins: grid lookups, regions, nearest rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import distance_to_ring_m, point_in_ring
from tidemark.operators.positions import HOUR_US


def cell_of(c: Column, origin: float, step: float, n: int) -> Column:
    """Index of the cell of a regular axis, clipped to its ends; truncation is taken toward zero."""
    return F.least(F.greatest(((c - origin) / step).cast("int"), F.lit(0)), F.lit(n - 1))


def corner_table(grid: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each cell (keys, iy, ix) with its values and those of the next column, the next row and both: one lookup then serves
    a bilinear interpolation. Every node is dealt to the four cells it is a corner of, which one aggregate puts together."""
    keys = keys or []
    corners = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]))
    dealt = grid.select(*keys, "iy", "ix", *values, corners.alias("_c"))
    pick = lambda v, dy, dx: F.max(F.when((F.col("_c.dy") == dy) & (F.col("_c.dx") == dx), F.col(v))).alias(f"{v}{dy}{dx}")
    out = dealt.groupBy(*keys, (F.col("iy") - F.col("_c.dy")).cast("int").alias("iy"), (F.col("ix") - F.col("_c.dx")).cast("int").alias("ix"))
    out = out.agg(F.count("*").alias("_n"), *[pick(v, dy, dx) for v in values for dy in (0, 1) for dx in (0, 1)])
    return out.filter("_n = 4").drop("_n")


def bilinear(points: DataFrame, grid: DataFrame, values: list[str], x0: float, y0: float, dx: float, dy: float, nx: int, ny: int) -> DataFrame:
    """points (x, y, ...) with each value interpolated between the four grid nodes around; beyond the grid its edge holds."""
    fx = F.least(F.greatest((F.col("x") - x0) / dx, F.lit(0.0)), F.lit(nx - 1.001))
    fy = F.least(F.greatest((F.col("y") - y0) / dy, F.lit(0.0)), F.lit(ny - 1.001))
    rows = points.withColumn("_fx", fx).withColumn("_fy", fy).withColumn("ix", F.floor("_fx").cast("int")).withColumn("iy", F.floor("_fy").cast("int"))
    joined = rows.join(corner_table(grid, values), ["iy", "ix"])
    a, b = F.col("_fx") - F.col("ix"), F.col("_fy") - F.col("iy")
    mixed = lambda v: (F.col(f"{v}00") * (1 - a) + F.col(f"{v}01") * a) * (1 - b) + (F.col(f"{v}10") * (1 - a) + F.col(f"{v}11") * a) * b
    return joined.select(*points.columns, *[mixed(v).alias(v) for v in values])


def resample(points: DataFrame, grid: DataFrame, values: list[str], x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, keys: list[str] | None = None) -> DataFrame:
    """Like `bilinear`, but the outermost cells' planes go on beyond the grid. keys: what points and grid share besides, as times."""
    keys = keys or []
    fx, fy = (F.col("x") - x0) / dx, (F.col("y") - y0) / dy
    edge = lambda f, n: F.least(F.greatest(F.floor(f), F.lit(0)), F.lit(n - 2)).cast("int")
    rows = points.withColumn("_fx", fx).withColumn("_fy", fy).withColumn("ix", edge(F.col("_fx"), nx)).withColumn("iy", edge(F.col("_fy"), ny))
    joined = rows.join(corner_table(grid, values, keys), [*keys, "iy", "ix"])
    a, b = F.col("_fx") - F.col("ix"), F.col("_fy") - F.col("iy")
    mixed = lambda v: (F.col(f"{v}00") * (1 - a) + F.col(f"{v}01") * a) * (1 - b) + (F.col(f"{v}10") * (1 - a) + F.col(f"{v}11") * a) * b
    return joined.select(*points.columns, *[mixed(v).alias(v) for v in values])


def time_bracket(points: DataFrame, t: str, t0: int, step: int, n: int) -> DataFrame:
    """k and share: the axis step at or before t and the part of the way to the next, clipped to the axis."""
    at = F.least(F.greatest((F.col(t) - t0) / step, F.lit(0.0)), F.lit(float(n - 1)))
    k = F.least(F.floor(at), F.lit(max(n - 2, 0))).cast("int")
    return points.withColumn("k", k).withColumn("share", at - k)


def in_region(ring: list[tuple[float, float]], buffer_km: float) -> Column:
    """Inside the ring or within buffer_km of its edge, in metres on either axis."""
    mid = sum(p[1] for p in ring) / len(ring)
    inside = point_in_ring(F.col("lon"), F.col("lat"), ring)
    return inside | (distance_to_ring_m(F.col("lon"), F.col("lat"), ring, mid) <= buffer_km * 1000) if buffer_km else inside


def prefilter(tracks: DataFrame, ring: list[tuple[float, float]], lo_us: int, hi_us: int, buffer_km: float = 25.0, margin_hours: float = 6.0) -> DataFrame:
    """(mmsi, track) of tracks with any fix in the buffered region during the widened window. A box test goes first, so
    the ring's arithmetic runs on few rows, and the filter comes before the only shuffle."""
    margin = int(margin_hours * HOUR_US)
    lons, lats = [p[0] for p in ring], [p[1] for p in ring]
    pad_lat = buffer_km / 111.32
    pad_lon = pad_lat / max(0.05, math.cos(math.radians(max(map(abs, lats)))))
    near = F.col("t_us").between(lo_us - margin, hi_us + margin) & F.col("lon").between(min(lons) - pad_lon, max(lons) + pad_lon) & F.col("lat").between(min(lats) - pad_lat, max(lats) + pad_lat)
    return tracks.filter(near).filter(in_region(ring, buffer_km)).select("mmsi", "track").distinct()


def unexplained(samples: DataFrame, positions: DataFrame, radius_deg: float) -> DataFrame:
    """Samples (sample, t_us, lon, lat) that no position (t_us, lon, lat) at the same time is near, in a box of radius_deg.

    Rows meet on the time and on cells as wide as the radius, so only neighbours are compared.
    """
    cell = lambda c: F.floor(F.col(c) / radius_deg)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    held = positions.select("t_us", F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.explode(around).alias("o"))
    held = held.select("t_us", "plon", "plat", (F.floor(F.col("plon") / radius_deg) + F.col("o.i")).alias("cx"), (F.floor(F.col("plat") / radius_deg) + F.col("o.j")).alias("cy"))
    asked = samples.withColumn("cx", cell("lon")).withColumn("cy", cell("lat"))
    near = (F.abs(F.col("lon") - F.col("plon")) < radius_deg) & (F.abs(F.col("lat") - F.col("plat")) < radius_deg)
    keys = (asked["t_us"] == held["t_us"]) & (asked["cx"] == held["cx"]) & (asked["cy"] == held["cy"])
    return asked.join(held, keys & near, "left_anti").drop("cx", "cy")


def nearest(points: DataFrame, targets: DataFrame, cutoff_deg: float = 0.35, lon_scale: float = 0.6) -> DataFrame:
    """points (point, lon, lat) with the nearest target (target, lon, lat) within cutoff_deg, distances with longitudes
    scaled; the smallest target key settles ties. Points without one keep nulls. Rows meet on cells as wide as the cutoff."""
    width = cutoff_deg / lon_scale
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    held = targets.select("target", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"), F.explode(around).alias("o"))
    held = held.select("target", "tlon", "tlat", (F.floor(F.col("tlon") / width) + F.col("o.i")).alias("cx"), (F.floor(F.col("tlat") / cutoff_deg) + F.col("o.j")).alias("cy"))
    asked = points.withColumn("cx", F.floor(F.col("lon") / width)).withColumn("cy", F.floor(F.col("lat") / cutoff_deg))
    d = F.sqrt(F.pow((F.col("lon") - F.col("tlon")) * lon_scale, 2) + F.pow(F.col("lat") - F.col("tlat"), 2))
    met = asked.join(held, ["cx", "cy"]).withColumn("d", d).filter(F.col("d") <= cutoff_deg)
    best = met.groupBy("point").agg(F.min_by(F.struct("target", "d"), F.struct("d", "target")).alias("b"))
    return points.join(best.select("point", F.col("b.target").alias("target"), F.col("b.d").alias("distance")), "point", "left")
