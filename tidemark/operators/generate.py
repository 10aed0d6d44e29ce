"""Deterministic generators of currents, winds, coasts, scenes and identifiers, as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geo import EARTH_RADIUS_M
from tidemark.functions.rng import hash_normal, hash_uniform

KM_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180 / 1000


@dataclass(frozen=True)
class Box:
    min_lon: float = 10.2
    max_lon: float = 12.8
    min_lat: float = 56.4
    max_lat: float = 58.1

    def at(self, lon_share: float, lat_share: float) -> tuple[float, float]:
        return self.min_lon + lon_share * (self.max_lon - self.min_lon), self.min_lat + lat_share * (self.max_lat - self.min_lat)


#: The defaults of currents, winds, coast and scene.
@dataclass(frozen=True)
class CurrentParams:
    background_u: float = 0.14
    background_v: float = 0.06
    shear_per_100km: float = 0.45
    eddy_at: tuple[float, float] = (0.35, 0.55)
    eddy_km: float = 28.0
    eddy_ms: float = 0.22
    jet_lat_share: float = 0.45
    jet_km: float = 18.0
    jet_ms: float = 0.35
    tide_ms: float = 0.18
    tide_hours: float = 12.4206
    tide_ellipticity: float = 0.45


@dataclass(frozen=True)
class WindParams:
    speed_ms: float = 6.8
    from_deg: float = 235.0
    turn_deg_per_day: float = 18.0
    calm_at: tuple[float, float] = (0.72, 0.78)
    calm_km: float = 35.0
    calm_ms: float = 1.3


def km_offsets(lon: Column, lat: Column, at: tuple[float, float]) -> tuple[Column, Column]:
    """Kilometres east and north of a point, equirectangular at its latitude."""
    return (lon - at[0]) * (KM_PER_DEGREE * math.cos(math.radians(at[1]))), (lat - at[1]) * KM_PER_DEGREE


def km_to_degrees(dx_km: Column, dy_km: Column, lat: float) -> tuple[Column, Column]:
    return dx_km / (KM_PER_DEGREE * math.cos(math.radians(lat))), dy_km / KM_PER_DEGREE


def grid(spark: SparkSession, box: Box, step: float) -> DataFrame:
    """(iy, ix, lon, lat) of a regular axis pair."""
    nx, ny = int(math.floor((box.max_lon - box.min_lon) / step + 1e-9)) + 1, int(math.floor((box.max_lat - box.min_lat) / step + 1e-9)) + 1
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    return cells.select("iy", "ix", (box.min_lon + F.col("ix") * step).alias("lon"), (box.min_lat + F.col("iy") * step).alias("lat"))


def time_axis(spark: SparkSession, start_us: int, end_us: int, step_hours: int = 1) -> DataFrame:
    """(it, t_us): steps over the span with one more on either side."""
    step = step_hours * 3_600_000_000
    first, last = start_us - step, end_us + step
    return spark.range((last - first) // step + 1).select(F.col("id").cast("int").alias("it"), (F.lit(first) + F.col("id") * step).alias("t_us"))


def current(lon: Column, lat: Column, hours: Column, box: Box = Box(), p: CurrentParams = CurrentParams()) -> tuple[Column, Column]:
    """Sheared background, an eddy, a zonal jet and a turning tide."""
    centre = box.at(0.5, 0.5)
    _, dy = km_offsets(lon, lat, centre)
    ex, ey = km_offsets(lon, lat, box.at(*p.eddy_at))
    decay = F.exp(-(ex * ex + ey * ey) / (2 * p.eddy_km**2))
    _, jy = km_offsets(lon, lat, (centre[0], box.at(0, p.jet_lat_share)[1]))
    omega = 2 * math.pi / p.tide_hours
    u = p.background_u * (1 + p.shear_per_100km * dy / 100) - p.eddy_ms * (ey / p.eddy_km) * decay + p.jet_ms * F.exp(-F.pow(jy / p.jet_km, 2)) + p.tide_ms * F.cos(omega * hours)
    v = p.background_v + p.eddy_ms * (ex / p.eddy_km) * decay + p.tide_ms * p.tide_ellipticity * F.sin(omega * hours)
    return u, v


def wind(lon: Column, lat: Column, hours: Column, box: Box = Box(), p: WindParams = WindParams()) -> tuple[Column, Column]:
    """Wind components toward which it blows: a base speed with a calm pocket and a gradient, turning with time."""
    cx, cy = km_offsets(lon, lat, box.at(*p.calm_at))
    _, dy = km_offsets(lon, lat, box.at(0.5, 0.5))
    speed = p.speed_ms - (p.speed_ms - p.calm_ms) * F.exp(-(cx * cx + cy * cy) / (2 * p.calm_km**2))
    speed = F.greatest(speed * (1 + 0.05 * dy / 100), F.lit(0.2))
    theta = F.radians(p.from_deg + p.turn_deg_per_day * hours / 24)
    return -speed * F.sin(theta), -speed * F.cos(theta)


def is_land(lon: Column, lat: Column, box: Box = Box(), coast: float = 0.88, wiggle: float = 0.045, cycles: float = 3.0) -> Column:
    """North of a wavy coast."""
    share = (lon - box.min_lon) / (box.max_lon - box.min_lon)
    return lat > box.min_lat + (box.max_lat - box.min_lat) * (coast + wiggle * F.sin(2 * math.pi * cycles * share))


def backscatter_db(wind_ms: Column, incidence_deg: Column, land: Column) -> Column:
    """Clean radar backscatter: rises with the wind, falls with incidence; constant on land."""
    return F.when(land, F.lit(-7.5)).otherwise(-21.0 + 8.0 * F.log10(F.greatest(wind_ms, F.lit(0.4))) - 0.2 * (incidence_deg - 35.0))


def speckle(seed: int, looks: int, *keys: Column) -> Column:
    """Multiplicative noise of mean 1: a Gamma of integer shape as the mean of exponentials."""
    total = F.lit(0.0)
    for k in range(looks):
        total = total - F.log(hash_uniform(seed, k, *keys))
    return total / looks


def damping_db(density: Column) -> Column:
    """Added decibels of oil, saturating at nine."""
    return -9.0 * (1 - F.exp(-density / 1.2e-4))


def synthetic_id(index: Column) -> Column:
    return F.lpad(index.cast("string"), 9, "0")


def may_be_real(mmsi: Column) -> Column:
    """Whether a nine-digit identifier has a prefix that real ones use (201 to 775)."""
    return mmsi.rlike("^[0-9]{9}$") & F.substring(mmsi, 1, 3).try_cast("int").between(201, 775)


def traffic(spark: SparkSession, vessels: int, hours: int, seed: int = 1, box: Box = Box(), step_s: int = 120) -> DataFrame:
    """A position log of vessels on straight lanes with noise, loitering and benign silences; partition-independent."""
    u = lambda stream: hash_uniform(seed, stream, F.col("vessel"))
    kinds = ["Cargo", "Tanker", "Bulk Carrier", "Fishing", "Passenger", "Tug"]
    limits = [0.38, 0.58, 0.72, 0.86, 0.95]  # cumulative shares of the kinds
    kind = F.lit(kinds[-1])
    for name, limit in reversed(list(zip(kinds, limits, strict=False))):
        kind = F.when(u(0) < limit, name).otherwise(kind)
    lon0, lat0 = box.min_lon + u(1) * (box.max_lon - box.min_lon), box.min_lat + u(2) * (box.max_lat - box.min_lat) * 0.8
    base = spark.range(vessels).select(F.col("id").alias("vessel")).select(
        "vessel", synthetic_id(F.col("vessel")).alias("mmsi"), kind.alias("ship_type"), lon0.alias("lon0"), lat0.alias("lat0"), (u(3) * 360).alias("course"), (6 + u(4) * 12).alias("kn"),
        (u(5) * hours * 3600).alias("start_s"), (u(6) * 8 * 3600 + 3600).alias("length_s"), (u(7) < 0.3).alias("silent"), (u(8) < 0.15).alias("loiters"),
    )
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("length_s") / step_s).cast("int"))).alias("k"))
    along_s = F.col("k") * step_s
    share = along_s / F.col("length_s")
    rows = rows.filter(~(F.col("silent") & share.between(0.4, 0.55)))
    run = F.when(F.col("loiters") & (share > 0.5), 0.5 * F.col("length_s") + 0.1 * (along_s - 0.5 * F.col("length_s"))).otherwise(along_s)
    km = run * F.col("kn") * 0.514444 / 1000
    dx, dy = km_to_degrees(km * F.sin(F.radians("course")), km * F.cos(F.radians("course")), 57.0)
    noise = lambda stream: 0.0003 * hash_normal(seed, stream, F.col("vessel"), F.col("k"))
    t = (F.lit(1_704_067_200_000_000) + ((F.col("start_s") + along_s) * 1e6).cast("long")).cast("long")
    return rows.select(
        (F.col("vessel") * 100_000 + F.col("k")).alias("ord"), "mmsi", t.alias("t_us"), (F.col("lon0") + dx + noise(20)).alias("lon"), (F.col("lat0") + dy + noise(21)).alias("lat"),
        F.col("kn").alias("sog_kn"), F.col("course").alias("cog_deg"), "ship_type",
    )
