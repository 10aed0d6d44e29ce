"""The driver's tables in the shapes that the operators take: position logs, particles, cells, candidates and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rng import mixed_uniform
from tidemark.operators.positions import HOUR_US, CleaningParams

SHIP_TYPES = ("Tanker", "Bulk Carrier", "Cargo", "Tug", "Fishing", "Passenger")
#: Events lie about a day apart, so a day parts tracks and six hours make a silence.
PARAMS = CleaningParams(max_speed_kn=40.0, split_gap_hours=24.0, gap_threshold_hours=6.0)
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
RING = [(10.6, 56.6), (12.1, 56.5), (12.4, 57.4), (11.3, 57.9), (10.5, 57.3), (10.6, 56.6)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position log from events: duplicates, teleports and bad coordinates included."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kind = F.element_at(F.lit(list(SHIP_TYPES)), (F.col("user_id") % 6 + 1).cast("int"))
    return rows.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("00"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("mmsi"), (F.col("us") - F.col("us") % 600_000_000).alias("t_us"),
        (10.2 + (F.col("user_id") % 26) * 0.1 + F.when(F.col("event_id") % 97 == 0, 12).otherwise(0) + 0.0004 * ((F.col("us") - EPOCH_US) / 3.6e9)).alias("lon"),
        F.when(F.col("event_id") % 211 == 0, F.lit(95.0)).otherwise(56.4 + (F.col("user_id") % 17) * 0.1).alias("lat"),
        (F.col("value") / 10).alias("sog_kn"), ((F.col("event_id") * 37) % 360).cast("double").alias("cog_deg"), kind.alias("ship_type"),
    )


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles on a 40 x 30 grid: 32 hypotheses, some particles unusable."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return rows.select((F.col("l_suppkey") % 32).alias("hyp"), (F.col("l_partkey") % 40).alias("ix"), (F.col("l_orderkey") % 30).alias("iy"), (F.col("l_linenumber") % 7 != 0).alias("usable"))


def mask(spark: SparkSession) -> DataFrame:
    """Oil cells 10..19 x 8..15 with a ring of annulus cells around."""
    grid = spark.range(40).select(F.col("id").alias("ix")).crossJoin(spark.range(30).select(F.col("id").alias("iy")))
    oil = F.col("ix").between(10, 19) & F.col("iy").between(8, 15)
    ring = F.col("ix").between(9, 20) & F.col("iy").between(7, 16)
    return grid.withColumn("state", F.when(oil, "oil").when(ring, "annulus")).filter("state is not null")


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of movers by release window, from order lines by supplier and ship month."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.month("l_shipdate").alias("bin"))
    return rows.groupBy(F.col("l_suppkey").alias("mover"), "bin").agg((-F.sum("l_quantity") / 500.0).alias("ll"))


def posterior_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(it, iy, ix, weight) from orders: month, customer modulo 30 and 40, price."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.month("o_orderdate").alias("it"))
    return rows.select("it", (F.floor(F.col("o_custkey") / 40) % 30).alias("iy"), (F.col("o_custkey") % 40).alias("ix"), F.floor("o_totalprice").cast("long").alias("weight"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch features from parts."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return rows.select(
        F.col("p_partkey").alias("patch"), (size * 0.3).alias("wind"), ((price % 100) / 200).alias("damping"), (0.5 + size / 25).alias("gradient_ratio"),
        (1.0 + (F.col("p_partkey") % 60) / 10.0).alias("elongation"), ((F.col("p_partkey") % 13) / 100.0).alias("wind_gradient"), (0.7 + (F.col("p_partkey") % 30) / 100.0).alias("solidity"),
        F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") % 90).cast("double")).alias("offset_deg"), (F.col("p_partkey") % 3 + 1).cast("int").alias("n_components"),
    )


def raster(spark: SparkSession, rows: int = 60, cols: int = 80) -> DataFrame:
    """(row, col, value): an integer texture from a hash of the cell, with a dark blob in it."""
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.col("id"))
    blob = (F.pow(F.col("row") - 25, 2) + F.pow(F.col("col") - 40, 2)) < 120
    return grid.select("row", "col", (F.floor(mixed_uniform(F.col("id")) * 100) - F.when(blob, 60).otherwise(0)).cast("double").alias("value"))


POSITIONS_SQL = f"""
pos AS (
    SELECT event_id AS ord, '00' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS mmsi, us - us % 600000000 AS t_us,
           1.02e1 + (user_id % 26) * 1e-1 + (CASE WHEN event_id % 97 = 0 THEN 12 ELSE 0 END) + 4e-4 * ((us - {EPOCH_US}) / 3.6e9) AS lon,
           CASE WHEN event_id % 211 = 0 THEN 9.5e1 ELSE 5.64e1 + (user_id % 17) * 1e-1 END AS lat,
           value / 10 AS sog_kn, CAST((event_id * 37) % 360 AS DOUBLE) AS cog_deg,
           CASE user_id % 6 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Bulk Carrier' WHEN 2 THEN 'Cargo' WHEN 3 THEN 'Tug' WHEN 4 THEN 'Fishing' ELSE 'Passenger' END AS ship_type
    FROM (SELECT *, epoch_us(ts) AS us FROM events) e
)"""

HAVERSINE_SQL = "2 * 6371000e0 * asin(sqrt(least(greatest(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 0e0), 1e0)))"

_METRES = HAVERSINE_SQL.format(lat1="plat", lat2="lat", lon1="plon", lon2="lon")

TRACKS_SQL = f"""{POSITIONS_SQL},
ok AS (SELECT * FROM pos WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, t_us ORDER BY ord) AS nth FROM ok) x WHERE nth = 1),
lg AS (SELECT *, lag(t_us) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM dd WINDOW w AS (PARTITION BY mmsi ORDER BY t_us, ord)),
sp AS (SELECT *, CASE WHEN pt IS NULL THEN 0e0 WHEN t_us <= pt THEN 0e0 ELSE ({_METRES}) / greatest((t_us - pt) / 1e6, 1e-9) / 0.514444e0 END AS kn FROM lg),
jf AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mmsi) AS rows_v FROM sp WHERE kn <= 40) x WHERE rows_v >= 3),
br AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY mmsi ORDER BY t_us, ord) > {24 * HOUR_US} THEN 1 ELSE 0 END AS opens FROM jf),
sg AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY mmsi ORDER BY t_us, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS track FROM br),
tr AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mmsi, track) AS rows_t FROM sg) x WHERE rows_t >= 3),
st AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY mmsi, track ORDER BY t_us, ord) AS step_us, lag(t_us) OVER (PARTITION BY mmsi, track ORDER BY t_us, ord) AS prev_us FROM tr),
gp AS (SELECT mmsi, track, prev_us AS gap_start, t_us AS gap_end FROM st WHERE step_us > {6 * HOUR_US})"""

U_SQL = "CAST(xor(d0, d0 >> 13) AS DOUBLE) / 2147483648e0"
RASTER_SQL = f"""
ids AS (SELECT CAST(range AS BIGINT) AS id FROM range(4800)),
h1 AS (SELECT id, (id * 1103515245 + 12345) % 2147483648 AS a0 FROM ids),
h2 AS (SELECT id, (xor(a0, a0 >> 15) * 22695477 + 1) % 2147483648 AS d0 FROM h1),
ras AS (SELECT CAST(id // 80 AS INTEGER) AS row, CAST(id % 80 AS INTEGER) AS col,
        floor({U_SQL} * 100) - CASE WHEN pow(id // 80 - 25, 2) + pow(id % 80 - 40, 2) < 120 THEN 60 ELSE 0 END AS value FROM h2)"""
