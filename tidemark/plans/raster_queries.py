"""Queries over rasters, generators, transport, contracts, evaluation, sources and streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.rng import hash_normal, hash_uniform, mixed_uniform
from tidemark.operators import contracts as C
from tidemark.operators import evaluation as V
from tidemark.operators import generate as G
from tidemark.operators import raster as R
from tidemark.operators import slick as K
from tidemark.operators import transport as X
from tidemark.plans.tables import EPOCH_US, PARAMS, POSITIONS_SQL, RASTER_SQL, RING, TRACKS_SQL, U_SQL, mask, patches, positions, raster, table
from tidemark.plans.evidence_queries import PATCH_SQL, PROBABILITY_SQL, _probability

QUERIES, ORACLE_SQL = {}, {}
ROWS, COLS = 60, 80


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


DARK_SQL = "dk AS (SELECT row, col FROM ras WHERE value < 0)"
CROSS_SQL = "cx AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dr, dc))"


def dark(spark):
    return raster(spark).filter("value < 0").select("row", "col")


@query(f"WITH {RASTER_SQL}, {DARK_SQL}, {CROSS_SQL} SELECT DISTINCT CAST(row + dr AS INTEGER) AS row, CAST(col + dc AS INTEGER) AS col FROM dk, cx")
def dilate4(spark, sf_dir):
    return R.dilate(dark(spark))


@query(f"WITH {RASTER_SQL}, {DARK_SQL}, {CROSS_SQL} SELECT CAST(row + dr AS INTEGER) AS row, CAST(col + dc AS INTEGER) AS col FROM dk, cx GROUP BY 1, 2 HAVING count(*) = 5")
def erode4(spark, sf_dir):
    return R.erode(dark(spark))


@query(f"WITH {RASTER_SQL}, {DARK_SQL}, {CROSS_SQL}, g AS (SELECT DISTINCT row + dr AS row, col + dc AS col FROM dk, cx) SELECT count(*) AS perimeter FROM g WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.row = g.row AND dk.col = g.col)")
def perimeter(spark, sf_dir):
    return R.ring(dark(spark)).agg(F.count("*").alias("perimeter"))


_DISK = ", ".join(f"({r}, {c})" for r, c in R.disk(2))


@query(f"""WITH {RASTER_SQL}, {DARK_SQL}, ds AS (SELECT * FROM (VALUES {_DISK}) v(dr, dc)), er AS (SELECT row - dr AS row, col - dc AS col FROM dk, ds GROUP BY 1, 2 HAVING count(*) = {len(R.disk(2))})
    SELECT DISTINCT CAST(row + dr AS INTEGER) AS row, CAST(col + dc AS INTEGER) AS col FROM er, ds""")
def opening_disk(spark, sf_dir):
    return R.opening(dark(spark), R.disk(2))


@query(f"""WITH {RASTER_SQL}, t AS (SELECT a.row, a.col, avg(b.value) AS value FROM ras a CROSS JOIN (SELECT range - 4 AS k FROM range(9)) k1 CROSS JOIN (SELECT range - 4 AS j FROM range(9)) k2
    JOIN ras b ON b.row = least(greatest(a.row + k, 0), {ROWS - 1}) AND b.col = least(greatest(a.col + j, 0), {COLS - 1}) GROUP BY 1, 2) SELECT row, col, round(value, 6) AS value FROM t""")
def box_mean(spark, sf_dir):
    return R.box_mean(raster(spark), 4, ROWS, COLS).select("row", "col", F.round("value", 6).alias("value"))


def _gauss_sql(mode: str) -> str:
    kernel = R.gaussian_kernel(1.5)
    radius = len(kernel) // 2
    taps = ", ".join(f"({k - radius}, {w!r}::DOUBLE)" for k, w in enumerate(kernel))
    fold = (lambda x, n: f"least(greatest({x}, 0), {n - 1})") if mode == "nearest" else (lambda x, n: f"CASE WHEN (({x}) % {2 * n} + {2 * n}) % {2 * n} >= {n} THEN {2 * n - 1} - (({x}) % {2 * n} + {2 * n}) % {2 * n} ELSE (({x}) % {2 * n} + {2 * n}) % {2 * n} END")
    return f"""WITH {RASTER_SQL}, tp AS (SELECT * FROM (VALUES {taps}) v(k, w)), p1 AS (SELECT a.row, a.col, sum(w * b.value) AS v FROM ras a CROSS JOIN tp JOIN ras b ON b.col = a.col AND b.row = {fold("a.row + k", ROWS)} GROUP BY 1, 2),
    p2 AS (SELECT a.row, a.col, sum(w * b.v) AS v FROM p1 a CROSS JOIN tp JOIN p1 b ON b.row = a.row AND b.col = {fold("a.col + k", COLS)} GROUP BY 1, 2) SELECT row, col, round(v, 6) AS value FROM p2"""


@query(_gauss_sql("reflect"))
def gaussian_smooth(spark, sf_dir):
    return R.gaussian(raster(spark), 1.5, ROWS, COLS).select("row", "col", F.round("value", 6).alias("value"))


@query(_gauss_sql("nearest"))
def gaussian_nearest(spark, sf_dir):
    return R.gaussian(raster(spark), 1.5, ROWS, COLS, "nearest").select("row", "col", F.round("value", 6).alias("value"))


@query(f"""WITH {RASTER_SQL}, s AS (SELECT row, col, value, lead(value) OVER c AS e, lag(value) OVER c AS w, lead(value) OVER r AS n, lag(value) OVER r AS s FROM ras WINDOW c AS (PARTITION BY row ORDER BY col), r AS (PARTITION BY col ORDER BY row)),
    g AS (SELECT row, col, CASE WHEN e IS NULL THEN value - w WHEN w IS NULL THEN e - value ELSE (e - w) / 2 END AS gc, CASE WHEN n IS NULL THEN value - s WHEN s IS NULL THEN n - value ELSE (n - s) / 2 END AS gr FROM s)
    SELECT row, col, round(sqrt(gr * gr + gc * gc), 6) AS magnitude FROM g""")
def gradient(spark, sf_dir):
    return R.gradient(raster(spark)).select("row", "col", F.round("magnitude", 6).alias("magnitude"))


@query(f"""WITH {RASTER_SQL}, {DARK_SQL}, tr AS (SELECT row, col FROM ras WHERE pow(row - 25, 2) + pow(col - 40, 2) < 120) SELECT round(count(CASE WHEN d.row IS NOT NULL AND t.row IS NOT NULL THEN 1 END) / CAST(count(*) AS DOUBLE), 9) AS iou,
    round(count(CASE WHEN d.row IS NOT NULL AND t.row IS NOT NULL THEN 1 END) / CAST(count(t.row) AS DOUBLE), 9) AS recall FROM dk d FULL JOIN tr t ON d.row = t.row AND d.col = t.col""")
def iou_recall(spark, sf_dir):
    truth = raster(spark).filter((F.pow(F.col("row") - 25, 2) + F.pow(F.col("col") - 40, 2)) < 120)
    return R.overlap_scores(dark(spark), truth).select(F.round("iou", 9).alias("iou"), F.round("recall", 9).alias("recall"))


@query(f"""WITH {RASTER_SQL}, b AS (SELECT median(value) AS m FROM ras WHERE row < 54), k AS (SELECT r.row, r.col, r.value FROM ras r, b WHERE r.value <= m - 70) SELECT count(*) AS n_cells, round(avg(row), 6) AS centre_row, round(avg(col), 6) AS centre_col,
    round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS darkest, round((SELECT m FROM b) - avg(value), 6) AS damping FROM k""")
def patch_radiometry(spark, sf_dir):
    """Background median over sea cells, the cells darker by 70, and their radiometry as one patch."""
    base = raster(spark)
    background = base.filter("row < 54").agg(F.median("value").alias("m")).first()["m"]  # one scalar
    cells = base.filter(F.col("value") <= background - 70).select("row", "col", F.lit(0).alias("patch"))
    out = R.patch_summary(cells, base, background)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("n_cells", r("centre_row"), r("centre_col"), r("mean"), r("sd"), "darkest", r("damping"))


@query(f"""WITH RECURSIVE {RASTER_SQL}, {DARK_SQL}, nb AS (SELECT a.row * 2147483648 + a.col AS a, b.row * 2147483648 + b.col AS b FROM dk a JOIN dk b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
    re AS (SELECT DISTINCT a, a AS b FROM nb UNION SELECT re.a, nb.b FROM re JOIN nb ON re.b = nb.a), lb AS (SELECT a, min(b) AS patch FROM re GROUP BY 1)
    SELECT CAST(patch AS BIGINT) AS patch, count(*) AS n_cells FROM lb GROUP BY 1 HAVING count(*) >= 2""")
def connected_components(spark, sf_dir):
    return R.label_components(dark(spark), least=2).groupBy("patch").agg(F.count("*").alias("n_cells"))


@query()
def patch_shapes(spark, sf_dir):
    """Perimeter, complexity and hull solidity of each labelled patch."""
    labelled = R.label_components(dark(spark), least=4)
    return R.shape_features(labelled, 0.01).join(R.hull_solidity(labelled), "patch")


@query()
def region_outline(spark, sf_dir):
    """Rings around the connected parts of the dark region after closing."""
    cells = R.closing(dark(spark), R.disk(2))
    return R.outlines(cells)


@query(f"""WITH {RASTER_SQL}, {DARK_SQL} SELECT count(*) AS edges FROM (SELECT d.row, d.col, o.dr, o.dc FROM dk d, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dr, dc)
    WHERE NOT EXISTS (SELECT 1 FROM dk e WHERE e.row = d.row + o.dr AND e.col = d.col + o.dc)) z""")
def boundary_edges(spark, sf_dir):
    return R.region_edges(dark(spark)).agg(F.count("*").alias("edges"))


@query(f"WITH {TRACKS_SQL}, ct AS (SELECT CAST(floor(lon / 25e-2) AS BIGINT) AS cx, CAST(floor(lat / 25e-2) AS BIGINT) AS cy, count(*) AS n FROM tr GROUP BY 1, 2) SELECT cx, cy FROM ct WHERE n >= (SELECT quantile_cont(n, 7e-1) FROM ct)")
def busy_lanes(spark, sf_dir):
    from tidemark.plans.track_queries import tracks_of

    return R.lane_distance(tracks_of(spark, sf_dir), 0.25)[1]


def _offsets_sql(at: tuple[float, float]) -> tuple[str, str]:
    return f"((lon - {at[0]!r}::DOUBLE) * {G.KM_PER_DEGREE * math.cos(math.radians(at[1]))!r}::DOUBLE)", f"((lat - {at[1]!r}::DOUBLE) * {G.KM_PER_DEGREE!r}::DOUBLE)"


BOX, CUR, WND = G.Box(), G.CurrentParams(), G.WindParams()
_NX, _NY = 32, 21
GRID_SQL = f"""ax AS (SELECT CAST(range // {_NX} AS INTEGER) AS iy, CAST(range % {_NX} AS INTEGER) AS ix, {BOX.min_lon!r}::DOUBLE + (range % {_NX}) * {1 / 12!r}::DOUBLE AS lon, {BOX.min_lat!r}::DOUBLE + (range // {_NX}) * {1 / 12!r}::DOUBLE AS lat FROM range({_NX * _NY})),
gt AS (SELECT ax.*, CAST(t.range AS DOUBLE) AS hours FROM ax CROSS JOIN range(6) t)"""


def grid_hours(spark):
    cells = G.grid(spark, BOX, 1 / 12)
    return cells.crossJoin(F.broadcast(spark.range(6).select(F.col("id").cast("double").alias("hours"))))


def _current_sql() -> str:
    _, dy = _offsets_sql(BOX.at(0.5, 0.5))
    ex, ey = _offsets_sql(BOX.at(*CUR.eddy_at))
    _, jy = _offsets_sql((0.0, BOX.at(0, CUR.jet_lat_share)[1]))
    decay = f"exp(-({ex} * {ex} + {ey} * {ey}) / {2 * CUR.eddy_km**2!r}::DOUBLE)"
    omega = f"{2 * math.pi / CUR.tide_hours!r}::DOUBLE"
    u = f"14e-2 * (1 + 45e-2 * {dy} / 100) - 22e-2 * ({ey} / 28) * {decay} + 35e-2 * exp(-pow({jy} / 18, 2)) + 18e-2 * cos({omega} * hours)"
    v = f"6e-2 + 22e-2 * ({ex} / 28) * {decay} + {0.18 * 0.45!r}::DOUBLE * sin({omega} * hours)"
    return f"WITH {GRID_SQL} SELECT iy, ix, hours, round({u}, 6) AS u, round({v}, 6) AS v FROM gt"


@query(_current_sql())
def current_field(spark, sf_dir):
    u, v = G.current(F.col("lon"), F.col("lat"), F.col("hours"))
    return grid_hours(spark).select("iy", "ix", "hours", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


def _speed_sql() -> str:
    cx, cy = _offsets_sql(BOX.at(*WND.calm_at))
    _, dy = _offsets_sql(BOX.at(0.5, 0.5))
    return f"greatest((68e-1 - 55e-1 * exp(-({cx} * {cx} + {cy} * {cy}) / {2 * WND.calm_km**2!r}::DOUBLE)) * (1 + 5e-2 * {dy} / 100), 2e-1)"


@query(f"WITH {GRID_SQL}, s AS (SELECT *, {_speed_sql()} AS sp, radians(235 + 18 * hours / 24) AS th FROM gt) SELECT iy, ix, hours, round(-sp * sin(th), 6) AS u, round(-sp * cos(th), 6) AS v FROM s")
def wind_field(spark, sf_dir):
    u, v = G.wind(F.col("lon"), F.col("lat"), F.col("hours"))
    return grid_hours(spark).select("iy", "ix", "hours", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


_LAND = f"lat > {BOX.min_lat!r}::DOUBLE + {BOX.max_lat - BOX.min_lat!r}::DOUBLE * (88e-2 + 45e-3 * sin({2 * math.pi * 3!r}::DOUBLE * ((lon - {BOX.min_lon!r}::DOUBLE) / {BOX.max_lon - BOX.min_lon!r}::DOUBLE)))"


@query(f"WITH {GRID_SQL}, s AS (SELECT *, {_speed_sql()} AS sp FROM gt WHERE hours = 0) SELECT iy, ix, {_LAND} AS land, round(CASE WHEN {_LAND} THEN -75e-1 ELSE -21 + 8 * log10(greatest(sp, 4e-1)) - 2e-1 * (305e-1 + ix * 15e0 / {_NX - 1} - 35) END, 6) AS sigma0_db FROM s")
def sigma0_clean(spark, sf_dir):
    rows = grid_hours(spark).filter("hours = 0")
    u, v = G.wind(F.col("lon"), F.col("lat"), F.lit(0.0))
    land = G.is_land(F.col("lon"), F.col("lat"))
    db = G.backscatter_db(F.sqrt(u * u + v * v), 30.5 + F.col("ix") * 15.0 / (_NX - 1), land)
    return rows.select("iy", "ix", land.alias("land"), F.round(db, 6).alias("sigma0_db"))


@query("SELECT CAST(range AS BIGINT) AS id, lpad(CAST(range * 1000003 % 1000000000 AS VARCHAR), 9, '0') AS mmsi, CAST(substr(lpad(CAST(range * 1000003 % 1000000000 AS VARCHAR), 9, '0'), 1, 3) AS INTEGER) BETWEEN 201 AND 775 AS may_be_real FROM range(2000)")
def synthetic_ids(spark, sf_dir):
    rows = spark.range(2000).withColumn("mmsi", G.synthetic_id(F.col("id") * 1000003 % 1000000000))
    return rows.withColumn("may_be_real", G.may_be_real(F.col("mmsi")))


@query(f"""SELECT CAST(range AS INTEGER) AS it, {EPOCH_US} - 3600000000 + range * 3600000000 AS t_us FROM range(27)""")
def time_axis(spark, sf_dir):
    return G.time_axis(spark, EPOCH_US, EPOCH_US + 24 * 3_600_000_000)


@query(f"SELECT id, round({U_SQL}, 9) AS u FROM (SELECT id, (xor(a0, a0 >> 15) * 22695477 + 1) % 2147483648 AS d0 FROM (SELECT event_id AS id, (event_id * 1103515245 + 12345) % 2147483648 AS a0 FROM events) a) b")
def counter_uniform(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(mixed_uniform(F.col("event_id")), 9).alias("u"))


@query()
def synthetic_traffic(spark, sf_dir):
    """A generated position log through the whole cleaning slice: one row a track."""
    from tidemark.operators import positions as P

    log = G.traffic(spark, 60, 60)
    return P.track_summary(P.reconstruct(log), 0.5)


@query()
def speckled_scene(spark, sf_dir):
    """Backscatter with multiplicative noise: moments by incidence column."""
    rows = grid_hours(spark).filter("hours < 4")
    u, v = G.wind(F.col("lon"), F.col("lat"), F.lit(0.0))
    db = G.backscatter_db(F.sqrt(u * u + v * v), 30.5 + F.col("ix") * 15.0 / (_NX - 1), F.lit(False))
    noisy = 10 * F.log10(F.pow(F.lit(10.0), db / 10) * G.speckle(1, 4, F.col("iy"), F.col("ix"), F.col("hours")))
    return rows.select("ix", db.alias("clean"), noisy.alias("noisy")).groupBy("ix").agg(F.avg("clean").alias("clean_db"), F.avg("noisy").alias("noisy_db"), F.stddev_pop("noisy").alias("sd"))


@query()
def hash_draws(spark, sf_dir):
    """Moments of the counter-based uniform and normal draws over all order lines."""
    rows = table(spark, sf_dir, "lineitem").select(hash_uniform(1, 1, F.col("l_orderkey"), F.col("l_linenumber")).alias("u"), hash_normal(1, 2, F.col("l_orderkey"), F.col("l_linenumber")).alias("z"))
    return rows.agg(F.avg("u").alias("mean_u"), F.var_pop("u").alias("var_u"), F.avg("z").alias("mean_z"), F.var_pop("z").alias("var_z"))


def uniform_field(u=0.3, v=0.1, uw=5.0, vw=-2.0, n=60, cell=2000.0, hours=48, land=False) -> X.Field:
    full = lambda x: np.full((hours + 1, n, n), x)
    shore = np.zeros((n, n), bool)
    if land:
        shore[-6:] = True
    return X.Field(400_000.0, 6_200_000.0, cell, cell, 0.0, 3600.0, full(u), full(v), full(uw), full(vw), shore)


def _seeds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.select(F.col("o_orderkey").alias("particle_id"), (F.col("o_custkey") % 8).alias("origin"), (430_000.0 + (F.col("o_orderkey") % 40) * 1000).alias("x"), (6_230_000.0 + (F.col("o_custkey") % 50) * 1000).alias("y"), ((F.col("o_orderkey") % 6) * 3600.0).alias("seed_time"))


@query("""SELECT o_orderkey AS particle_id, CAST(1 AS TINYINT) AS status, round(430000 + (o_orderkey % 40) * 1000 + (3e-1 + 25e-3 * 5) * (43200 - CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE (o_orderkey % 6) * 3600 - 900 END), 3) AS x,
    round(6230000 + (o_custkey % 50) * 1000 + (1e-1 - 25e-3 * 2) * (43200 - CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE (o_orderkey % 6) * 3600 - 900 END), 3) AS y FROM orders""")
def transport_uniform(spark, sf_dir):
    """Twelve hours in a uniform field without diffusion and with fixed windage, which has a closed form: a particle moves
    from the step in which it is released."""
    out = X.simulate(_seeds(spark, sf_dir), uniform_field(), 0.0, 43_200.0, X.TransportParams(alpha=(0.025, 0.025), diffusion=False))
    return out.select("particle_id", "status", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query()
def transport_forward(spark, sf_dir):
    """Two days of advection, windage and diffusion toward a coast: outcomes by source."""
    out = X.simulate(_seeds(spark, sf_dir), uniform_field(u=0.1, v=0.25, land=True), 0.0, 172_800.0)
    return out.groupBy("origin", "status").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


@query()
def proposal_backward(spark, sf_dir):
    """A day backward without diffusion, and the hypothesis grid of where particles came from."""
    seeds = _seeds(spark, sf_dir).withColumn("seed_time", F.lit(86_400.0))
    back = X.simulate(seeds, uniform_field(), 86_400.0, 0.0, X.proposal())
    points = X.usable(back).select("x", "y", F.lit(0).alias("t0"))
    cells, _ = X.hypothesis_grid(points, 4000.0, 500)
    return cells


@query("SELECT CAST(1 AS TINYINT) AS status, count(*) AS n FROM orders")
def particle_outcomes(spark, sf_dir):
    return X.outcomes(X.simulate(_seeds(spark, sf_dir), uniform_field(), 0.0, 43_200.0, X.TransportParams(diffusion=False)))


@query("SELECT CAST(s_suppkey AS BIGINT) * 5 + k AS particle_id, s_suppkey AS origin, CAST(s_nationkey AS DOUBLE) AS seed_time FROM supplier CROSS JOIN (SELECT range AS k FROM range(5)) r")
def hypothesis_seeds(spark, sf_dir):
    grid = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hyp"), F.col("s_acctbal").alias("x"), F.col("s_acctbal").alias("y"), F.col("s_nationkey").alias("t0"))
    return X.hypothesis_seeds(grid, 5, 100.0).select("particle_id", "origin", "seed_time")


@query("SELECT s_suppkey AS mover, b AS bin, 4 AS n FROM supplier CROSS JOIN (SELECT range AS b FROM range(3)) r UNION ALL SELECT -1, range, 1 FROM range(8)")
def seed_union(spark, sf_dir):
    """Seeds of movers by window, with those of a source that does not transmit behind them, by what their origins stand for."""
    movers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mover"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    at = movers.crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("bin"), (F.col("id") * 7200.0).alias("w_from"))))
    dark_at = spark.range(8).select(F.lit(-1).cast("long").alias("mover"), F.col("id").alias("bin"), F.lit(0.0).alias("w_from"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    seeds = X.release_seeds(at, 4, 7200.0).unionByName(X.release_seeds(dark_at, 1, 7200.0))
    named = at.select("mover", "bin").unionByName(dark_at.select("mover", "bin")).withColumn("origin", X.release_origin(F.col("mover"), F.col("bin")))
    return seeds.join(named, "origin").groupBy("mover", "bin").agg(F.count("*").cast("int").alias("n"))


@query()
def mask_samples(spark, sf_dir):
    """Uniform points over the oil cells: how many each cell got."""
    return X.sample_cells(mask(spark).filter("state = 'oil'"), 4000).groupBy("ix", "iy").agg(F.count("*").alias("n"))


@query("""SELECT 'annulus_minus_oil' AS part, count(*) AS n FROM (SELECT x.range AS ix, y.range AS iy FROM range(40) x, range(30) y WHERE x.range BETWEEN 9 AND 20 AND y.range BETWEEN 7 AND 16 EXCEPT SELECT x.range, y.range FROM range(40) x, range(30) y WHERE x.range BETWEEN 10 AND 19 AND y.range BETWEEN 8 AND 15) a
    UNION ALL SELECT 'both', count(*) FROM (SELECT x.range AS ix, y.range AS iy FROM range(40) x, range(30) y WHERE x.range BETWEEN 10 AND 19 AND y.range BETWEEN 8 AND 15) b UNION ALL SELECT 'either', 120""")
def mask_set_algebra(spark, sf_dir):
    cells = mask(spark)
    outer, oil = cells.select("ix", "iy"), cells.filter("state = 'oil'").select("ix", "iy")
    parts = {"annulus_minus_oil": outer.join(oil, ["ix", "iy"], "left_anti"), "both": outer.intersect(oil), "either": outer.union(oil).distinct()}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {RASTER_SQL}, i AS (SELECT *, row_number() OVER (ORDER BY row, col) - 1 AS nth FROM ras) SELECT row, col FROM i WHERE nth % 7 = 0 UNION ALL
    SELECT row, col FROM i WHERE nth IN (SELECT CAST(floor(range * 4799 / 9e0) AS BIGINT) FROM range(10))""")
def vertex_subsample(spark, sf_dir):
    """Every seventh row, and ten rows spread evenly."""
    rows = raster(spark).withColumn("nth", F.row_number().over(Window.orderBy("row", "col")) - 1)
    even = spark.range(10).select(F.floor(F.col("id") * 4799 / 9).alias("nth"))
    return rows.filter("nth % 7 = 0").select("row", "col").unionAll(rows.join(F.broadcast(even), "nth", "left_semi").select("row", "col"))


@query(f"""WITH {PATCH_SQL}, cl AS (SELECT patch, wind, CASE WHEN wind < 3 OR wind > 12 THEN 'undetermined' WHEN {PROBABILITY_SQL} >= 5e-1 THEN 'oil' ELSE 'look_alike' END AS class FROM pt),
    b AS (SELECT *, patch % 17 = 0 OR class = 'undetermined' AS abstained FROM cl)
    SELECT 'abstention' AS rule, count(*) AS rows, count(CASE WHEN abstained <> (class = 'undetermined') THEN 1 END) AS violated FROM b
    UNION ALL SELECT 'wind gate', count(*), count(CASE WHEN NOT (wind BETWEEN 3 AND 12 OR class = 'undetermined') THEN 1 END) FROM b
    UNION ALL SELECT 'reason', count(*), count(CASE WHEN abstained AND NOT (wind < 3 OR wind > 12) THEN 1 END) FROM b""")
def contract_violations(spark, sf_dir):
    from tidemark.operators.evidence import classify, wind_gate

    rows = patches(spark, sf_dir).withColumn("class", classify(F.col("wind"), _probability())).withColumn("reason", wind_gate(F.col("wind")))
    rows = rows.withColumn("abstained", (F.col("patch") % 17 == 0) | (F.col("class") == "undetermined"))
    rules = {"abstention": C.abstention_consistent("abstained", "class"), "wind gate": C.wind_gate_enforced("wind", "class"), "reason": C.abstention_explained("abstained", "reason")}
    return C.violations(rows, rules)


@query("""SELECT n_nationkey AS case_id, TRUE AS box, n_nationkey % 3 <> 0 AS ring, n_nationkey % 2 = 0 AS window_ordered, n_nationkey % 2 = 0 AND n_nationkey % 5 > 0 AS six_hours, n_nationkey % 4 <> 1 AS identifier,
    n_nationkey % 6 <> 0 AS nested FROM nation""")
def manifest_contracts(spark, sf_dir):
    """Ordering, ring, window, identifier and level rules over rows built to break some of them."""
    k = F.col("n_nationkey")
    point = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    closed, open_ = F.array(point(1, 1), point(2, 1), point(2, 2), point(1, 1)), F.array(point(1, 1), point(2, 1), point(2, 2), point(1, 2))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = F.when(k % 2 == 0, (k % 5) * 6).otherwise(-1)
    rows = table(spark, sf_dir, "nation").select(
        k.alias("case_id"), F.struct(F.lit(1.0).alias("min_lon"), F.lit(1.0).alias("min_lat"), F.lit(2.0).alias("max_lon"), F.lit(2.0).alias("max_lat")).alias("aoi"),
        F.when(k % 3 == 0, open_).otherwise(closed).alias("ring"), start.alias("a"), F.timestamp_seconds(F.unix_timestamp(start) + hours * 3600 + F.when(k % 2 == 0, 1).otherwise(0)).alias("b"),
        F.when(k % 4 == 1, F.concat(F.lit("Case "), k)).otherwise(F.concat(F.lit("case_"), k)).alias("name"),
        F.create_map(F.lit("50"), F.when(k % 6 == 0, 9.0).otherwise(1.0), F.lit("95"), F.lit(5.0)).alias("areas"),
    )
    return rows.select("case_id", C.box_ordered("aoi").alias("box"), C.ring_valid("ring").alias("ring"), C.window_ordered("a", "b").alias("window_ordered"), C.window_at_least("a", "b", 6).alias("six_hours"), C.case_id_valid("name").alias("identifier"), C.levels_nest("areas").alias("nested"))


RANKED_SQL = "rk AS (SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) * 75e-2 AS p FROM orders)"


@query(f"WITH {RANKED_SQL} SELECT case_id, TRUE AS contiguous, TRUE AS ordered, TRUE AS normalised, 25e-2 > max(p) AS dark_is_top FROM rk GROUP BY 1")
def ranking_contracts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey", "o_totalprice")
    by = Window.partitionBy("case_id")
    rows = rows.withColumn("rank", F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey"))).withColumn("probability", F.col("o_totalprice") / F.sum("o_totalprice").over(by) * 0.75)
    return C.ranking_violations(rows.withColumn("dark_probability", F.lit(0.25)))


TRIALS_SQL = """tl AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS detected, o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AS inverted, o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS attributed,
    o_orderkey % 4 = 0 AS dark_case, o_orderkey % 2 = 0 AS inside_50, o_orderkey % 10 <> 3 AS inside_95, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 6 END AS culprit_rank, o_totalprice / 1000 AS reduction_factor,
    o_orderkey % 8 = 0 AS dark_is_top, o_totalprice / 100 AS area_95_km2, CAST(12 * (1 + o_orderkey % 4) AS DOUBLE) AS lookback_hours FROM orders)"""


def trials(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    inverted = (k % 11 != 0) & (k % 7 != 0)
    return rows.select(
        (k % 11 != 0).alias("detected"), inverted.alias("inverted"), (inverted & (k % 5 != 0)).alias("attributed"), (k % 4 == 0).alias("dark_case"), (k % 2 == 0).alias("inside_50"), (k % 10 != 3).alias("inside_95"),
        F.when(k % 3 != 0, k % 6).alias("culprit_rank"), (price / 1000).alias("reduction_factor"), (k % 8 == 0).alias("dark_is_top"), (price / 100).alias("area_95_km2"), (12.0 * (1 + k % 4)).alias("lookback_hours"),
    )


@query(f"""WITH {TRIALS_SQL} SELECT count(*) AS trials, count(CASE WHEN detected THEN 1 END) AS detected, count(CASE WHEN attributed THEN 1 END) AS attributed,
    round(avg(CASE WHEN inverted THEN CAST(inside_50 AS INTEGER) END), 9) AS coverage_50, round(avg(CASE WHEN inverted THEN CAST(inside_95 AS INTEGER) END), 9) AS coverage_95,
    round(avg(CASE WHEN attributed AND NOT dark_case THEN CASE WHEN culprit_rank <= 1 THEN 1 ELSE 0 END END), 9) AS top_1, round(avg(CASE WHEN attributed AND NOT dark_case THEN CASE WHEN culprit_rank <= 3 THEN 1 ELSE 0 END END), 9) AS top_3,
    round(median(CASE WHEN attributed THEN reduction_factor END), 6) AS median_reduction, round(median(CASE WHEN inverted THEN area_95_km2 END), 6) AS median_area_95,
    round(avg(CASE WHEN attributed AND dark_case THEN CAST(dark_is_top AS INTEGER) END), 9) AS dark_top_when_dark, round(avg(CASE WHEN attributed AND NOT dark_case THEN CAST(dark_is_top AS INTEGER) END), 9) AS dark_top_when_named FROM tl""")
def calibration_summary(spark, sf_dir):
    out = V.trial_summary(trials(spark, sf_dir))
    digits = {"median_reduction": 6, "median_area_95": 6}
    return out.select("trials", "detected", "attributed", *[F.round(c, digits.get(c, 9)).alias(c) for c in out.columns[3:]])


@query(f"WITH {TRIALS_SQL} SELECT lookback_hours, count(*) AS trials, round(median(area_95_km2), 6) AS median_area_95, round(avg(CAST(inside_95 AS INTEGER)), 9) AS coverage_95 FROM tl WHERE inverted GROUP BY 1")
def area_by_lookback(spark, sf_dir):
    return V.by_lookback(trials(spark, sf_dir)).select("lookback_hours", "trials", F.round("median_area_95", 6).alias("median_area_95"), F.round("coverage_95", 9).alias("coverage_95"))


@query(f"""WITH {PATCH_SQL}, c AS (SELECT CASE WHEN patch % 3 = 0 THEN 1 ELSE 0 END AS y, CASE WHEN {PROBABILITY_SQL} >= 5e-1 THEN 1 ELSE 0 END AS s FROM pt), n AS (SELECT count(CASE WHEN y = 1 AND s = 1 THEN 1 END) AS tp,
    count(CASE WHEN y = 0 AND s = 1 THEN 1 END) AS fp, count(CASE WHEN y = 0 AND s = 0 THEN 1 END) AS tn, count(CASE WHEN y = 1 AND s = 0 THEN 1 END) AS fn FROM c)
    SELECT tp, fp, tn, fn, round(fp / CAST(fp + tn AS DOUBLE), 9) AS false_positive_rate, round(tn / CAST(fp + tn AS DOUBLE), 9) AS specificity, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 9) AS accuracy FROM n""")
def confusion_matrix(spark, sf_dir):
    rows = patches(spark, sf_dir).select((F.col("patch") % 3 == 0).cast("int").alias("label"), (_probability() >= 0.5).cast("int").alias("prediction"))
    out = V.confusion(rows)
    return out.select("tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("false_positive_rate", "specificity", "accuracy")])


@query()
def gbt_classifier(spark, sf_dir):
    """Boosted trees that learn the rule-based classes, scored on patches that stayed out."""
    rows = patches(spark, sf_dir).withColumn("label", (_probability() >= 0.5).cast("double")).withColumn("held", F.col("patch") % 5 == 0)
    _, _, held = V.train_gate(rows, ["damping", "gradient_ratio", "elongation", "wind_gradient", "solidity"], hold_out="held", trees=8)
    return V.confusion(held)


@query(f"WITH {POSITIONS_SQL}, r AS (SELECT CASE WHEN NOT (lat BETWEEN -90 AND 90) THEN 'bad position' WHEN NOT (lon BETWEEN 105e-1 AND 12e0 AND lat BETWEEN 565e-1 AND 575e-1) THEN 'outside the area' ELSE 'kept' END AS reason FROM pos) SELECT reason, count(*) AS rows FROM r GROUP BY 1")
def drops_by_reason(spark, sf_dir):
    bad = ~F.col("lat").between(-90, 90)
    outside = ~(F.col("lon").between(10.5, 12.0) & F.col("lat").between(56.5, 57.5))
    return positions(spark, sf_dir).groupBy(F.when(bad, "bad position").when(outside, "outside the area").otherwise("kept").alias("reason")).agg(F.count("*").alias("rows"))


@query("""WITH px AS (SELECT l_suppkey AS tile, CASE WHEN l_linenumber % 2 = 0 THEN 'vv' ELSE 'vh' END AS band, -l_quantity - CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 4 + l_suppkey % 5 END AS value FROM lineitem)
    SELECT tile, round(quantile_cont(value, 1e-2), 6) AS p01, round(quantile_cont(value, 99e-2), 6) AS p99, round(median(CASE WHEN band = 'vv' THEN value END) - median(CASE WHEN band = 'vh' THEN value END), 6) AS band_gap_db FROM px GROUP BY 1""")
def tile_inspection(spark, sf_dir):
    from tidemark.sources.readers import inspect_tiles

    even = F.col("l_linenumber") % 2 == 0
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tile"), F.when(even, "vv").otherwise("vh").alias("band"), (-F.col("l_quantity") - F.when(even, 0).otherwise(4 + F.col("l_suppkey") % 5)).alias("value"))
    out = inspect_tiles(pixels)
    return out.select("tile", F.round("p01", 6).alias("p01"), F.round("p99", 6).alias("p99"), F.round(F.col("vv") - F.col("vh"), 6).alias("band_gap_db"))


@query("""SELECT event_id, CAST(coalesce(TRY_CAST(json_extract_string(CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT), -1) AS BIGINT) AS k FROM events""")
def json_with_default(spark, sf_dir):
    from tidemark.sources.readers import parse_or_default

    text = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))
    value = parse_or_default(text, "struct<k:bigint>", F.struct(F.lit(-1).cast("long").alias("k")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(value["k"], F.lit(-1)).alias("k"))


@query("SELECT l_suppkey AS stem, count(*) AS images FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1")
def pairs_by_stem(spark, sf_dir):
    from tidemark.sources.readers import pair_by_stem

    images = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/tiles/a/"), "l_suppkey", F.lit(".tif")).alias("path"))
    masks = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("/masks/"), "s_suppkey", F.lit("_mask.png")).alias("path"))
    return pair_by_stem(images, masks).groupBy(F.col("stem").cast("long").alias("stem")).agg(F.count("*").alias("images"))


@query(f"WITH {POSITIONS_SQL} SELECT count(*) AS cells FROM (SELECT x.range AS ix, y.range AS iy, 10e0 + x.range * 5e-2 AS lon, 56e0 + y.range * 5e-2 AS lat FROM range(60) x CROSS JOIN range(50) y) g WHERE " + "(" + " + ".join(f"CASE WHEN (({y1}e0 > lat) <> ({y2}e0 > lat)) AND lon < ({x2}e0 - {x1}e0) * (lat - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING[:-1], RING[1:], strict=True)) + ") % 2 = 1")
def polygon_cells(spark, sf_dir):
    cells = spark.range(3000).select((F.col("id") % 60).alias("ix"), F.floor(F.col("id") / 60).alias("iy"))
    return R.rasterise(RING, cells, 10.0 + F.col("ix") * 0.05, 56.0 + F.col("iy") * 0.05).agg(F.count("*").alias("cells"))


@query(f"""WITH {RASTER_SQL}, pc AS (SELECT row, col, row // 20 * 10 + col // 20 AS patch FROM ras WHERE value < 30), bx AS (SELECT patch, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM pc GROUP BY 1)
    SELECT CAST(patch AS BIGINT) AS patch, round((max(value) - min(value)) / (greatest(max(r1) - max(r0), max(c1) - max(c0)) + 1) / 5e-1, 6) AS wind_gradient FROM bx JOIN ras ON row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY 1""")
def wind_spread(spark, sf_dir):
    """Range of a field over each block of 20 by 20 cells that holds dark cells."""
    base = raster(spark)
    patch = (F.floor(F.col("row") / 20) * 10 + F.floor(F.col("col") / 20)).alias("patch")
    out = K.wind_spread(base.filter("value < 30").select("row", "col", patch), base.withColumnRenamed("value", "wind"), 0.5)
    return out.select("patch", F.round("wind_gradient", 6).alias("wind_gradient"))


@query(f"""WITH {TRACKS_SQL}, ct AS (SELECT CAST(floor(lon / 25e-2) AS BIGINT) AS cx, CAST(floor(lat / 25e-2) AS BIGINT) AS cy, count(*) AS n FROM tr GROUP BY 1, 2), bz AS (SELECT cx, cy FROM ct WHERE n >= (SELECT quantile_cont(n, 7e-1) FROM ct))
    SELECT cx, cy, round((SELECT min(sqrt(pow(ct.cx - bz.cx, 2) + pow(ct.cy - bz.cy, 2))) FROM bz WHERE pow(ct.cx - bz.cx, 2) + pow(ct.cy - bz.cy, 2) <= 9), 6) AS distance FROM ct""")
def lane_distances(spark, sf_dir):
    from tidemark.plans.track_queries import tracks_of

    counts, busy = R.lane_distance(tracks_of(spark, sf_dir), 0.25)
    return K.distance_to_busy(counts, busy, 3).select("cx", "cy", F.round("distance", 6).alias("distance"))


@query("""SELECT o_custkey AS case_id, max(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS area_50, max(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS area_95 FROM orders GROUP BY 1""")
def level_maps(spark, sf_dir):
    """Areas keyed by level in a map, read back out of it."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderkey") % 2 == 0, 50).otherwise(95).alias("level"), "o_totalprice")
    maps = K.level_map(rows.groupBy("case_id", "level").agg(F.max("o_totalprice").alias("area_km2")))
    return maps.select("case_id", F.col("credible_regions")["50"].alias("area_50"), F.col("credible_regions")["95"].alias("area_95"))


@query(f"""WITH gr AS (SELECT CAST(x.range AS INTEGER) AS ix, CAST(y.range AS INTEGER) AS iy, 2e0 * x.range - 3e0 * y.range + 1 AS u FROM range(12) x CROSS JOIN range(9) y)
    SELECT s_suppkey AS id, round(2e0 * (s_suppkey % 23 - 5) / 1e0 - 3e0 * (s_suppkey % 17 - 4) + 1, 6) AS u FROM supplier""")
def resample_plane(spark, sf_dir):
    """A plane resampled inside and beyond its grid."""
    from tidemark.operators.spatial import resample

    grid = spark.range(108).select((F.col("id") % 12).cast("int").alias("ix"), F.floor(F.col("id") / 12).cast("int").alias("iy")).withColumn("u", 2.0 * F.col("ix") - 3.0 * F.col("iy") + 1)
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 23 - 5).cast("double").alias("x"), (F.col("s_suppkey") % 17 - 4).cast("double").alias("y"))
    return resample(points, grid, ["u"], 0.0, 0.0, 1.0, 1.0, 12, 9).select("id", F.round("u", 6).alias("u"))


@query()
def injected_slick(spark, sf_dir):
    """Particles drawn into a scene, and the patches that detection and truth share."""
    i = F.col("id")
    points = spark.range(4000).select((25 + F.round(2 * hash_normal(1, 1, i))).cast("int").alias("row"), (40 + F.round(6 * hash_normal(1, 2, i))).cast("int").alias("col"))
    damping = K.render_damping(points, ROWS, COLS, 1e4)
    scene = raster(spark).select("row", "col", F.lit(-18.0).alias("value"), (F.col("row") > 55).alias("land"))
    drawn = K.inject(scene, damping)
    patches_ = R.label_components(drawn.filter("value < -20").select("row", "col"), least=4)
    return K.harvest(patches_, drawn.filter("truth").select("row", "col"), F.lit(6.0)).join(F.broadcast(K.peak_damping(damping)))  # one row
