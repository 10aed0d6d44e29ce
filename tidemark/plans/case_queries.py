"""Queries over several cases at once, notes and reasons, contracts, small relational operators, sources and sinks, and fields read from grids."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import contracts as C
from tidemark.operators import evaluation as V
from tidemark.operators import evidence as E
from tidemark.operators import generate as G
from tidemark.operators import positions as P
from tidemark.operators import posterior as Q
from tidemark.operators import raster as R
from tidemark.operators import slick as SL
from tidemark.operators import spatial as S
from tidemark.operators import transport as X
from tidemark.plans.evidence_queries import PATCH_SQL, PROBABILITY_SQL, SPEED_SQL, _probability
from tidemark.plans.tables import EPOCH_US, POSITIONS_SQL, RASTER_SQL, TRACKS_SQL, patches, positions, raster, table
from tidemark.plans.track_queries import WINDOWS_SQL, tracks_of, windows_of
from tidemark.sources import readers, sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _shared(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    R._checkpoint(spark.range(0))  # makes sure that a shared folder is set
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


# Several cases: orders by customer's nation are cases, suppliers their candidates.
CASES_SQL = """cs AS (SELECT s_nationkey AS case_id, s_suppkey AS mover, -s_acctbal / 2000 AS lm, 1e0 + (s_suppkey % 4) * 5e-1 AS prior FROM supplier),
dk AS (SELECT s_nationkey AS case_id, p.range AS sample, -(CAST(s_suppkey AS DOUBLE) + p.range) / 40 AS ll FROM supplier CROSS JOIN range(5) p),
dm AS (SELECT case_id, max(ll) + ln(sum(exp(ll - top))) - ln(count(*)) AS dark_lm FROM (SELECT *, max(ll) OVER (PARTITION BY case_id) AS top FROM dk) d GROUP BY 1),
sh AS (SELECT cs.*, dark_lm, greatest(max(lm) OVER (PARTITION BY case_id), dark_lm) AS shift, sum(prior) OVER (PARTITION BY case_id) AS ps FROM cs JOIN dm USING (case_id)),
ww AS (SELECT *, 85e-2 * prior / ps * exp(lm - shift) AS w, 15e-2 * exp(dark_lm - shift) AS dw FROM sh),
pp AS (SELECT case_id, mover, w / (sum(w) OVER (PARTITION BY case_id) + dw) AS p, dw / (sum(w) OVER (PARTITION BY case_id) + dw) AS dark FROM ww)"""


def _dark(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("mover")).crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "sample")))
    rows = rows.withColumn("ll", -(F.col("mover").cast("double") + F.col("sample")) / 40).withColumn("window", F.col("mover") * 10 + F.col("sample"))
    return E.marginalise(rows, ["case_id"], "ll", "window").select("case_id", F.col("log_marginal").alias("dark_log_marginal"))


def _cases(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("mover"), (-F.col("s_acctbal") / 2000).alias("log_marginal"), (1.0 + (F.col("s_suppkey") % 4) * 0.5).alias("prior"))
    return E.combine(rows.join(_dark(spark, sf_dir), "case_id"), "dark_log_marginal", 0.15, ["case_id"])


@query(f"WITH {CASES_SQL} SELECT case_id, round(dark_lm, 9) AS dark_log_marginal FROM dm")
def dark_marginals(spark, sf_dir):
    """The log mean likelihood of each case's sampled sources that no track explains."""
    return _dark(spark, sf_dir).select("case_id", F.round("dark_log_marginal", 9).alias("dark_log_marginal"))


@query(f"WITH {CASES_SQL} SELECT case_id, mover, round(p, 9) AS probability, round(dark, 9) AS dark_probability, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(p, 12) DESC, mover) AS INTEGER) AS rank FROM pp")
def combined_cases(spark, sf_dir):
    """Candidates of several cases, combined and ranked apart."""
    ranked = E.rank(_cases(spark, sf_dir).withColumn("probability", F.round("probability", 12)), ["mover"], ["case_id"])
    return ranked.select("case_id", "mover", F.round("probability", 9).alias("probability"), F.round("dark_probability", 9).alias("dark_probability"), "rank")


@query(f"""WITH {CASES_SQL}, rk AS (SELECT case_id, mover, floor(p * 1000) / 1000 AS p, floor(dark * 1000) / 1000 AS dark, row_number() OVER (PARTITION BY case_id ORDER BY floor(p * 1000) DESC, mover) AS rank FROM pp)
    SELECT case_id, mover, round(CASE WHEN rank = 1 THEN p + 1 - dark - sum(p) OVER (PARTITION BY case_id) ELSE p END, 9) AS probability, CAST(rank AS INTEGER) AS rank FROM rk""")
def rebalanced_cases(spark, sf_dir):
    """Probabilities cut to three places, whose rest goes to each case's first rank."""
    cut = lambda c: (F.floor(F.col(c) * 1000) / 1000).alias(c)
    rows = _cases(spark, sf_dir).select("case_id", "mover", cut("probability"), cut("dark_probability"))
    return E.rebalance(E.rank(rows, ["mover"], ["case_id"]), keys=["case_id"]).select("case_id", "mover", F.round("probability", 9).alias("probability"), "rank")


@query(f"""WITH {CASES_SQL}, s AS (SELECT case_id, mover, exp(lm - max(lm) OVER (PARTITION BY case_id)) AS e FROM cs), w AS (SELECT case_id, mover, e / sum(e) OVER (PARTITION BY case_id) AS weight FROM s)
    SELECT case_id, round(100 / sum(weight * weight), 6) AS ess, round(max(weight), 9) AS largest FROM w GROUP BY 1""")
def ess_by_case(spark, sf_dir):
    """Softmax weights within each case, and what their effective number of particles is."""
    rows = Q.softmax(_cases(spark, sf_dir).select("case_id", "mover", "log_marginal"), "log_marginal", keys=["case_id"])
    top = rows.groupBy("case_id").agg(F.round(F.max("weight"), 9).alias("largest"))
    return Q.effective_sample_size(rows, 100, ["case_id"]).join(top, "case_id").select("case_id", F.round("ess", 6).alias("ess"), "largest")


_CELLS_SQL = """ce AS (SELECT o_orderkey % 5 AS case_id, o_custkey % 20 AS ix, CAST(floor(sum(o_totalprice)) AS BIGINT) AS w FROM orders GROUP BY 1, 2),
hd AS (SELECT *, sum(w) OVER o - w AS before, sum(w) OVER (PARTITION BY case_id) AS total, row_number() OVER o AS nth FROM ce WINDOW o AS (PARTITION BY case_id ORDER BY w DESC, ix ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {_CELLS_SQL}, k AS (SELECT case_id, count(CASE WHEN before < 5e-1 * total THEN 1 END) AS k, count(CASE WHEN before < 95e-2 * total THEN 1 END) AS n FROM hd GROUP BY 1)
    SELECT case_id, ix, nth <= CASE WHEN k >= n THEN greatest(n - 1, 1) ELSE k END AS in_inner FROM hd JOIN k USING (case_id) WHERE before < 95e-2 * total""")
def levels_by_case(spark, sf_dir):
    """Nested credible sets of several cases in one table."""
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 5).alias("case_id"), (F.col("o_custkey") % 20).alias("ix")).agg(F.floor(F.sum("o_totalprice")).cast("long").alias("w"))
    return Q.nested_levels(rows, 0.5, 0.95, ["ix"], groups=["case_id"]).select("case_id", "ix", "in_inner")


@query(f"WITH {_CELLS_SQL}, t AS (SELECT *, w / CAST(max(w) OVER (PARTITION BY case_id) AS DOUBLE) AS share FROM ce) SELECT case_id, ix, round(share, 9) AS share FROM t WHERE share >= 3e-1")
def peaks_by_case(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 5).alias("case_id"), (F.col("o_custkey") % 20).alias("ix")).agg(F.floor(F.sum("o_totalprice")).cast("long").alias("w"))
    return Q.peak_normalised(rows, 0.3, keys=["case_id"]).select("case_id", "ix", F.round("share", 9).alias("share"))


# Notes and reasons. Values that end on a half at the last digit shown would be printed either way, so they are kept off it.
@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL}, {SPEED_SQL}, r AS (SELECT mmsi, track, CAST(round(s, 1) AS DOUBLE) AS s, CAST(round(m, 1) AS DOUBLE) AS m FROM ws JOIN tm USING (mmsi, track))
    SELECT mmsi, track, CASE WHEN s IS NULL OR m IS NULL OR m <= 5e-1 THEN 'too few speeds in the window' WHEN s / m >= 75e-2 THEN printf('%.1f kn, near the usual %.1f kn', s, m)
    ELSE printf('slowed to %.1f kn from the usual %.1f kn', s, m) END AS note FROM r""")
def speed_notes(spark, sf_dir):
    from tidemark.operators import temporal as T

    tracks = tracks_of(spark, sf_dir)
    rows = T.window_speed(tracks, windows_of(tracks)).join(tracks.groupBy("mmsi", "track").agg(F.median("sog_kn").alias("transit_kn")), ["mmsi", "track"])
    # In binary, as in SQL: a median of 6.95 that is held as 6.949... is shown as 7.0, where a decimal round gives 6.9.
    shown = lambda c: F.round(F.col(c) * 10) / 10
    return rows.select("mmsi", "track", E.speed_note(shown("speed_kn"), shown("transit_kn")).alias("note"))


_TYPES = "CASE ship_type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in E.TYPE_PRIOR.items()) + " ELSE 1e0 END"
_FOLD = "abs((((cog_deg - 30 + 90) % 180) + 180) % 180 - 90)"


@query(f"""WITH {POSITIONS_SQL} SELECT ord, CASE WHEN cog_deg < 20 THEN 'steady course' ELSE printf('course changed by %.0f degrees', cog_deg) END AS course,
    CASE WHEN {_TYPES} = 1 THEN lower(ship_type) || ': no weight either way' ELSE lower(ship_type) || printf(': weight %.1f', {_TYPES}) END AS type,
    CASE WHEN {_FOLD} > 75 THEN printf('heading %.0f degrees off the axis, not aligned', {_FOLD}) ELSE printf('heading within %.0f degrees of the axis', {_FOLD}) END AS alignment FROM pos""")
def evidence_notes(spark, sf_dir):
    """What course, type and heading say, in words; courses are whole degrees."""
    rows = E.type_factor(positions(spark, sf_dir))
    return rows.select("ord", E.course_note(F.col("cog_deg")).alias("course"), E.type_note(F.col("ship_type"), F.col("type_factor")).alias("type"), E.alignment_note(F.col("cog_deg"), F.lit(30.0)).alias("alignment"))


_KIND_SQL = f"CASE WHEN wind < 3 OR wind > 12 THEN 'undetermined' WHEN {PROBABILITY_SQL} >= 5e-1 THEN 'oil' ELSE 'look_alike' END"


@query(f"""WITH {PATCH_SQL}, d AS (SELECT patch, {_KIND_SQL} AS class, wind, CAST(floor(damping * 100) AS INTEGER) AS d, CAST(floor(gradient_ratio * 100) AS INTEGER) AS g, CAST(round(elongation * 10) AS INTEGER) AS e, CAST(round(solidity * 100) AS INTEGER) AS s FROM pt)
    SELECT patch, class, CASE WHEN wind < 3 THEN printf('Wind %.1f m/s is below the 3 m/s threshold. Outside detectability window.', wind) WHEN wind > 12 THEN printf('Wind %.1f m/s is above the 12 m/s threshold. Outside detectability window.', wind)
    WHEN class = 'oil' THEN printf('Wind %.1f m/s allows a judgement; damping %.2f, edge ratio %.2f and elongation %.1f speak for oil.', wind, d / 1e2, g / 1e2, e / 1e1)
    ELSE printf('Wind %.1f m/s allows a judgement; edge ratio %.2f, solidity %.2f and elongation %.1f speak for another surface feature.', wind, g / 1e2, s / 1e2, e / 1e1) END AS reason FROM d""")
def class_reasons(spark, sf_dir):
    """The class of each patch and why; figures are cut to the digits shown."""
    rows = patches(spark, sf_dir).withColumn("class", E.classify(F.col("wind"), _probability()))
    two = lambda c: F.floor(F.col(c) * 100) / 100
    return rows.select("patch", "class", E.class_reason(F.col("class"), F.col("wind"), two("damping"), two("gradient_ratio"), F.round("elongation", 1), F.round("solidity", 2)).alias("reason"))


@query("SELECT event_id, round((degrees(atan2(-(value - 50), -((user_id % 21) - 10))) + 360) % 360, 6) AS from_deg FROM events WHERE abs(value - 50) > 1e-3")
def wind_bearings(spark, sf_dir):
    """Where winds come from."""
    rows = table(spark, sf_dir, "events").filter(F.abs(F.col("value") - 50) > 1e-3)
    return rows.select("event_id", F.round(geo.wind_from_deg(F.col("value") - 50, ((F.col("user_id") % 21) - 10).cast("double")), 6).alias("from_deg"))


@query(f"WITH {RASTER_SQL} SELECT row, col, round(least(greatest((value - 100 + 30) / 30, 0e0), 1e0), 9) AS shade FROM ras")
def display_shades(spark, sf_dir):
    """Decibels as shades between -30 and 0."""
    return raster(spark).select("row", "col", F.round(R.unit_scale(F.col("value") - 100), 9).alias("shade"))


@query("SELECT CAST(range AS BIGINT) AS id, round(-9 * (1 - exp(-(range * 1e-6) / 12e-5)), 9) + 0e0 AS damping FROM range(600)")
def damping_curve(spark, sf_dir):
    return spark.range(600).select("id", (F.round(G.damping_db(F.col("id") * 1e-6), 9) + 0.0).alias("damping"))


@query(f"""WITH {RASTER_SQL} SELECT min(value) AS peak_db FROM ras""")
def peak_value(spark, sf_dir):
    return SL.peak_damping(raster(spark).withColumnRenamed("value", "damping"))


_LON, _LAT = "(10e0 + (o_custkey % 300) / 1e2)", "(55e0 + (o_orderkey % 300) / 1e2)"


@query(f"""WITH p AS (SELECT o_orderkey AS id, {_LON} AS lon, {_LAT} AS lat FROM orders) SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone,
    TRUE AS turned FROM p""")
def utm_there_and_back(spark, sf_dir):
    """Coordinates through the grid and back, with the zone, and whether the grid's convergence is within 0.001 degrees of its closed form on
    the sphere."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (10.0 + (F.col("o_custkey") % 300) / 100).alias("lon"), (55.0 + (F.col("o_orderkey") % 300) / 100).alias("lat"))
    zone = (F.floor((F.col("lon") + 180) / 6) + 1).cast("int")
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), zone)
    rows = rows.withColumn("zone", zone).withColumn("x", x).withColumn("y", y)
    lon, lat = geo.utm_inverse(F.col("x"), F.col("y"), F.col("zone"))
    sphere = F.atan(F.tan(F.radians(F.col("lon") - (F.col("zone") * 6 - 183))) * F.sin(F.radians("lat")))
    turned = F.abs(F.degrees(geo.grid_convergence(F.col("lon"), F.col("lat"), F.col("zone")) + sphere)) < 1e-3
    return rows.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), "zone", turned.alias("turned"))


# Evaluation.
_TRIALS = "SELECT o_orderkey % 3 AS family, o_orderkey % 2 = 0 AS i50, o_orderkey % 3 <> 0 AS i68, o_orderkey % 8 <> 0 AS i90, o_orderkey % 20 <> 0 AS i95, o_totalprice / 100 AS area, (o_custkey % 100) / 1e2 AS ess FROM orders"


def _trials(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k % 3).alias("family"), (k % 2 == 0).alias("inside_50"), (k % 3 != 0).alias("inside_68"), (k % 8 != 0).alias("inside_90"), (k % 20 != 0).alias("inside_95"), (F.col("o_totalprice") / 100).alias("area_95_km2"),
        ((F.col("o_custkey") % 100) / 100).alias("ess_share"), F.lit(True).alias("inverted"), (k % 5 != 0).alias("attributed"), F.lit(True).alias("detected"), (k % 4 == 0).alias("dark_case"),
        (k % 6).alias("culprit_rank"), F.lit(2.0).alias("reduction_factor"), (k % 8 == 0).alias("dark_is_top"),
    )


@query(f"""WITH t AS ({_TRIALS}) SELECT family, count(*) AS trials, round(avg(CAST(i50 AS INTEGER)), 9) AS coverage_50, round(avg(CAST(i68 AS INTEGER)), 9) AS coverage_68, round(avg(CAST(i90 AS INTEGER)), 9) AS coverage_90,
    round(avg(CAST(i95 AS INTEGER)), 9) AS coverage_95, round(median(area), 6) AS median_area_95, round(avg(ess), 9) AS mean_ess_share FROM t GROUP BY 1""")
def calibration_by_family(spark, sf_dir):
    """Coverage at all four levels by family of trials."""
    out = V.calibration_table(_trials(spark, sf_dir), ["family"])
    return out.select("family", "trials", *[F.round(c, 6 if "area" in c else 9).alias(c) for c in out.columns[2:]])


@query(f"WITH t AS ({_TRIALS}) SELECT round(avg(CAST(i50 AS INTEGER)), 9) AS coverage_50, round(avg(CAST(i68 AS INTEGER)), 9) AS coverage_68, round(avg(CAST(i90 AS INTEGER)), 9) AS coverage_90, round(avg(CAST(i95 AS INTEGER)), 9) AS coverage_95 FROM t")
def coverage_levels(spark, sf_dir):
    return V.trial_summary(_trials(spark, sf_dir)).select(*[F.round(f"coverage_{x}", 9).alias(f"coverage_{x}") for x in V.LEVELS])


# Contracts.
@query("""SELECT 'seed_identified' AS rule, count(*) AS rows, count(CASE WHEN o_orderkey % 9 = 0 THEN 1 END) AS violated FROM orders UNION ALL
    SELECT 'seed_placed', count(*), count(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 1 END) FROM orders UNION ALL SELECT 'seed_timed', count(*), count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END) FROM orders""")
def seed_contract(spark, sf_dir):
    """Seeds with missing identifiers, places that are missing or no numbers, and missing times, counted by rule."""
    k = F.col("o_orderkey")
    seeds = table(spark, sf_dir, "orders").select(
        F.when(k % 9 != 0, k).alias("particle_id"), k.alias("origin"), F.when(k % 7 != 0, k.cast("double")).alias("x"),
        F.when(k % 11 == 0, float("nan")).otherwise(k.cast("double")).alias("y"), F.when(k % 5 != 0, k.cast("double")).alias("seed_time"),
    )
    return C.violations(seeds, C.seed_rules())


@query("""SELECT n_nationkey AS id, n_nationkey % 2 = 0 AS sums, TRUE AS density, n_nationkey % 3 <> 0 AS ess, n_nationkey * 6 <= 72 OR n_nationkey % 4 <> 0 AS honest, n_nationkey % 5 > 0 AS funnel,
    round((n_nationkey + n_nationkey + 4) / 2e0, 6) AS centre_lon, 5e1 + 5e-1 AS centre_lat, CAST(n_nationkey * 6 AS DOUBLE) AS lookback, n_nationkey % 3 <> 1 AS co_polarised, n_nationkey % 2 = 1 AS components FROM nation""")
def posterior_contracts(spark, sf_dir):
    """Rules of posteriors and manifests, one row a nation; each is broken somewhere."""
    k = F.col("n_nationkey")
    start = F.timestamp_micros(F.lit(EPOCH_US))
    rows = table(spark, sf_dir, "nation").select(
        k.alias("id"), F.array(F.lit(0.25), F.lit(0.5), F.when(k % 2 == 0, 0.25).otherwise(0.3)).alias("w"), F.when(k % 3 != 0, 10.0).otherwise(1000.0).alias("ess"), F.lit(100.0).alias("n"), (k * 6.0).alias("lookback"),
        (k % 4 == 0).alias("within"), (k % 5).alias("a"), F.struct(k.cast("double").alias("min_lon"), (k + 4.0).alias("max_lon"), F.lit(50.0).alias("min_lat"), F.lit(51.0).alias("max_lat")).alias("box"),
        start.alias("t0"), F.timestamp_micros(F.lit(EPOCH_US) + (k * 6 * 3_600_000_000)).alias("t1"), F.element_at(F.array(F.lit("VV"), F.lit("vh"), F.lit("hh")), (k % 3 + 1).cast("int")).alias("pol"),
        F.when(k % 2 == 0, F.array(F.lit("u10"), F.lit("Wind_Speed"))).otherwise(F.array(F.lit("u10"), F.lit("v10"))).alias("names"),
    ).withColumn("zero", F.lit(1)).withColumn("top", F.lit(4))
    lon, lat = C.box_centroid("box")
    return rows.select(
        "id", C.sums_to_one("w").alias("sums"), C.density_valid("w").alias("density"), C.ess_bounded("ess", "n").alias("ess"), C.envelope_honest("lookback", "within").alias("honest"), C.funnel_monotone("zero", "a", "top").alias("funnel"),
        F.round(lon, 6).alias("centre_lon"), lat.alias("centre_lat"), C.lookback_hours("t0", "t1").alias("lookback"), C.co_polarised("pol").alias("co_polarised"), C.wind_is_components("names").alias("components"),
    )


# Small relational operators.
@query(f"WITH {TRACKS_SQL} SELECT mmsi, count(*) AS fixes FROM tr WHERE mmsi <> (SELECT max(mmsi) FROM tr) GROUP BY 1")
def without_vessel(spark, sf_dir):
    """Tracks without those of one vessel, here the last."""
    tracks = tracks_of(spark, sf_dir)
    return P.without(tracks, tracks.agg(F.max("mmsi").alias("mmsi"))).groupBy("mmsi").agg(F.count("*").alias("fixes"))


@query(f"WITH {PATCH_SQL}, d AS (SELECT patch, wind, {_KIND_SQL} AS class FROM pt) SELECT d.patch, round(wind, 6) AS wind FROM d JOIN (SELECT l_partkey AS patch FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 600) q ON d.patch = q.patch WHERE class = 'oil'")
def detections_by_id(spark, sf_dir):
    """Actionable detections that are asked for by their numbers."""
    from tidemark.plans.pipelines import actionable

    rows = patches(spark, sf_dir).withColumn("class", E.classify(F.col("wind"), _probability()))
    asked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("patch")).agg(F.sum("l_quantity").alias("q")).filter("q > 600").select("patch")
    return actionable(rows).join(asked, "patch").select("patch", F.round("wind", 6).alias("wind"))


@query("""WITH r AS (SELECT l_orderkey AS region, CAST(l_linenumber AS INTEGER) AS ring, CAST(l_quantity AS DOUBLE) AS area, l_partkey % 7 + 4 AS n FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, abs(area) DESC, ring) AS nth FROM r) SELECT region, ring, area FROM k WHERE nth = 1""")
def longest_rings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("region"), F.col("l_linenumber").cast("int").alias("ring"), F.col("l_quantity").cast("double").alias("area"), F.array_repeat(F.lit(0), (F.col("l_partkey") % 7 + 4).cast("int")).alias("vertices"))
    return R.longest_ring(rows, ["region"]).select("region", "ring", "area")


@query(f"""WITH {RASTER_SQL}, sea AS (SELECT row, col FROM ras WHERE row < 40), c AS (SELECT row, col, row // 10 * 10 + col // 10 AS patch FROM ras WHERE value < 20), k AS (SELECT c.* FROM c SEMI JOIN sea ON c.row = sea.row AND c.col = sea.col)
    SELECT patch, count(*) AS n_cells, median(r.value) AS sea_median, max(z.m) AS background FROM k JOIN ras r ON k.row = r.row AND k.col = r.col, (SELECT median(value) AS m FROM ras WHERE row < 40) z GROUP BY 1 HAVING count(*) >= 12""")
def sea_candidates(spark, sf_dir):
    """Dark cells at sea by block, of at least twelve cells, with the sea's median as their background."""
    cells = raster(spark)
    sea = cells.filter("row < 40")
    dark = cells.filter("value < 20").join(sea.select("row", "col"), ["row", "col"], "left_semi").select("row", "col", (F.floor(F.col("row") / 10) * 10 + F.floor(F.col("col") / 10)).alias("patch"), "value")
    kept = P.at_least(dark, ["patch"], 12)
    return kept.groupBy("patch").agg(F.count("*").alias("n_cells"), F.median("value").alias("sea_median")).crossJoin(F.broadcast(sea.agg(F.median("value").alias("background"))))


@query("SELECT DISTINCT CAST(month(o_orderdate) AS DOUBLE) * 3600 AS t0 FROM orders")
def release_axis(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.month("o_orderdate").cast("double") * 3600).alias("t0")).distinct()


@query("""WITH b AS (SELECT 1 AS id, 105e-1 AS x0, 56e0 AS y0, 12e0 AS x1, 57e0 AS y1), p AS (SELECT range AS k, range / 1e1 AS f FROM range(11)) SELECT k, round(x0 + f * (x1 - x0), 9) AS lon, round(y0 + f * (y1 - y0), 9) AS lat FROM b, p""")
def box_shares(spark, sf_dir):
    """Points at shares of a box."""
    box = G.Box(min_lon=10.5, min_lat=56.0, max_lon=12.0, max_lat=57.0)
    rows = [(k, *map(float, box.at(k / 10, k / 10))) for k in range(11)]
    return spark.createDataFrame(rows, "k long, lon double, lat double").select("k", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


# Components of several shapes: bars, a spiral, cells that touch by a corner only.
def _shape_cells() -> list[tuple[int, int]]:
    cells = [(0, c) for c in range(30)] + [(2, 2 * c) for c in range(10)] + [(10 + k, 10 + k) for k in range(12)]
    r, c, d, left = 30, 30, (0, 1), 7
    while left > 1:  # a spiral, one cell wide
        for _ in range(2):
            for _ in range(left):
                cells.append((r, c))
                r, c = r + d[0], c + d[1]
            d = (d[1], -d[0])
        left -= 2
    return sorted(set(cells))


def _shapes(spark):
    return spark.createDataFrame(_shape_cells(), "row int, col int")


def _labels_sql(diagonal: bool) -> str:
    near = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1" if diagonal else "abs(a.row - b.row) + abs(a.col - b.col) <= 1"
    return f"""WITH RECURSIVE sp AS (SELECT * FROM (VALUES {", ".join(map(str, _shape_cells()))}) v(row, col)), nb AS (SELECT a.row * 1000 + a.col AS a, b.row * 1000 + b.col AS b FROM sp a JOIN sp b ON {near}),
    rc AS (SELECT a, b FROM nb UNION SELECT rc.a, nb.b FROM rc JOIN nb ON rc.b = nb.a) SELECT low // 1000 AS row, low % 1000 AS col, count(*) AS n_cells FROM (SELECT a, min(b) AS low FROM rc GROUP BY 1) z GROUP BY low"""


def _labelled(spark, diagonal: bool):
    low = F.min(F.struct("row", "col"))
    return R.label_components(_shapes(spark), diagonal=diagonal).groupBy("patch").agg(low.alias("low"), F.count("*").alias("n_cells")).select("low.row", "low.col", "n_cells")


@query(_labels_sql(True))
def components_of_shapes(spark, sf_dir):
    """Patches of bars, a diagonal, single cells and a spiral, corners counted."""
    return _labelled(spark, True)


@query(_labels_sql(False))
def components_by_sides(spark, sf_dir):
    return _labelled(spark, False)


@query(f"""WITH {RASTER_SQL}, pc AS (SELECT row, col, value, row // 20 * 10 + col // 20 AS patch FROM ras WHERE value < 30), m AS (SELECT patch, count(*) AS n_cells, avg(row) AS centre_row, avg(col) AS centre_col, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS darkest,
    var_samp(row) AS vr, var_samp(col) AS vc, covar_samp(row, col) AS cv FROM pc GROUP BY 1), x AS (SELECT *, sqrt(pow(vr - vc, 2) / 4 + cv * cv) AS root FROM m)
    SELECT patch, n_cells, round(centre_row, 6) AS centre_row, round(centre_col, 6) AS centre_col, round(mean, 6) AS mean, round(sd, 6) AS sd, darkest, round(50 - mean, 6) AS damping,
    round(sqrt(greatest((vr + vc) / 2 + root, 0e0) / greatest((vr + vc) / 2 - root, 1e-9)), 6) AS elongation FROM x""")
def patches_radiometry(spark, sf_dir):
    """Radiometry and principal axes of twelve patches at once."""
    cells = raster(spark)
    parts = cells.filter("value < 30").select("row", "col", (F.floor(F.col("row") / 20) * 10 + F.floor(F.col("col") / 20)).alias("patch"))
    out = R.patch_summary(parts, cells, 50.0)
    return out.select("patch", "n_cells", *[F.round(c, 6).alias(c) for c in ("centre_row", "centre_col", "mean", "sd")], "darkest", F.round("damping", 6).alias("damping"), F.round("elongation", 6).alias("elongation"))


@query(f"""WITH {RASTER_SQL}, pc AS (SELECT row, col, row // 20 * 10 + col // 20 AS patch FROM ras WHERE value < 30), g AS (SELECT DISTINCT patch, row + dr AS row, col + dc AS col FROM pc, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dr, dc)),
    p AS (SELECT patch, count(*) AS perimeter FROM g WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.patch = g.patch AND pc.row = g.row AND pc.col = g.col) GROUP BY 1), a AS (SELECT patch, count(*) AS n_cells FROM pc GROUP BY 1)
    SELECT patch, n_cells, perimeter, round(perimeter * perimeter / (4 * pi() * n_cells), 9) AS complexity FROM a JOIN p USING (patch)""")
def patches_shapes(spark, sf_dir):
    cells = raster(spark).filter("value < 30")
    parts = cells.select("row", "col", (F.floor(F.col("row") / 20) * 10 + F.floor(F.col("col") / 20)).alias("patch"))
    return R.shape_features(parts, 0.01).select("patch", "n_cells", "perimeter", F.round("complexity", 9).alias("complexity"))


# Sources and sinks: what is written is read back, through the operators.
@query(f"""WITH {POSITIONS_SQL}, r AS (SELECT *, CASE WHEN ord % 13 = 0 THEN 'bad timestamp' WHEN ord % 17 = 0 THEN 'missing value' WHEN NOT (lat BETWEEN -90 AND 90) THEN 'bad position'
    WHEN NOT (lon BETWEEN 105e-1 AND 12e0 AND lat BETWEEN 565e-1 AND 575e-1) THEN 'outside the area' ELSE 'kept' END AS reason FROM pos) SELECT reason, count(*) AS rows FROM r GROUP BY 1""")
def external_log_drops(spark, sf_dir):
    """A CSV log with day-first times, written and read through the reader, which counts what it drops."""
    path = _shared(spark, "log")
    p = F.col
    rows = positions(spark, sf_dir).select(
        F.when(p("ord") % 13 == 0, "31/31/2024 00:00:00").otherwise(F.date_format(F.timestamp_micros("t_us"), "dd/MM/yyyy HH:mm:ss")).alias("# Timestamp"), p("mmsi").alias("MMSI"),
        F.when(p("ord") % 17 == 0, "none").otherwise(p("lat").cast("string")).alias("Latitude"), p("lon").alias("Longitude"), p("sog_kn").alias("SOG"), p("cog_deg").alias("COG"),
    )
    rows.write.option("header", True).csv(path)
    return readers.read_external_log(spark, path, (10.5, 56.5, 12.0, 57.5))[1]


@query(f"""WITH {POSITIONS_SQL}, ok AS (SELECT * FROM pos WHERE ord % 13 <> 0 AND ord % 17 <> 0 AND lat BETWEEN 565e-1 AND 575e-1 AND lon BETWEEN 105e-1 AND 12e0) SELECT mmsi, count(DISTINCT t_us) AS fixes FROM ok GROUP BY 1""")
def external_log_rows(spark, sf_dir):
    """The rows that such a log keeps, through deduplication, which takes them as they come from the reader."""
    path = _shared(spark, "log")
    p = F.col
    rows = positions(spark, sf_dir).select(
        F.when(p("ord") % 13 == 0, "31/31/2024 00:00:00").otherwise(F.date_format(F.timestamp_micros("t_us"), "dd/MM/yyyy HH:mm:ss")).alias("Timestamp"), p("mmsi").alias("mmsi"),
        F.when(p("ord") % 17 == 0, "none").otherwise(p("lat").cast("string")).alias("latitude"), p("lon").alias("longitude"), p("sog_kn").alias("sog"), p("cog_deg").alias("cog"),
    )
    rows.write.option("header", True).csv(path)
    kept, _ = readers.read_external_log(spark, path, (10.5, 56.5, 12.0, 57.5))
    return P.dedupe_keep_first(kept).groupBy("mmsi").agg(F.count("*").alias("fixes"))


@query(f"WITH {POSITIONS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY mmsi, t_us ORDER BY ord) AS nth FROM pos) SELECT ord AS k, mmsi, round(sog_kn, 9) AS sog_kn FROM d WHERE nth = 1")
def parquet_log_order(spark, sf_dir):
    """A Parquet log written in one order, read without an order column: the first of duplicates is the first of the input."""
    path = _shared(spark, "log")
    log = positions(spark, sf_dir).select(F.col("ord").alias("k"), F.timestamp_micros("t_us").alias("timestamp"), "mmsi", "lat", "lon", "sog_kn", "cog_deg")
    log.repartitionByRange(4, "k").sortWithinPartitions("k").write.parquet(path)
    return P.dedupe_keep_first(readers.read_positions(spark, path)).select("k", "mmsi", F.round("sog_kn", 9).alias("sog_kn"))


def _grid(spark, names=("time", "lat", "lon")):
    """Nodes of a grid of 0 to 360 degrees with two depths."""
    i = F.col("id")
    t, lat, lon, depth = F.floor(i / 400) % 3, F.floor(i / 20) % 20, i % 20, F.floor(i / 1200)
    return spark.range(2400).select(
        F.timestamp_micros(F.lit(EPOCH_US) + t * 3_600_000_000).alias(names[0]), (54.0 + lat * 0.25).alias(names[1]), F.pmod(357.0 + lon * 0.5, F.lit(360.0)).alias(names[2]), depth.cast("double").alias("depth"),
        (lat * 0.1 + t).alias("u"), F.when(i % 50 != 0, lon * 0.1).alias("v"),
    )


_GRID_SQL = f"""gn AS (SELECT {EPOCH_US} + (range // 400 % 3) * 3600000000 AS t_us, 54e0 + (range // 20 % 20) * 25e-2 AS latitude, CASE WHEN 357e0 + (range % 20) * 5e-1 >= 360 THEN (range % 20) * 5e-1 - 3 ELSE (range % 20) * 5e-1 - 3 END AS longitude,
    (range // 20 % 20) * 1e-1 + (range // 400 % 3) AS u, CASE WHEN range % 50 <> 0 THEN (range % 20) * 1e-1 END AS v FROM range(1200))"""


@query(f"WITH {_GRID_SQL} SELECT t_us, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(u, 6) AS u FROM gn WHERE longitude BETWEEN -5e-1 AND 35e-1 AND latitude BETWEEN 545e-1 AND 565e-1 AND t_us <= {EPOCH_US} + 3600000000")
def subset_grid(spark, sf_dir):
    """A grid of other names, longitudes from 0 to 360 and two depths, normalised and cut to a box and window with margins."""
    grid = readers.assert_regular(readers.normalise_grid(_grid(spark, ("valid_time", "lat", "x"))))
    stamp = lambda us: spark.range(1).select(F.timestamp_micros(F.lit(us)).alias("t")).first()["t"]
    out = readers.subset(grid, (0.0, 55.0, 3.0, 56.0), stamp(EPOCH_US), stamp(EPOCH_US + 3_600_000_000), 0.5, 0)
    return out.select(F.unix_micros("time").alias("t_us"), F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("u", 6).alias("u"))


@query(f"WITH {_GRID_SQL} SELECT count(*) AS nodes, round(sum(u), 6) AS u, round(sum(coalesce(v, 0)), 6) AS v, round(avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END), 9) AS missing FROM gn")
def currents_sink(spark, sf_dir):
    """Currents written with missing values as 0, and read back."""
    path = _shared(spark, "currents")
    note = sinks.write_currents(readers.normalise_grid(_grid(spark)), path, "v", "u")
    back = spark.read.parquet(path).agg(F.count("*").alias("nodes"), F.round(F.sum("u"), 6).alias("u"), F.round(F.sum("v"), 6).alias("v"))
    return back.crossJoin(note.select(F.round("missing_share", 9).alias("missing")))


@query(f"WITH {_GRID_SQL}, s AS (SELECT sqrt(u * u + 9) AS w FROM gn) SELECT count(*) AS nodes, round(min(w), 6) AS least_ms, round(max(w), 6) AS most_ms, 0e0 AS gated_share FROM s")
def wind_sink(spark, sf_dir):
    path = _shared(spark, "wind")
    note = sinks.write_wind(readers.normalise_grid(_grid(spark)).withColumn("v", F.lit(3.0)), path)
    return spark.read.parquet(path).agg(F.count("*").alias("nodes")).crossJoin(note.select(F.round("least_ms", 6).alias("least_ms"), F.round("most_ms", 6).alias("most_ms"), "gated_share"))


@query("SELECT o_orderkey % 5 AS case_id, o_custkey % 20 AS ix, CAST(floor(sum(o_totalprice)) AS BIGINT) AS w FROM orders GROUP BY 1, 2")
def posterior_sink(spark, sf_dir):
    """Posterior cells written a folder a case, and read back whole."""
    path = _shared(spark, "posterior")
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 5).alias("case_id"), (F.col("o_custkey") % 20).alias("ix")).agg(F.floor(F.sum("o_totalprice")).cast("long").alias("w"))
    sinks.write_posterior(rows, path)
    return spark.read.parquet(path).select(F.col("case_id").cast("long").alias("case_id"), "ix", "w")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def event_log_sink(spark, sf_dir):
    """Events appended as JSON lines in two writes."""
    path = _shared(spark, "events")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    sinks.append_events(rows.filter("id < 10"), path)
    sinks.append_events(rows.filter("id >= 10"), path)
    return spark.read.schema("id long, name string").json(path)


@query("""SELECT 'case_' || n_nationkey AS case_id, n_nationkey AS seed, CAST(n_nationkey AS DOUBLE) AS min_lon, 'VV' AS polarisation FROM nation""")
def manifests_back(spark, sf_dir):
    """Case manifests written as JSON and read back with their schema."""
    path = _shared(spark, "manifests")
    k = F.col("n_nationkey").cast("long")
    box = F.struct(k.cast("double").alias("min_lon"), F.lit(50.0).alias("min_lat"), (k + 1.0).alias("max_lon"), F.lit(51.0).alias("max_lat"))
    scene = F.struct(F.lit("VV").alias("polarisation"), F.lit("GRD").alias("product"), F.lit(10.0).alias("pixel_spacing_m"))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("case_"), k).alias("case_id"), k.alias("seed"), F.timestamp_micros(F.lit(EPOCH_US)).alias("t_start"), F.timestamp_micros(F.lit(EPOCH_US) + k).alias("t_obs"), box.alias("aoi"), scene.alias("scene"))
    sinks.write_manifest(rows, path)
    return spark.read.schema(C.MANIFEST).json(path).select("case_id", "seed", "aoi.min_lon", "scene.polarisation")


@query("""SELECT CAST(59 - range // 80 AS INTEGER) AS row, CAST(range % 80 AS INTEGER) AS col, 500 + (range % 80 + 5e-1) * 10 AS x, 9000 - (range // 80 + 5e-1) * 10 AS y FROM range(4800)""")
def scene_with_axes(spark, sf_dir):
    """A scene turned so that its rows count northward, with the places of its cells."""
    path = _shared(spark, "scene")
    raster(spark).write.parquet(path)
    scene = readers.scene_axes(readers.read_scene(spark, path, 60), (10.0, 0.0, 500.0, 0.0, -10.0, 9000.0), 60)
    return scene.select("row", "col", "x", "y")


_PIXELS_SQL = "px AS (SELECT l_suppkey AS tile, CASE WHEN l_linenumber % 2 = 0 THEN 'vv' ELSE 'vh' END AS band, l_orderkey AS row, l_linenumber AS col, l_quantity - 25 AS value FROM lineitem)"


@query(f"WITH {_PIXELS_SQL} SELECT 'tile' AS part, count(*) AS n, round(sum(value), 6) AS total FROM px WHERE tile = 3 AND band = 'vv' UNION ALL SELECT 'mask', count(*), 0e0 FROM px WHERE tile = 3 AND value > 0")
def tile_and_mask(spark, sf_dir):
    """One band of a tile, and its mask."""
    p = F.col
    pixels = table(spark, sf_dir, "lineitem").select(p("l_suppkey").alias("tile"), F.when(p("l_linenumber") % 2 == 0, "vv").otherwise("vh").alias("band"), p("l_orderkey").alias("row"), p("l_linenumber").alias("col"), (p("l_quantity") - 25).alias("value"))
    tile = readers.load_tile(pixels, 3).agg(F.lit("tile").alias("part"), F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return tile.unionByName(readers.load_mask(pixels, 3).agg(F.lit("mask").alias("part"), F.count("*").alias("n"), F.lit(0.0).alias("total")))


@query("SELECT event_id, CAST(ts AS VARCHAR) AS stored FROM events")
def storage_times(spark, sf_dir):
    """Instants as UTC times without a zone."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    out = sinks.to_storage_time(rows, "t")
    text = F.date_format(F.col("t"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.select("event_id", F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "").alias("stored"))


# A field that is read from grids, and trails through it.
def _read_field(spark, u: float, v: float, uw: float, vw: float, hours: int = 24):
    i = F.col("id")
    at = lambda n, u_, v_: spark.range(n * n * (hours + 1)).select(
        F.timestamp_micros(F.lit(EPOCH_US) + F.floor(i / (n * n)) * 3_600_000_000).alias("time"), (55.0 + F.floor(i / n) % n * (2.0 / (n - 1))).alias("latitude"), (8.0 + i % n * (2.0 / (n - 1))).alias("longitude"), F.lit(u_).alias("u"), F.lit(v_).alias("v"))
    return X.field_from_grids(at(9, u, v), at(5, uw, vw), None, 32, 480_000.0, 6_150_000.0, 2000.0, 20, 20)


@query("""SELECT o_orderkey AS particle_id, CAST(h * 10800 AS DOUBLE) AS t, CAST(CASE WHEN o_orderkey % 2 = 1 AND h = 0 THEN 0 ELSE 1 END AS TINYINT) AS status,
    round(490000 + o_orderkey % 10 * 100 + 25e-2 * greatest(h * 10800 - CASE WHEN o_orderkey % 2 = 1 THEN 2700 ELSE 0 END, 0), 0) AS x FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) o CROSS JOIN (SELECT range AS h FROM range(5)) r""")
def trails_of_read_field(spark, sf_dir):
    """Currents and winds read as grids become a field, and the first fifty particles leave trails in it: at the central meridian an eastward
    flow runs along the grid. The 50 are the feature: trails are shown for the first of a run."""
    field = _read_field(spark, 0.15, 0.0, 4.0, 0.0)
    field = X.Field(**{**field.__dict__, "v": np.zeros_like(field.v), "vw": np.zeros_like(field.vw), "u": np.full_like(field.u, float(np.round(field.u.mean(), 3))), "uw": np.full_like(field.uw, float(np.round(field.uw.mean(), 2)))})
    k = F.col("o_orderkey")
    seeds = table(spark, sf_dir, "orders").select(k.alias("particle_id"), F.lit(0).cast("long").alias("origin"), (490_000.0 + k % 10 * 100).alias("x"), F.lit(6_170_000.0).alias("y"), F.when(k % 2 == 1, 3600.0).otherwise(0.0).alias("seed_time"))
    out = X.trails(seeds, field, 0.0, [10_800.0 * h for h in range(1, 5)], X.TransportParams(alpha=(0.025, 0.025), diffusion=False), first=50)
    return out.select("particle_id", "t", "status", F.round("x", 0).alias("x"))


@query("SELECT 20 AS nx, 20 AS ny, 25 AS hours, TRUE AS speed_kept, TRUE AS turned_little, 3600e0 AS dt")
def field_from_grids(spark, sf_dir):
    """Uniform true-east flow on a metric grid within a degree of the central meridian: the speed stays, the direction turns by the convergence, at most a degree."""
    field = _read_field(spark, 0.3, 0.0, 6.0, 0.0)
    speed, turn = np.hypot(field.u, field.v), np.degrees(np.abs(np.arctan2(field.v, field.u)))
    return spark.createDataFrame([(field.land.shape[1], field.land.shape[0], len(field.u), bool(np.allclose(speed, 0.3, atol=1e-6)), bool(0 < turn.max() < 1.0), field.dt)], "nx int, ny int, hours int, speed_kept boolean, turned_little boolean, dt double")


@query("SELECT x.range AS ix, y.range AS iy, round(2e0 * x.range + 3e0 * y.range + 100 * t.range, 6) AS u, t.range AS t FROM range(12) x, range(9) y, range(3) t")
def resample_times(spark, sf_dir):
    """Planes resampled time by time: a plane comes back as it was, and goes on beyond the grid."""
    i = F.col("id")
    grid = spark.range(4 * 4 * 3).select((i % 4).cast("int").alias("ix"), (F.floor(i / 4) % 4).cast("int").alias("iy"), F.floor(i / 16).alias("t"))
    grid = grid.withColumn("u", 2.0 * (F.col("ix") * 2 + 2) + 3.0 * (F.col("iy") * 2 + 1) + 100 * F.col("t"))
    points = spark.range(12 * 9 * 3).select((i % 12).cast("double").alias("x"), (F.floor(i / 12) % 9).cast("double").alias("y"), F.floor(i / 108).alias("t"))
    out = S.resample(points, grid, ["u"], 2.0, 1.0, 2.0, 2.0, 4, 4, keys=["t"])
    return out.select(F.col("x").cast("long").alias("ix"), F.col("y").cast("long").alias("iy"), F.round("u", 6).alias("u"), "t")


@query(f"""WITH {POSITIONS_SQL}, v AS (SELECT mmsi, t_us FROM pos WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180), b AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY mmsi ORDER BY t_us) > 86400000000 THEN 1 ELSE 0 END AS opens FROM v),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY mmsi ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS track FROM b) SELECT mmsi, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_fixes FROM s GROUP BY mmsi, track""")
def session_stream_rows(spark, sf_dir):
    """The sessions of the streaming form, against a batch over the same log: a silence longer than the gap parts them."""
    from tidemark.plans.pipelines import session_stream

    out = session_stream(spark, sf_dir)
    return out.select("mmsi", F.unix_micros("t_start").alias("start_us"), F.unix_micros("t_end").alias("end_us"), "n_fixes")


@query(f"WITH {TRACKS_SQL} SELECT mmsi, CAST(row_number() OVER (ORDER BY n DESC, mmsi) AS INTEGER) AS nth FROM (SELECT mmsi, count(*) AS n FROM tr GROUP BY 1) x ORDER BY n DESC, mmsi LIMIT 5")
def longest_logs(spark, sf_dir):
    """The five vessels of most fixes; a top-k report."""
    counts = tracks_of(spark, sf_dir).groupBy("mmsi").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "mmsi").limit(5)
    return best.select("mmsi", F.row_number().over(Window.orderBy(F.desc("n"), "mmsi")).alias("nth"))  # five rows
