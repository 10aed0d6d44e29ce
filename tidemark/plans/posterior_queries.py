"""Queries over hypothesis scores, posterior grids and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import posterior as Q
from tidemark.operators import spatial as S
from tidemark.plans.tables import mask, particles, posterior_cells

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


PARTICLES_SQL = """pa AS (SELECT l_suppkey % 32 AS hyp, l_partkey % 40 AS ix, l_orderkey % 30 AS iy, l_linenumber % 7 <> 0 AS usable FROM lineitem),
cl AS (SELECT x.range AS ix, y.range AS iy, CASE WHEN x.range BETWEEN 10 AND 19 AND y.range BETWEEN 8 AND 15 THEN 'oil' WHEN x.range BETWEEN 9 AND 20 AND y.range BETWEEN 7 AND 16 THEN 'annulus' END AS state
    FROM range(40) x CROSS JOIN range(30) y)"""

LOGLIK_SQL = f"""{PARTICLES_SQL}, hy AS (SELECT hyp, CAST(count(CASE WHEN usable THEN 1 END) AS DOUBLE) AS n FROM pa GROUP BY 1),
oc AS (SELECT hyp, ix, iy, count(CASE WHEN usable THEN 1 END) AS c FROM pa GROUP BY 1, 2, 3),
oil AS (SELECT ix, iy FROM cl WHERE state = 'oil'),
full_ AS (SELECT hy.hyp, hy.n, coalesce(oc.c, 0) AS c FROM hy CROSS JOIN oil LEFT JOIN oc ON oc.hyp = hy.hyp AND oc.ix = oil.ix AND oc.iy = oil.iy),
pos_t AS (SELECT hyp, max(n) AS n, sum(ln(1e-2 + 99e-2 * (1 - exp(-25e-1 * c * 80 / n)))) AS t, count(CASE WHEN c > 0 THEN 1 END) / 8e1 AS coverage FROM full_ GROUP BY 1),
sp AS (SELECT oc.hyp, sum(oc.c) AS outside FROM oc LEFT JOIN cl ON cl.ix = oc.ix AND cl.iy = oc.iy WHERE cl.state IS NULL GROUP BY 1),
ll AS (SELECT p.hyp, CAST(p.n AS BIGINT) AS n, p.coverage, coalesce(s.outside, 0) / p.n AS spill, (p.t - 25e-1 * coalesce(s.outside, 0) / p.n * 80) * (8e0 / 80) AS log_lik FROM pos_t p LEFT JOIN sp s USING (hyp))"""


def scores(spark, sf_dir):
    return Q.bernoulli_loglik(particles(spark, sf_dir), mask(spark), n_effective=8.0)


@query(f"WITH {LOGLIK_SQL} SELECT hyp, n, round(coverage, 6) AS coverage, round(spill, 6) AS spill, round(log_lik, 6) AS log_lik FROM ll")
def bernoulli_loglik(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return scores(spark, sf_dir).select("hyp", "n", r("coverage"), r("spill"), r("log_lik"))


SOFTMAX_SQL = f"{LOGLIK_SQL}, sm AS (SELECT hyp, exp(log_lik - (SELECT max(log_lik) FROM ll)) AS e FROM ll), wt AS (SELECT hyp, e / (SELECT sum(e) FROM sm) AS weight FROM sm)"


@query(f"WITH {SOFTMAX_SQL} SELECT hyp, round(weight, 9) AS weight FROM wt")
def softmax_weights(spark, sf_dir):
    return Q.softmax(scores(spark, sf_dir)).select("hyp", F.round("weight", 9).alias("weight"))


@query(f"WITH {SOFTMAX_SQL} SELECT round(100 / sum(weight * weight), 6) AS ess FROM wt")
def effective_sample_size(spark, sf_dir):
    return Q.effective_sample_size(Q.softmax(scores(spark, sf_dir)), 100).select(F.round("ess", 6).alias("ess"))


@query("SELECT least(greatest(80 * 25e-2 / pow(9e3 / 1000, 2), 1), 80) AS n_effective")
def effective_cells(spark, sf_dir):
    cells = mask(spark).filter("state = 'oil'").agg(F.count("*").alias("n"))
    return cells.select(Q.effective_cells(F.col("n"), F.lit(0.25), 9000.0).alias("n_effective"))


CELLS_SQL = "pc AS (SELECT month(o_orderdate) AS it, (o_custkey // 40) % 30 AS iy, o_custkey % 40 AS ix, CAST(floor(o_totalprice) AS BIGINT) AS weight FROM orders)"


@query(f"WITH {CELLS_SQL} SELECT CAST(it AS BIGINT) AS it, iy, ix, CAST(sum(weight) AS BIGINT) AS w FROM pc GROUP BY 1, 2, 3")
def weighted_histogram(spark, sf_dir):
    return Q.density(posterior_cells(spark, sf_dir).withColumn("it", F.col("it").cast("long")), ["it", "iy", "ix"])


@query(f"""WITH {CELLS_SQL} SELECT 'space' AS axis, NULL::INTEGER AS it, iy, ix, CAST(sum(weight) AS BIGINT) AS w FROM pc GROUP BY iy, ix
    UNION ALL SELECT 'time', CAST(it AS INTEGER), NULL, NULL, CAST(sum(weight) AS BIGINT) FROM pc GROUP BY it""")
def spatial_time_marginals(spark, sf_dir):
    return Q.marginals(posterior_cells(spark, sf_dir))


def _hdr(level: str, order: str = "iy, ix", source: str = "sw") -> str:
    return f"(SELECT * FROM (SELECT *, sum(w) OVER (ORDER BY w DESC, {order} ROWS UNBOUNDED PRECEDING) - w AS before, sum(w) OVER () AS total, row_number() OVER (ORDER BY w DESC, {order}) AS nth FROM {source}) x WHERE before < {level} * total)"


SPACE_SQL = f"{CELLS_SQL}, sw AS (SELECT iy, ix, CAST(sum(weight) AS BIGINT) AS w FROM pc GROUP BY 1, 2), tw AS (SELECT CAST(it AS BIGINT) AS it, CAST(sum(weight) AS BIGINT) AS w FROM pc GROUP BY 1)"


@query(f"WITH {SPACE_SQL} SELECT iy, ix, w, nth AS hd_rank FROM {_hdr('95e-2')} h")
def hdr_cells(spark, sf_dir):
    return Q.highest_density(Q.density(posterior_cells(spark, sf_dir), ["iy", "ix"]), 0.95, ["iy", "ix"]).withColumn("hd_rank", F.col("hd_rank").cast("long"))


@query(f"WITH {SPACE_SQL} SELECT min(it) AS first_it, max(it) AS last_it FROM {_hdr('95e-2', 'it', 'tw')} h")
def time_interval(spark, sf_dir):
    kept = Q.highest_density(Q.density(posterior_cells(spark, sf_dir), ["it"]), 0.95, ["it"])
    return kept.agg(F.min("it").cast("long").alias("first_it"), F.max("it").cast("long").alias("last_it"))


@query(f"WITH {SPACE_SQL}, o AS {_hdr('95e-2')}, i AS {_hdr('5e-1')} SELECT iy, ix, nth <= CASE WHEN (SELECT count(*) FROM i) >= (SELECT count(*) FROM o) THEN greatest((SELECT count(*) FROM o) - 1, 1) ELSE (SELECT count(*) FROM i) END AS in_inner FROM o")
def nested_regions(spark, sf_dir):
    return Q.nested_levels(Q.density(posterior_cells(spark, sf_dir), ["iy", "ix"]), 0.5, 0.95, ["iy", "ix"]).select("iy", "ix", "in_inner")


@query(f"WITH {SPACE_SQL}, o AS {_hdr('95e-2')} SELECT round(sum(pow(11132e-2, 2) * 5e-2 * 4e-2 * cos(radians(56 + iy * 4e-2))), 6) AS area_km2, count(*) AS cells FROM o")
def region_area(spark, sf_dir):
    from tidemark.functions.geo import cell_area_km2

    kept = Q.highest_density(Q.density(posterior_cells(spark, sf_dir), ["iy", "ix"]), 0.95, ["iy", "ix"])
    return kept.agg(F.round(F.sum(cell_area_km2(56 + F.col("iy") * 0.04, 0.05, 0.04)), 6).alias("area_km2"), F.count("*").alias("cells"))


@query(f"WITH {SPACE_SQL} SELECT iy, ix, round(w / CAST((SELECT max(w) FROM sw) AS DOUBLE), 9) AS share FROM sw WHERE w / CAST((SELECT max(w) FROM sw) AS DOUBLE) >= 5e-1")
def exported_cells(spark, sf_dir):
    return Q.peak_normalised(Q.density(posterior_cells(spark, sf_dir), ["iy", "ix"]), 0.5).select("iy", "ix", F.round("share", 9).alias("share"))


@query(f"""WITH {PARTICLES_SQL} SELECT state, count(*) AS n FROM (SELECT CASE WHEN cl.state IS NULL THEN 'neither' ELSE cl.state END AS state FROM pa LEFT JOIN cl ON pa.ix = cl.ix AND pa.iy = cl.iy) x GROUP BY 1""")
def mask_states(spark, sf_dir):
    rows = particles(spark, sf_dir).join(F.broadcast(mask(spark)), ["ix", "iy"], "left")
    return rows.groupBy(F.coalesce("state", F.lit("neither")).alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT hyp, child, round(x + (CASE WHEN child < 2 THEN -25e-2 ELSE 25e-2 END) * 4, 6) AS x, round(y + (CASE WHEN child % 2 = 0 THEN -25e-2 ELSE 25e-2 END) * 4, 6) AS y, t0
    FROM (SELECT s_suppkey AS hyp, s_acctbal AS x, s_acctbal / 2 AS y, s_nationkey AS t0 FROM supplier) s CROSS JOIN (SELECT CAST(range AS INTEGER) AS child FROM range(4)) c""")
def refine_hypotheses(spark, sf_dir):
    from tidemark.plans.tables import table

    parents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hyp"), F.col("s_acctbal").alias("x"), (F.col("s_acctbal") / 2).alias("y"), F.col("s_nationkey").alias("t0"))
    return Q.refine(parents, 4.0).select("hyp", "child", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "t0")


GRID_SQL = "gr AS (SELECT CAST(x.range AS INTEGER) AS ix, CAST(y.range AS INTEGER) AS iy, sin(x.range * 3e-1) + y.range * 1e-1 AS u, cos(y.range * 2e-1) - x.range * 5e-2 AS v FROM range(40) x CROSS JOIN range(30) y)"
PROBES_SQL = "pb AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_partkey % 4200) / 1e2 - 1 AS x, (l_suppkey % 3200) / 1e2 - 1 AS y FROM lineitem)"


@query(f"""WITH {GRID_SQL}, {PROBES_SQL}, f AS (SELECT *, least(greatest(x, 0e0), 38999e-3) AS fx, least(greatest(y, 0e0), 28999e-3) AS fy FROM pb),
    c AS (SELECT *, CAST(floor(fx) AS INTEGER) AS ix, CAST(floor(fy) AS INTEGER) AS iy, fx - floor(fx) AS a, fy - floor(fy) AS b FROM f)
    SELECT c.id, round((g00.u * (1 - a) + g01.u * a) * (1 - b) + (g10.u * (1 - a) + g11.u * a) * b, 6) AS u, round((g00.v * (1 - a) + g01.v * a) * (1 - b) + (g10.v * (1 - a) + g11.v * a) * b, 6) AS v
    FROM c JOIN gr g00 ON g00.ix = c.ix AND g00.iy = c.iy JOIN gr g01 ON g01.ix = c.ix + 1 AND g01.iy = c.iy JOIN gr g10 ON g10.ix = c.ix AND g10.iy = c.iy + 1 JOIN gr g11 ON g11.ix = c.ix + 1 AND g11.iy = c.iy + 1""")
def bilinear_lookup(spark, sf_dir):
    from tidemark.plans.tables import table

    x, y = F.col("ix"), F.col("iy")
    grid = spark.range(1200).select((F.col("id") % 40).cast("int").alias("ix"), F.floor(F.col("id") / 40).cast("int").alias("iy"))
    grid = grid.select("ix", "iy", (F.sin(x * 0.3) + y * 0.1).alias("u"), (F.cos(y * 0.2) - x * 0.05).alias("v"))
    probes = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_partkey") % 4200) / 100 - 1).alias("x"), ((F.col("l_suppkey") % 3200) / 100 - 1).alias("y"))
    out = S.bilinear(probes, grid, ["u", "v"], 0.0, 0.0, 1.0, 1.0, 40, 30)
    return out.select("id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CAST(least(greatest(trunc(((l_partkey % 500) - 50) / 1e1), 0), 39) AS INTEGER) AS cell FROM lineitem""")
def cell_assign(spark, sf_dir):
    from tidemark.plans.tables import table

    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), S.cell_of(((F.col("l_partkey") % 500) - 50) / 10, 0.0, 1.0, 40).alias("cell"))


@query("""SELECT event_id, CAST(least(floor(a), 718) AS INTEGER) AS k, round(a - least(floor(a), 718), 6) AS share FROM
    (SELECT event_id, least(greatest((epoch_us(ts) - 1704067200000000) / 3.6e9, 0e0), 719e0) AS a FROM events) e""")
def time_bracket(spark, sf_dir):
    from tidemark.plans.tables import table

    rows = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return S.time_bracket(rows, "t", 1_704_067_200_000_000, 3_600_000_000, 720).select("event_id", "k", F.round("share", 6).alias("share"))
