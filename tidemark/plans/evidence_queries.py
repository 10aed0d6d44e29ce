"""Queries over evidence factors, the gate, text rules and the Bayesian combination."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evidence as E
from tidemark.operators import positions as P
from tidemark.operators import posterior as Q
from tidemark.operators import temporal as T
from tidemark.plans.tables import PARAMS, POSITIONS_SQL, TRACKS_SQL, candidate_scores, patches, positions, table
from tidemark.plans.track_queries import WINDOWS_SQL, tracks_of, windows_of

H = P.HOUR_US
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


GAP_HOURS_SQL = f"""gh AS (SELECT w.mmsi, w.track, coalesce(sum(greatest(0, least(gap_end, w_to) - greatest(gap_start, w_from))), 0) / {H}e0 AS observed
    FROM wn w LEFT JOIN gp g ON w.mmsi = g.mmsi AND w.track = g.track GROUP BY 1, 2),
bs AS (SELECT median(m) / {H}e0 AS baseline FROM (SELECT max(CASE WHEN step_us > {6 * H} THEN step_us ELSE 0 END) AS m FROM st GROUP BY mmsi, track) x)"""
GAP_FACTOR_SQL = "CASE WHEN observed <= 0 THEN 1e0 ELSE least(greatest(1e0 + 6e-1 * ln(1 + greatest(observed / greatest(baseline, 25e-2) - 1e0, 0e0)), 1e0), 3e0) END"


@query(f"WITH {TRACKS_SQL}, {WINDOWS_SQL}, {GAP_HOURS_SQL} SELECT mmsi, track, round({GAP_FACTOR_SQL}, 6) AS gap_factor FROM gh, bs")
def gap_factor(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    observed = T.gap_overlap(P.gaps(tracks, PARAMS.gap_threshold_hours), windows_of(tracks))
    rows = observed.crossJoin(F.broadcast(P.baseline_gap(tracks, PARAMS.gap_threshold_hours)))  # one row
    return rows.select("mmsi", "track", F.round(E.gap_factor(F.col("gap_hours"), F.col("baseline_us") / H), 6).alias("gap_factor"))


SPEED_SQL = """ws AS (SELECT w.mmsi, w.track, median(t.sog_kn) AS s FROM wn w LEFT JOIN tr t ON w.mmsi = t.mmsi AND w.track = t.track AND t.t_us BETWEEN w_from AND w_to GROUP BY 1, 2),
tm AS (SELECT mmsi, track, median(sog_kn) AS m, min(ship_type) AS ship_type FROM tr GROUP BY 1, 2)"""
SPEED_FACTOR_SQL = "CASE WHEN s IS NULL OR m IS NULL OR m <= 5e-1 OR s / m >= 75e-2 THEN 1e0 ELSE least(greatest(1e0 + 1.4e0 * (75e-2 - s / m), 1e0), 2e0) END"


@query(f"WITH {TRACKS_SQL}, {WINDOWS_SQL}, {SPEED_SQL} SELECT mmsi, track, round({SPEED_FACTOR_SQL}, 6) AS speed_factor FROM ws JOIN tm USING (mmsi, track)")
def speed_factor(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    rows = T.window_speed(tracks, windows_of(tracks)).join(tracks.groupBy("mmsi", "track").agg(F.median("sog_kn").alias("transit_kn")), ["mmsi", "track"])
    return rows.select("mmsi", "track", F.round(E.speed_factor(F.col("speed_kn"), F.col("transit_kn")), 6).alias("speed_factor"))


@query(f"WITH {POSITIONS_SQL} SELECT ord, round(CASE WHEN cog_deg / 2 < 20 THEN 1e0 ELSE least(greatest(1e0 + cog_deg / 2 / 240, 1e0), 15e-1) END, 6) AS course_factor FROM pos")
def course_factor(spark, sf_dir):
    return positions(spark, sf_dir).select("ord", F.round(E.course_factor(F.col("cog_deg") / 2), 6).alias("course_factor"))


_TYPES = "CASE ship_type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in E.TYPE_PRIOR.items()) + " ELSE 1e0 END"


@query(f"WITH {POSITIONS_SQL} SELECT ord, ship_type, {_TYPES} AS type_factor FROM pos")
def type_factor(spark, sf_dir):
    return E.type_factor(positions(spark, sf_dir)).select("ord", "ship_type", "type_factor")


_FOLD = "abs(((({a}) % 180) + 180) % 180 - 90)"
_OFF = _FOLD.format(a="cog_deg - 30 + 90")
_ALIGN = f"CASE WHEN {_OFF} > 75 THEN 1e0 ELSE least(greatest(1e0 + 2e0 * exp(-pow({_OFF} / 25, 2)), 1e0), 3e0) END"


@query(f"WITH {POSITIONS_SQL} SELECT ord, round({_ALIGN}, 6) AS alignment_factor FROM pos")
def alignment_factor(spark, sf_dir):
    return positions(spark, sf_dir).select("ord", F.round(E.alignment_factor(F.col("cog_deg"), F.lit(30.0)), 6).alias("alignment_factor"))


@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL}, {GAP_HOURS_SQL}, {SPEED_SQL} SELECT mmsi, track, round(({GAP_FACTOR_SQL}) * ({SPEED_FACTOR_SQL}) * ({_TYPES}), 6) AS prior
    FROM gh JOIN ws USING (mmsi, track) JOIN tm USING (mmsi, track), bs""")
def behavioural_prior(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    windows = windows_of(tracks)
    keys = ["mmsi", "track"]
    rows = T.gap_overlap(P.gaps(tracks, PARAMS.gap_threshold_hours), windows).select(*keys, "gap_hours")
    rows = rows.join(T.window_speed(tracks, windows).select(*keys, "speed_kn"), keys)
    rows = rows.join(tracks.groupBy(*keys).agg(F.median("sog_kn").alias("transit_kn"), F.min("ship_type").alias("ship_type")), keys)
    rows = E.type_factor(rows.crossJoin(F.broadcast(P.baseline_gap(tracks, PARAMS.gap_threshold_hours))))
    prior = E.behavioural_prior(E.gap_factor(F.col("gap_hours"), F.col("baseline_us") / H), E.speed_factor(F.col("speed_kn"), F.col("transit_kn")), F.col("type_factor"))
    return rows.select(*keys, F.round(prior, 6).alias("prior"))


SCORES_SQL = "sc AS (SELECT l_suppkey AS mover, month(l_shipdate) AS bin, -sum(l_quantity) / 500.0 AS ll FROM lineitem GROUP BY 1, 2)"
MARGINAL_SQL = f"""{SCORES_SQL}, tp AS (SELECT *, max(ll) OVER (PARTITION BY mover) AS top FROM sc),
mg AS (SELECT mover, max(top) + ln(sum(exp(ll - top))) - ln(count(*)) AS lm, arg_min(bin, (-ll, bin)) AS best FROM tp GROUP BY 1)"""
MARGINAL_SQL = f"""{SCORES_SQL}, tp AS (SELECT *, max(ll) OVER (PARTITION BY mover) AS top, row_number() OVER (PARTITION BY mover ORDER BY ll DESC, bin) AS nth FROM sc),
mg AS (SELECT mover, max(top) + ln(sum(exp(ll - top))) - ln(count(*)) AS lm, max(CASE WHEN nth = 1 THEN bin END) AS best FROM tp GROUP BY 1)"""


@query(f"WITH {MARGINAL_SQL} SELECT mover, round(lm, 6) AS log_marginal, CAST(best AS INTEGER) AS best_window FROM mg")
def logsumexp_windows(spark, sf_dir):
    out = E.marginalise(candidate_scores(spark, sf_dir), ["mover"], "ll", "bin")
    return out.select("mover", F.round("log_marginal", 6).alias("log_marginal"), "best_window")


DARK_LM, DARK_PRIOR = -3.0, 0.15
COMBINE_SQL = f"""{MARGINAL_SQL}, pr AS (SELECT mover, lm, best, 1e0 + (mover % 5) * 3e-1 AS prior FROM mg),
sh AS (SELECT greatest(max(lm), {DARK_LM}) AS shift, sum(prior) AS ps FROM pr),
ww AS (SELECT pr.*, 85e-2 * prior / ps * exp(lm - shift) AS w, 15e-2 * exp({DARK_LM} - shift) AS dw FROM pr, sh),
pp AS (SELECT mover, best, w / (sum(w) OVER () + dw) AS p, dw / (sum(w) OVER () + dw) AS dark FROM ww)"""


def combined(spark, sf_dir):
    rows = E.marginalise(candidate_scores(spark, sf_dir), ["mover"], "ll", "bin").withColumn("prior", 1.0 + (F.col("mover") % 5) * 0.3)
    return E.combine(rows, DARK_LM, DARK_PRIOR)


@query(f"WITH {COMBINE_SQL} SELECT mover, round(p, 9) AS probability, round(dark, 9) AS dark_probability FROM pp")
def posterior_combine(spark, sf_dir):
    return combined(spark, sf_dir).select("mover", F.round("probability", 9).alias("probability"), F.round("dark_probability", 9).alias("dark_probability"))


@query(f"WITH {COMBINE_SQL} SELECT mover, CAST(row_number() OVER (ORDER BY round(p, 12) DESC, mover) AS INTEGER) AS rank, round(p, 9) AS probability FROM pp")
def ranked_candidates(spark, sf_dir):
    ranked = E.rank(combined(spark, sf_dir).withColumn("probability", F.round("probability", 12)), ["mover"])
    return E.rebalance(ranked, drift=1e-9).select("mover", "rank", F.round("probability", 9).alias("probability"))


@query(f"""WITH {COMBINE_SQL} SELECT count(*) AS in_window, count(CASE WHEN mover % 3 <> 0 THEN 1 END) AS prefiltered, count(CASE WHEN mover % 3 <> 0 AND mover % 5 = 0 THEN 1 END) AS reported,
    count(*) / CAST(greatest(count(CASE WHEN mover % 3 <> 0 AND mover % 5 = 0 THEN 1 END), 1) AS DOUBLE) AS reduction_factor FROM pp""")
def traffic_reduction(spark, sf_dir):
    kept = F.col("mover") % 3 != 0
    return E.traffic_reduction(combined(spark, sf_dir), kept & (F.col("mover") % 5 == 0), kept)


@query(f"""WITH {COMBINE_SQL}, tops AS (SELECT 'mover ' || mover AS name, p FROM (SELECT *, row_number() OVER (ORDER BY round(p, 12) DESC, mover) AS nth FROM pp) x WHERE nth <= 3)
    SELECT name, round(p, 9) AS probability FROM tops UNION ALL SELECT 'not transmitting', round(max(dark), 9) FROM pp""")
def top_three_and_dark(spark, sf_dir):
    """The three most probable candidates beside the source that does not transmit; a top-k report."""
    rows = combined(spark, sf_dir)
    best = rows.orderBy(F.desc(F.round("probability", 12)), "mover").limit(3).select(F.concat(F.lit("mover "), "mover").alias("name"), "probability")
    dark = rows.agg(F.max("dark_probability").alias("probability")).select(F.lit("not transmitting").alias("name"), "probability")
    return best.unionByName(dark).select("name", F.round("probability", 9).alias("probability"))


PATCH_SQL = """pt AS (SELECT p_partkey AS patch, CAST(p_size AS DOUBLE) * 3e-1 AS wind, (p_retailprice % 100) / 200 AS damping, 5e-1 + CAST(p_size AS DOUBLE) / 25 AS gradient_ratio,
    1e0 + (p_partkey % 60) / 1e1 AS elongation, (p_partkey % 13) / 1e2 AS wind_gradient, 7e-1 + (p_partkey % 30) / 1e2 AS solidity,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 90 AS DOUBLE) END AS offset_deg, p_partkey % 3 + 1 AS n_components FROM part)"""
PROBABILITY_SQL = """1 / (1 + exp(-(1.2e0 * tanh(greatest(damping, 0e0) / 35e-2) + 9e-1 * tanh(gradient_ratio - 1) + 6e-1 * tanh((elongation - 2) / 2)
    - 1.1e0 * tanh(wind_gradient / 5e-2) - 5e-1 * tanh((solidity - 85e-2) / 1e-1))))"""


def _probability():
    return E.oil_probability(*(F.col(c) for c in ("damping", "gradient_ratio", "elongation", "wind_gradient", "solidity")))


@query(f"""WITH {PATCH_SQL} SELECT patch, CASE WHEN wind < 3 THEN 'Wind ' || printf('%.1f', wind) || ' m/s is below the 3 m/s threshold. Outside detectability window.'
    WHEN wind > 12 THEN 'Wind ' || printf('%.1f', wind) || ' m/s is above the 12 m/s threshold. Outside detectability window.' END AS reason FROM pt""")
def wind_gate(spark, sf_dir):
    return patches(spark, sf_dir).select("patch", E.wind_gate(F.col("wind")).alias("reason"))


@query(f"""WITH {PATCH_SQL} SELECT patch, round({PROBABILITY_SQL}, 9) AS probability,
    CASE WHEN wind < 3 OR wind > 12 THEN 'undetermined' WHEN {PROBABILITY_SQL} >= 5e-1 THEN 'oil' ELSE 'look_alike' END AS class FROM pt""")
def rule_classifier(spark, sf_dir):
    rows = patches(spark, sf_dir).withColumn("p", _probability())
    return rows.select("patch", F.round("p", 9).alias("probability"), E.classify(F.col("wind"), F.col("p")).alias("class"))


@query(f"""WITH {PATCH_SQL} SELECT patch, CASE WHEN elongation >= 4 AND offset_deg <= 15 THEN 'continuous' WHEN elongation < 4 AND elongation <= 25e-1 AND n_components = 1 THEN 'instantaneous'
    ELSE 'indeterminate' END AS mode FROM pt""")
def release_mode(spark, sf_dir):
    return patches(spark, sf_dir).select("patch", E.release_mode(F.col("elongation"), F.col("offset_deg"), F.col("n_components")).alias("mode"))


@query(f"""WITH {PATCH_SQL}, cl AS (SELECT CASE WHEN wind < 3 OR wind > 12 THEN 'undetermined' WHEN {PROBABILITY_SQL} >= 5e-1 THEN 'oil' ELSE 'look_alike' END AS class FROM pt)
    SELECT count(*) AS patches, count(CASE WHEN class = 'oil' THEN 1 END) AS actionable, count(CASE WHEN class = 'undetermined' THEN 1 END) AS abstained,
    round(count(CASE WHEN class = 'undetermined' THEN 1 END) / CAST(count(*) AS DOUBLE), 9) AS abstention_rate FROM cl""")
def detection_counts(spark, sf_dir):
    rows = patches(spark, sf_dir).select(E.classify(F.col("wind"), _probability()).alias("class"))
    out = rows.agg(F.count("*").alias("patches"), F.count_if(F.col("class") == "oil").alias("actionable"), F.count_if(F.col("class") == "undetermined").alias("abstained"))
    return out.withColumn("abstention_rate", F.round(F.try_divide("abstained", "patches"), 9))


_BANNED = " OR ".join(f"contains(t, '{x}')" for x in E.BANNED_TERMS)
_WORDED = "CASE WHEN doc_id % 50 = 0 THEN text || ' Responsible FOR it' WHEN doc_id % 70 = 0 THEN text || ' CULPRIT' ELSE text END"


@query(f"SELECT doc_id, {_BANNED} AS banned FROM (SELECT doc_id, lower({_WORDED}) AS t FROM documents) d")
def banned_language(spark, sf_dir):
    """Whole texts against the list of wording; some get a planted phrase, as the corpus holds none."""
    text = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" Responsible FOR it"))).when(F.col("doc_id") % 70 == 0, F.concat("text", F.lit(" CULPRIT"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", E.has_banned_language(text).alias("banned"))


@query(f"WITH {SCORES_SQL}, k AS (SELECT greatest(4, CAST(round_even(count(*) * 1e-1, 0) AS BIGINT)) AS n FROM sc), r AS (SELECT *, row_number() OVER (ORDER BY ll DESC, mover * 100 + bin) AS nth FROM sc) SELECT mover, bin FROM r, k WHERE nth <= n")
def keep_best_fraction(spark, sf_dir):
    rows = candidate_scores(spark, sf_dir).withColumn("key", F.col("mover") * 100 + F.col("bin"))
    return Q.keep_best(rows, 0.1, "ll", "key").select("mover", F.col("bin").cast("long").alias("bin"))
