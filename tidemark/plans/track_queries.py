"""Queries over the position log: cleaning, tracks, silences and time-series joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import positions as P
from tidemark.operators import spatial as S
from tidemark.operators import temporal as T
from tidemark.plans.tables import HAVERSINE_SQL, PARAMS, RING, TRACKS_SQL, POSITIONS_SQL, positions

H = P.HOUR_US
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def tracks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reconstruct(positions(spark, sf_dir), PARAMS)


def windows_of(tracks: DataFrame) -> DataFrame:
    """One window a track: the second quarter of its span."""
    spans = tracks.groupBy("mmsi", "track").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    quarter = F.floor((F.col("b") - F.col("a")) / 4).cast("long")
    return spans.select("mmsi", "track", (F.col("a") + quarter).alias("w_from"), (F.col("a") + 2 * quarter).alias("w_to"))


WINDOWS_SQL = """
sn AS (SELECT mmsi, track, min(t_us) AS a, max(t_us) AS b FROM tr GROUP BY 1, 2),
wn AS (SELECT mmsi, track, a + (b - a) // 4 AS w_from, a + 2 * ((b - a) // 4) AS w_to, (a + b) // 2 AS t_mid FROM sn)"""


@query(f"""WITH {TRACKS_SQL} SELECT mmsi, track, min(t_us) AS t_start, max(t_us) AS t_end, count(*) AS n_fixes,
    count(CASE WHEN step_us > {6 * H} THEN 1 END) AS n_gaps, CAST(coalesce(sum(CASE WHEN step_us > {6 * H} THEN step_us END), 0) AS BIGINT) AS gap_us FROM st GROUP BY 1, 2""")
def track_sessions(spark, sf_dir):
    return P.track_summary(tracks_of(spark, sf_dir), PARAMS.gap_threshold_hours).select("mmsi", "track", "t_start", "t_end", "n_fixes", "n_gaps", "gap_us")


@query(f"WITH {TRACKS_SQL} SELECT mmsi, track, gap_start, gap_end FROM gp")
def track_gaps(spark, sf_dir):
    return P.gaps(tracks_of(spark, sf_dir), PARAMS.gap_threshold_hours)


@query(f"WITH {TRACKS_SQL} SELECT ord, mmsi, t_us FROM dd")
def dedupe_keep_first(spark, sf_dir):
    return P.dedupe_keep_first(positions(spark, sf_dir).filter(P.valid_coordinate())).select("ord", "mmsi", "t_us")


@query(f"WITH {TRACKS_SQL} SELECT ord, mmsi, t_us, round(kn, 6) AS implied_kn FROM sp WHERE kn <= 40")
def speed_jump_filter(spark, sf_dir):
    rows = P.implied_speed(P.dedupe_keep_first(positions(spark, sf_dir).filter(P.valid_coordinate())))
    return rows.withColumn("implied_kn", F.round(F.coalesce("implied_kn", F.lit(0.0)), 6)).filter("implied_kn <= 40").select("ord", "mmsi", "t_us", "implied_kn")


@query(f"""WITH {TRACKS_SQL} SELECT (SELECT count(*) FROM pos) AS rows_in, (SELECT count(*) FROM pos) - (SELECT count(*) FROM ok) AS dropped_bad_position,
    (SELECT count(*) FROM ok) - (SELECT count(*) FROM dd) AS dropped_duplicate, (SELECT count(*) FROM sp WHERE kn > 40) AS dropped_speed_jump,
    (SELECT CAST(coalesce(sum(m), 0) AS BIGINT) FROM (SELECT max(track) AS m FROM sg GROUP BY mmsi) x) AS tracks_split_on_gap,
    (SELECT count(*) FROM tr) AS rows_out, (SELECT count(*) FROM (SELECT DISTINCT mmsi, track FROM tr) x) AS tracks_out, (SELECT count(DISTINCT mmsi) FROM tr) AS vessels_out""")
def cleaning_report(spark, sf_dir):
    return P.assert_sane(P.cleaning_report(positions(spark, sf_dir), PARAMS), PARAMS)


@query(f"""WITH {TRACKS_SQL} SELECT CAST(median(m) AS DOUBLE) AS baseline_us FROM
    (SELECT max(CASE WHEN step_us > {6 * H} THEN step_us ELSE 0 END) AS m FROM st GROUP BY mmsi, track) x""")
def baseline_gap(spark, sf_dir):
    return P.baseline_gap(tracks_of(spark, sf_dir), PARAMS.gap_threshold_hours)


@query(f"WITH {TRACKS_SQL} SELECT mmsi, track, round(median(sog_kn), 6) AS transit_kn FROM tr GROUP BY 1, 2")
def transit_median(spark, sf_dir):
    return P.track_summary(tracks_of(spark, sf_dir), PARAMS.gap_threshold_hours).select("mmsi", "track", F.round("transit_kn", 6).alias("transit_kn"))


@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL}, nr AS (SELECT w.mmsi, w.track, w.t_mid, t.cog_deg, abs(t.t_us - w.t_mid) AS d, min(abs(t.t_us - w.t_mid)) OVER (PARTITION BY w.mmsi, w.track) AS near
    FROM wn w JOIN tr t ON w.mmsi = t.mmsi AND w.track = t.track),
    hd AS (SELECT mmsi, track, avg(sin(radians(cog_deg))) AS s, avg(cos(radians(cog_deg))) AS c FROM nr WHERE d <= greatest(near, {H}) GROUP BY 1, 2)
    SELECT mmsi, track, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) AS heading_deg FROM hd""")
def circular_heading(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    moments = tracks.groupBy("mmsi", "track").agg(F.floor((F.min("t_us") + F.max("t_us")) / 2).cast("long").alias("t_mid"))
    return T.heading_near(tracks, moments).select("mmsi", "track", F.round("heading_deg", 4).alias("heading_deg"))


@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL}, iw AS (SELECT t.*, w.w_from, lag(t.cog_deg) OVER (PARTITION BY t.mmsi, t.track ORDER BY t.t_us, t.ord) AS pc
    FROM tr t JOIN wn w ON w.mmsi = t.mmsi AND w.track = t.track WHERE t.t_us BETWEEN w.w_from AND w.w_to),
    cc AS (SELECT mmsi, track, count(*) AS n, max(abs((((cog_deg - pc + 180) % 360) + 360) % 360 - 180)) AS m FROM iw GROUP BY 1, 2)
    SELECT w.mmsi, w.track, CASE WHEN c.n >= 3 THEN c.m ELSE 0e0 END AS course_change_deg FROM wn w LEFT JOIN cc c ON w.mmsi = c.mmsi AND w.track = c.track""")
def course_change(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    return T.course_change(tracks, windows_of(tracks)).select("mmsi", "track", "course_change_deg")


@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL}, pr AS (SELECT mmsi, track, a - {H} + k * ((b - a) // 4 + {H}) AS probe_us FROM sn CROSS JOIN (SELECT range AS k FROM range(5)) r),
    ab AS (SELECT p.*, (SELECT max(t_us) FROM tr t WHERE t.mmsi = p.mmsi AND t.track = p.track AND t.t_us <= p.probe_us) AS ta,
                       (SELECT min(t_us) FROM tr t WHERE t.mmsi = p.mmsi AND t.track = p.track AND t.t_us >= p.probe_us) AS tb FROM pr p),
    ends AS (SELECT mmsi, track, probe_us, coalesce(ta, tb) AS ta, coalesce(tb, ta) AS tb FROM ab)
    SELECT e.mmsi, e.track, e.probe_us, round(x.lon + CASE WHEN tb > ta THEN (probe_us - ta) / CAST(tb - ta AS DOUBLE) ELSE 0 END * (y.lon - x.lon), 6) AS lon,
           round(x.lat + CASE WHEN tb > ta THEN (probe_us - ta) / CAST(tb - ta AS DOUBLE) ELSE 0 END * (y.lat - x.lat), 6) AS lat,
           EXISTS (SELECT 1 FROM gp g WHERE g.mmsi = e.mmsi AND g.track = e.track AND e.probe_us > g.gap_start AND e.probe_us < g.gap_end) AS in_gap
    FROM ends e JOIN tr x ON x.mmsi = e.mmsi AND x.track = e.track AND x.t_us = e.ta JOIN tr y ON y.mmsi = e.mmsi AND y.track = e.track AND y.t_us = e.tb""")
def asof_interpolate(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    spans = tracks.groupBy("mmsi", "track").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    step = F.floor((F.col("b") - F.col("a")) / 4).cast("long") + H
    probes = spans.select("mmsi", "track", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("a") - H + k * step)).alias("probe_us"))
    out = T.asof_interpolate(tracks, probes, P.gaps(tracks, PARAMS.gap_threshold_hours))
    return out.select("mmsi", "track", "probe_us", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "in_gap")


@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL} SELECT w.mmsi, w.track, round(coalesce(sum(greatest(0, least(gap_end, w_to) - greatest(gap_start, w_from))), 0) / {H}.0, 6) AS gap_hours
    FROM wn w LEFT JOIN gp g ON w.mmsi = g.mmsi AND w.track = g.track GROUP BY 1, 2""")
def gap_overlap(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    return T.gap_overlap(P.gaps(tracks, PARAMS.gap_threshold_hours), windows_of(tracks)).select("mmsi", "track", F.round("gap_hours", 6).alias("gap_hours"))


@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL} SELECT w.mmsi, w.track, round(median(t.sog_kn), 6) AS speed_kn
    FROM wn w LEFT JOIN tr t ON w.mmsi = t.mmsi AND w.track = t.track AND t.t_us BETWEEN w_from AND w_to GROUP BY 1, 2""")
def window_speed(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    return T.window_speed(tracks, windows_of(tracks)).select("mmsi", "track", F.round("speed_kn", 6).alias("speed_kn"))


@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL} SELECT mmsi, track, a <= t_mid AND t_mid <= b AS covered, (b - a) / {H} AS span_hours FROM sn JOIN wn USING (mmsi, track)""")
def track_coverage(spark, sf_dir):
    spans = tracks_of(spark, sf_dir).groupBy("mmsi", "track").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    mid = F.floor((F.col("a") + F.col("b")) / 2)
    return spans.select("mmsi", "track", mid.between(F.col("a"), F.col("b")).alias("covered"), ((F.col("b") - F.col("a")) / H).alias("span_hours"))


@query(f"""WITH {TRACKS_SQL}, {WINDOWS_SQL} SELECT mmsi, track, k AS bin, a + k * {2 * H} AS w_from FROM sn
    CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(2000)) r WHERE k < greatest(1, ceil((b - a) / {2.0 * H}))""")
def release_windows(spark, sf_dir):
    spans = tracks_of(spark, sf_dir).groupBy("mmsi", "track").agg(F.min("t_us").alias("lo_us"), F.max("t_us").alias("hi_us"))
    return T.release_bins(spans, 2.0).select("mmsi", "track", "bin", "w_from")


@query(f"WITH {POSITIONS_SQL} SELECT count(*) AS messages, count(DISTINCT mmsi) AS vessels FROM pos")
def case_summary(spark, sf_dir):
    return P.case_summary(positions(spark, sf_dir))


_SHIFTED = HAVERSINE_SQL.format(lat1="lat", lat2="(lat + 1e-1)", lon1="lon", lon2="(lon + 2e-1)")


@query(f"""WITH {POSITIONS_SQL} SELECT ord, round({_SHIFTED}, 3) AS metres, round(((degrees(atan2(sin(radians(2e-1)) * cos(radians(lat + 1e-1)),
    cos(radians(lat)) * sin(radians(lat + 1e-1)) - sin(radians(lat)) * cos(radians(lat + 1e-1)) * cos(radians(2e-1)))) % 360) + 360) % 360, 6) AS bearing FROM pos WHERE lat <= 90""")
def haversine_bearing(spark, sf_dir):
    rows = positions(spark, sf_dir).filter("lat <= 90")
    there = (F.col("lon") + 0.2, F.col("lat") + 0.1)
    # The bearing takes the literal difference of longitudes, as both engines then round alike.
    return rows.select("ord", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), *there), 3).alias("metres"), F.round(geo.bearing_deg(F.lit(0.0), F.col("lat"), F.lit(0.2), F.col("lat") + 0.1), 6).alias("bearing"))


@query(f"""WITH {POSITIONS_SQL} SELECT ord, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg FROM pos WHERE lat <= 90""")
def utm_zone(spark, sf_dir):
    return positions(spark, sf_dir).filter("lat <= 90").select("ord", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query()
def utm_round_trip(spark, sf_dir):
    """Grid coordinates, and the error of coming back, in degrees."""
    rows = positions(spark, sf_dir).filter("lat <= 84")
    zone = (F.floor((F.col("lon") + 180) / 6) + 1).cast("int")
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), zone)
    rows = rows.select("ord", "lon", "lat", zone.alias("zone"), x.alias("x"), y.alias("y"))
    lon, lat = geo.utm_inverse(F.col("x"), F.col("y"), F.col("zone"))
    return rows.select("ord", "zone", "x", "y", F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))).alias("error_deg"), geo.grid_convergence(F.col("lon"), F.col("lat"), F.col("zone")).alias("convergence"))


def _edges(x: str, y: str) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(RING[:-1], RING[1:], strict=True):
        parts.append(f"CASE WHEN (({y1}e0 > {y}) <> ({y2}e0 > {y})) AND {x} < ({x2}e0 - {x1}e0) * ({y} - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query(f"WITH {POSITIONS_SQL} SELECT ord, {_edges('lon', 'lat')} AS inside FROM pos")
def point_in_polygon(spark, sf_dir):
    return positions(spark, sf_dir).select("ord", geo.point_in_ring(F.col("lon"), F.col("lat"), RING).alias("inside"))


_LO, _HI = 1_704_067_200_000_000 + 40 * H, 1_704_067_200_000_000 + 400 * H


def _distance() -> str:
    import math

    mid = sum(p[1] for p in RING) / len(RING)
    sx, sy = 111320 * math.cos(math.radians(mid)), 111320.0
    parts = []
    for (x1, y1), (x2, y2) in zip(RING[:-1], RING[1:], strict=True):
        dx, dy = (x2 - x1) * sx, (y2 - y1) * sy
        px, py = f"((lon - {x1}e0) * {sx!r}::DOUBLE)", f"((lat - {y1}e0) * {sy!r}::DOUBLE)"
        t = f"least(greatest(({px} * {dx!r}::DOUBLE + {py} * {dy!r}::DOUBLE) / {dx * dx + dy * dy!r}::DOUBLE, 0e0), 1e0)"
        parts.append(f"sqrt(pow({px} - {t} * {dx!r}::DOUBLE, 2) + pow({py} - {t} * {dy!r}::DOUBLE, 2))")
    return f"least({', '.join(parts)})"


@query(f"""WITH {TRACKS_SQL} SELECT DISTINCT mmsi, track FROM tr WHERE t_us BETWEEN {_LO - 6 * H} AND {_HI + 6 * H} AND (({_edges('lon', 'lat')}) OR {_distance()} <= 25000)""")
def region_prefilter(spark, sf_dir):
    return S.prefilter(tracks_of(spark, sf_dir), RING, _LO, _HI)


_MOVERS = "o AS (SELECT ord, t_us - t_us % 86400000000 AS t_us, lon, lat FROM tr)"


@query(f"""WITH {TRACKS_SQL}, {_MOVERS}, sm AS (SELECT CAST(range AS BIGINT) AS sample, {1_704_067_200_000_000} + (range % 30) * 86400000000 AS t_us, 1.02e1 + (range % 40) * 7e-2 AS lon, 5.64e1 + (range % 23) * 7.5e-2 AS lat FROM range(600))
    SELECT sample, t_us, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sm WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.t_us = sm.t_us AND abs(o.lon - sm.lon) < 3e-2 AND abs(o.lat - sm.lat) < 3e-2)""")
def dark_antijoin(spark, sf_dir):
    movers = tracks_of(spark, sf_dir).select((F.col("t_us") - F.col("t_us") % 86_400_000_000).alias("t_us"), "lon", "lat")
    i = F.col("id")
    samples = spark.range(600).select(i.alias("sample"), (F.lit(1_704_067_200_000_000) + (i % 30) * 86_400_000_000).alias("t_us"), (10.2 + (i % 40) * 0.07).alias("lon"), (56.4 + (i % 23) * 0.075).alias("lat"))
    return S.unexplained(samples, movers, 0.03).select("sample", "t_us", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""WITH {TRACKS_SQL}, tg AS (SELECT mmsi || '#' || track AS target, avg(lon) AS lon, avg(lat) AS lat FROM tr GROUP BY mmsi, track),
    pt AS (SELECT CAST(range AS BIGINT) AS point, 1.02e1 + (range % 27) * 1.037e-1 AS lon, 5.61e1 + (range % 19) * 1.111e-1 AS lat FROM range(200)),
    dd2 AS (SELECT point, target, sqrt(pow((pt.lon - tg.lon) * 6e-1, 2) + pow(pt.lat - tg.lat, 2)) AS d FROM pt, tg),
    nr AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY round(d, 9), target) AS k FROM dd2 WHERE d <= 35e-2)
    SELECT pt.point, round(nr.d, 6) AS distance FROM pt LEFT JOIN nr ON pt.point = nr.point AND k = 1""")
def nearest_track(spark, sf_dir):
    targets = tracks_of(spark, sf_dir).groupBy("mmsi", "track").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).select(F.concat("mmsi", F.lit("#"), "track").alias("target"), "lon", "lat")
    i = F.col("id")
    points = spark.range(200).select(i.alias("point"), (10.2 + (i % 27) * 0.1037).alias("lon"), (56.1 + (i % 19) * 0.1111).alias("lat"))
    return S.nearest(points, targets).select("point", F.round("distance", 6).alias("distance"))


@query(f"""WITH {TRACKS_SQL}, l AS (SELECT mmsi, track, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n_points,
    string_agg('[' || CAST(CAST(round(lon * 100000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(lat * 100000) AS BIGINT) AS VARCHAR) || ']', ',' ORDER BY t_us, ord) AS coordinates FROM tr GROUP BY 1, 2)
    SELECT mmsi, track, n_points, '{{"type":"LineString","coordinates":[' || coordinates || ']}}' AS line FROM l""")
def track_lines(spark, sf_dir):
    """Tracks as line geometries, in units of 1e-5 degree so that text is exact."""
    unit = lambda c: F.round(F.col(c) * 100000).cast("long").cast("string")
    point = F.concat(F.lit("["), unit("lon"), F.lit(","), unit("lat"), F.lit("]"))
    rows = tracks_of(spark, sf_dir).groupBy("mmsi", "track").agg(F.count("*").alias("n_points"), F.array_sort(F.collect_list(F.struct("t_us", "ord", point.alias("p")))).alias("ps"))
    return rows.select("mmsi", "track", "n_points", F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join("ps.p", ","), F.lit("]}")).alias("line"))
