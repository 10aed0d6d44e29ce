"""Whole stages: detection, inversion, attribution, forecast, and trials with a planted source."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import point_in_ring, utm_forward, utm_inverse
from tidemark.functions.rng import hash_uniform
from tidemark.operators import evidence as E
from tidemark.operators import generate as G
from tidemark.operators import positions as P
from tidemark.operators import posterior as Q
from tidemark.operators import raster as R
from tidemark.operators import slick as SL
from tidemark.operators import spatial as S
from tidemark.operators import temporal as T
from tidemark.operators import transport as X

ZONE = 32
HOUR_US = P.HOUR_US
#: The mover that stands for a source that does not transmit.
DARK = "not transmitting"


def synthetic_field(spark: SparkSession, box: G.Box = G.Box(), hours: int = 48, cell_m: float = 4000.0) -> X.Field:
    """The generated currents, winds and coast on a metric grid. A grid of this size is bounded by its box and step; the field
    refuses to be built beyond its limit."""
    corners = spark.createDataFrame([(box.min_lon, box.min_lat), (box.max_lon, box.max_lat)], "lon double, lat double")
    x, y = utm_forward(F.col("lon"), F.col("lat"), F.lit(ZONE))
    (x0, y0), (x1, y1) = sorted((r["x"], r["y"]) for r in corners.select(x.alias("x"), y.alias("y")).collect())
    nx, ny = int((x1 - x0) / cell_m) + 2, int((y1 - y0) / cell_m) + 2
    if nx * ny * ((hours + 1) * 32 + 1) > X.MAX_FIELD_BYTES:
        raise ValueError("the field is too large to broadcast; cut it by region or time first")
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    lon, lat = utm_inverse(x0 + F.col("ix") * cell_m, y0 + F.col("iy") * cell_m, F.lit(ZONE))
    cells = cells.withColumn("lon", lon).withColumn("lat", lat).crossJoin(F.broadcast(spark.range(hours + 1).select(F.col("id").cast("double").alias("t"))))
    (u, v), (uw, vw) = G.current(F.col("lon"), F.col("lat"), F.col("t"), box), G.wind(F.col("lon"), F.col("lat"), F.col("t"), box)
    rows = cells.select("t", "iy", "ix", u.alias("u"), v.alias("v"), uw.alias("uw"), vw.alias("vw"), G.is_land(F.col("lon"), F.col("lat"), box).alias("land")).toPandas()
    rows = rows.sort_values(["t", "iy", "ix"])
    cube = lambda c: rows[c].to_numpy(float).reshape(hours + 1, ny, nx)
    return X.Field(x0, y0, cell_m, cell_m, 0.0, 3600.0, cube("u"), cube("v"), cube("uw"), cube("vw"), rows["land"].to_numpy(bool).reshape(hours + 1, ny, nx)[0])


def detect(
    scene: DataFrame, rows: int, cols: int, wind_ms: float, cell_km2: float, half_window: int = 12, below: float = 3.0, least: int = 8, wind: DataFrame | None = None,
    headings: DataFrame | None = None, lanes: DataFrame | None = None, incidence_deg: DataFrame | None = None,
) -> DataFrame:
    """Dark patches of a scene (row, col, value, land) with features, probability, class, reason and release mode, largest first.

    Land takes the sea's median, the scene is smoothed, cells below their local background are opened, and labelled patches
    of `least` cells go through the gate. wind (row, col, wind) gives each patch its own wind and the wind's gradient, headings (row, col,
    heading_deg, clockwise from north, where rows count northward) of tracks the axis's offset from the nearest heading within the patch's block, lanes (cx, cy; cells of ten) the distance to a
    busy lane, incidence_deg (row, col, incidence_deg) the damping scaled to 35 degrees.
    """
    sea = scene.filter(~F.col("land"))
    base = sea.agg(F.median("value").alias("m")).first()["m"]  # one scalar
    filled = scene.select("row", "col", F.when(F.col("land"), F.lit(base)).otherwise(F.col("value")).alias("value"))
    smooth = R._checkpoint(R.gaussian(filled, 1.0, rows, cols, "nearest"))
    dark = R.dark_candidates(smooth, R.box_mean(smooth, half_window, rows, cols), below).join(sea.select("row", "col"), ["row", "col"], "left_semi")
    patches = R.label_components(R.within(R.opening(dark, R.CROSS), rows, cols), least)
    features = R.patch_summary(patches, filled, base).join(R.shape_features(patches, cell_km2).drop("n_cells"), "patch").join(R.hull_solidity(patches), "patch")
    edges = patches.join(R.gradient(smooth), ["row", "col"]).groupBy("patch").agg(F.max("magnitude").alias("edge_gradient"), F.avg("magnitude").alias("inner_gradient"))
    parts = R.label_components(patches.select("row", "col"), diagonal=False).withColumnRenamed("patch", "part").join(patches, ["row", "col"]).groupBy("patch").agg(F.count_distinct("part").alias("n_parts"))
    features = features.join(edges, "patch").join(parts, "patch").withColumn("gradient_ratio", F.coalesce(F.try_divide("edge_gradient", "inner_gradient"), F.lit(1.0)))

    def add(frame: DataFrame | None, make, name: str, otherwise) -> None:
        nonlocal features
        features = features.withColumn(name, otherwise) if frame is None else features.join(make(frame), "patch", "left").withColumn(name, F.coalesce(name, otherwise))

    mean = lambda c: lambda frame: patches.join(frame, ["row", "col"]).groupBy("patch").agg(F.avg(c).alias(c))
    add(wind, lambda w: patches.join(w, ["row", "col"]).groupBy("patch").agg(F.avg("wind").alias("wind_ms")), "wind_ms", F.lit(float(wind_ms)))
    add(wind, lambda w: SL.wind_spread(patches, w, math.sqrt(cell_km2)), "wind_gradient", F.lit(0.0))
    add(incidence_deg, mean("incidence_deg"), "incidence_deg", F.lit(35.0))
    features = features.withColumn("damping_norm", F.col("damping") / 10.0 * F.cos(F.radians(F.lit(35.0))) / F.cos(F.radians("incidence_deg")))
    box = patches.groupBy("patch").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    blocks = box.select("patch", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select("patch", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    offset = lambda h: blocks.join(h, ["row", "col"]).join(features.select("patch", "axis_deg"), "patch").groupBy("patch").agg(F.min(E.fold_angle(F.col("heading_deg"), 90.0 - F.col("axis_deg"))).alias("offset_deg"))
    add(headings, offset, "offset_deg", F.lit(None).cast("double"))
    centres = features.select("patch", F.floor(F.col("centre_col") / 10).alias("cx"), F.floor(F.col("centre_row") / 10).alias("cy"))
    add(lanes, lambda busy: centres.join(SL.distance_to_busy(centres, busy, 8), ["cx", "cy"]).select("patch", F.col("distance").alias("lane_distance")), "lane_distance", F.lit(None).cast("double"))
    p = E.oil_probability(F.col("damping_norm"), F.col("gradient_ratio"), F.col("elongation"), F.col("wind_gradient"), F.col("solidity"))
    out = features.withColumn("probability", p).withColumn("class", E.classify(F.col("wind_ms"), F.col("probability")))
    out = out.withColumn("reason", E.class_reason(F.col("class"), F.col("wind_ms"), F.col("damping_norm"), F.col("gradient_ratio"), F.col("elongation"), F.col("solidity")))
    out = out.withColumn("abstained", F.col("class") == "undetermined").withColumn("mode", E.release_mode(F.col("elongation"), F.col("offset_deg"), F.col("n_parts")))
    return out.orderBy(F.desc("n_cells"), "patch")


def actionable(detections: DataFrame, patch: int | None = None) -> DataFrame:
    """Patches of oil, or one detection by its number if it is one."""
    found = detections.filter(F.col("class") == "oil")
    return found if patch is None else found.filter(F.col("patch") == patch)


def mask_from_points(points: DataFrame, cell_m: float, keep: float = 0.85, pad: int = 2, sigma: float | None = None) -> DataFrame:
    """(ix, iy, state): the cells that hold `keep` of the points, and the annulus around their edge that counts as unobserved. With sigma
    (in cells) the counts are smoothed first, over the points' own box and four deviations around it."""
    cells = points.groupBy(F.floor(F.col("x") / cell_m).alias("ix"), F.floor(F.col("y") / cell_m).alias("iy")).agg(F.count("*").cast("double").alias("w"))
    if sigma:
        cells = R._checkpoint(cells)
        pad_cells = int(4 * sigma + 0.5)
        box = cells.agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1")).first()  # four scalars
        if box["x0"] is not None:
            x0, y0 = box["x0"] - pad_cells, box["y0"] - pad_cells
            n_cols, n_rows = box["x1"] - x0 + 1 + pad_cells, box["y1"] - y0 + 1 + pad_cells
            grid = points.sparkSession.range(n_rows * n_cols).select(F.floor(F.col("id") / n_cols).alias("row"), (F.col("id") % n_cols).alias("col"))
            dense = grid.join(cells.select((F.col("iy") - y0).alias("row"), (F.col("ix") - x0).alias("col"), "w"), ["row", "col"], "left").select("row", "col", F.coalesce("w", F.lit(0.0)).alias("value"))
            smooth = R.gaussian(dense, sigma, n_rows, n_cols, "nearest").filter("value > 1e-9")
            cells = smooth.select((F.col("col") + x0).alias("ix"), (F.col("row") + y0).alias("iy"), F.col("value").alias("w"))
    core = Q.highest_density(cells, keep, ["iy", "ix"]).select(F.col("iy").alias("row"), F.col("ix").alias("col"))
    inner, outer = R.erode_keeping(core, 1), R.dilate(core, times=pad)
    annulus = outer.join(inner, ["row", "col"], "left_anti")
    return inner.select(F.col("col").alias("ix"), F.col("row").alias("iy"), F.lit("oil").alias("state")).unionByName(annulus.select(F.col("col").alias("ix"), F.col("row").alias("iy"), F.lit("annulus").alias("state")))


def score(trajectories: DataFrame, mask: DataFrame, cell_m: float, n_effective: float) -> DataFrame:
    at = trajectories.select(F.col("origin").alias("hyp"), F.floor(F.col("x") / cell_m).alias("ix"), F.floor(F.col("y") / cell_m).alias("iy"), F.col("status").isin(X.ACTIVE, X.BEACHED).alias("usable"))
    return Q.bernoulli_loglik(at, mask, n_effective=n_effective)


@dataclass(frozen=True)
class InversionParams:
    cell_m: float = 2000.0
    lookback_h: float = 18.0
    bin_h: float = 3.0
    each: int = 24
    each_refined: int = 24
    max_hypotheses: int = 800
    proposal: int = 3000
    margin_m: float = 15_000.0
    rounds: int = 2
    keep: float = 0.1
    correlation_m: float = 9000.0


#: The original's settings.
FULL_INVERSION = InversionParams(lookback_h=36.0, bin_h=1.0, each=40, each_refined=110, max_hypotheses=4096)


def invert(spark: SparkSession, field: X.Field, mask: DataFrame, t_obs: float, p: InversionParams = InversionParams()) -> DataFrame:
    """(hyp, x, y, t0, log_lik, weight): source hypotheses of a mask, coarse to fine.

    Points of the mask run backward; the cells they pass, and those within a margin of them, are the first hypotheses, each scored by particles run forward to
    the observation. The best tenth is split in four and scored again; a round's hypotheses are checkpointed.
    """
    oil = mask.filter("state = 'oil'")
    bins = [t_obs - h * 3600 for h in np.arange(p.bin_h, p.lookback_h + 1e-9, p.bin_h)]
    points = X.sample_cells(oil, p.proposal).select("sample", ((F.col("ix") + F.col("dx")) * p.cell_m).alias("x"), ((F.col("iy") + F.col("dy")) * p.cell_m).alias("y"))
    proposals = R._checkpoint(X.history(points.withColumnRenamed("sample", "particle_id"), field, t_obs, [float(t) for t in bins], X.proposal()))
    grid, cell = X.hypothesis_grid(proposals, p.cell_m, p.max_hypotheses, margin=p.margin_m)
    hypotheses = R._checkpoint(grid.select(F.col("x"), F.col("y"), "t0").withColumn("hyp", F.xxhash64("x", "y", "t0").bitwiseAND((1 << 40) - 1)))
    area = oil.count() * (p.cell_m / 1000) ** 2
    n_effective = min(max(area / (p.correlation_m / 1000) ** 2, 1.0), float(max(1, oil.count())))
    done = None
    for step in range(p.rounds):
        seeds = X.hypothesis_seeds(hypotheses, p.each if step == 0 else p.each_refined, cell)
        forward = X.simulate(seeds, field, min(bins), t_obs, X.TransportParams(seed=step))
        scored = R._checkpoint(score(forward, mask, p.cell_m, n_effective).select("hyp", "log_lik").join(hypotheses, "hyp"))
        done = scored
        if step < p.rounds - 1:
            best = Q.keep_best(scored, p.keep, "log_lik", "hyp")
            cell /= 2
            hypotheses = R._checkpoint(Q.refine(best, cell * 2).select("x", "y", "t0").withColumn("hyp", F.xxhash64("x", "y", "t0").bitwiseAND((1 << 40) - 1)))
    return Q.softmax(done)


def dark_sources(tracks: DataFrame, region: list[tuple[float, float]], windows: list[float], window_s: float, t0_us: int, n: int, radius_km: float, seed: int = 0) -> DataFrame:
    """(sample, lon, lat, t): up to n places and times in the region, in one of the windows, that no track passes within radius_km (on
    either axis) at that time. 40 n draws are made at once; the first n accepted ones stay."""
    spark = tracks.sparkSession
    lons, lats = [p[0] for p in region], [p[1] for p in region]
    u = lambda stream: hash_uniform(seed, stream, F.col("sample"))
    starts = F.element_at(F.lit([float(w) for w in windows]), (F.floor(u(43) * len(windows)) + 1).cast("int"))
    draws = spark.range(40 * n).select(F.col("id").alias("sample"))
    draws = draws.select("sample", (min(lons) + u(41) * (max(lons) - min(lons))).alias("lon"), (min(lats) + u(42) * (max(lats) - min(lats))).alias("lat"), (starts + u(44) * window_s).alias("t"))
    inside = draws.filter(point_in_ring(F.col("lon"), F.col("lat"), region)).withColumn("t_us", (F.lit(t0_us) + F.col("t") * 1e6).cast("long"))
    # A fixed number of draws meets the tracks that cover their time; those are what the prefilter left.
    spans = tracks.groupBy("mmsi", "track").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    probes = spans.join(F.broadcast(inside.select("sample", "t_us")), F.col("t_us").between(F.col("a"), F.col("b"))).select("mmsi", "track", F.col("t_us").alias("probe_us"))
    known = T.asof_interpolate(tracks, probes.distinct()).select(F.col("probe_us").alias("t_us"), "lon", "lat")
    mid = math.radians((min(lats) + max(lats)) / 2)
    left = S.unexplained(inside, known, radius_km / (111.32 * max(math.cos(mid), 0.2)))
    return X.accept_first(left.select("sample", "lon", "lat", "t"), n)


def attribute(
    field: X.Field, mask: DataFrame, tracks: DataFrame, windows: list[float], window_s: float, t_obs: float, cell_m: float, t0_us: int, region: list[tuple[float, float]], gap_hours: float = 0.5, axis_deg: float = 0.0,
    dark_prior: float = 0.15, each: int = 40, dark: int = 60, dark_km: float = 3.0, buffer_km: float = 25.0,
) -> DataFrame:
    """Ranked candidates among tracks that come near the region (a closed ring of lon, lat) around the windows.

    Each track that covers a release window seeds particles along its way; so do `dark` sampled places that no track explains. One run
    carries and scores all of them alike. Log-likelihoods are averaged over windows, or over the samples for the source that does not
    transmit; movers are weighed by the behavioural prior and combined with it, and probabilities and dark_probability sum to 1.
    """
    spark = tracks.sparkSession
    lo, hi = t0_us + int(min(windows) * 1e6), t0_us + int((max(windows) + window_s) * 1e6)
    near = S.prefilter(tracks, region, lo, hi, buffer_km)
    tracks = R._checkpoint(tracks.join(near, ["mmsi", "track"], "left_semi"))
    spans = tracks.groupBy("mmsi", "track").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    starts = spark.createDataFrame([(i, float(w)) for i, w in enumerate(windows)], "bin int, w_from double")
    probes = spans.crossJoin(F.broadcast(starts)).withColumn("probe_us", (F.lit(t0_us) + (F.col("w_from") + window_s / 2) * 1e6).cast("long"))
    probes = probes.filter(F.col("probe_us").between(F.col("a"), F.col("b")))  # a track says nothing about times it does not cover
    at = T.asof_interpolate(tracks, probes.select("mmsi", "track", "probe_us")).join(probes.select("mmsi", "track", "probe_us", "bin", "w_from"), ["mmsi", "track", "probe_us"])
    x, y = utm_forward(F.col("lon"), F.col("lat"), F.lit(ZONE))
    at = R._checkpoint(at.select(F.concat("mmsi", F.lit("#"), "track").alias("mover"), "mmsi", "track", "bin", "w_from", x.alias("x"), y.alias("y")))
    hidden = dark_sources(tracks, region, windows, window_s, t0_us, dark, dark_km).select(F.lit(DARK).alias("mover"), F.col("sample").cast("int").alias("bin"), F.col("t").alias("w_from"), x.alias("x"), y.alias("y"))
    sources = R._checkpoint(at.select("mover", "bin", "w_from", "x", "y").unionByName(hidden))
    named = sources.select("mover", "bin", X.release_origin(F.col("mover"), F.col("bin")).alias("origin"))
    run = X.simulate(X.release_seeds(sources, each, window_s).withColumn("seed_time", F.least("seed_time", F.lit(t_obs - 1.0))), field, min(windows), t_obs)
    oil = mask.filter("state = 'oil'").count()
    scores = score(run, mask, cell_m, max(1.0, oil * (cell_m / 9000.0) ** 2)).withColumnRenamed("hyp", "origin").join(named, "origin")
    marginal = R._checkpoint(E.marginalise(scores.select("mover", "bin", "log_lik"), ["mover"], "log_lik", "bin"))
    unseen = marginal.filter(F.col("mover") == DARK).agg(F.coalesce(F.max("log_marginal"), F.lit(float("-inf"))).alias("dark_log_marginal"))
    windowed = at.select("mover", "mmsi", "track", F.col("bin").alias("best_window"), "w_from")
    best = marginal.filter(F.col("mover") != DARK).join(windowed, ["mover", "best_window"])
    window = best.select("mover", "mmsi", "track", "best_window", "log_marginal", (F.lit(t0_us) + F.col("w_from") * 1e6).cast("long").alias("w_from"), (F.lit(t0_us) + (F.col("w_from") + window_s) * 1e6).cast("long").alias("w_to"))
    asked = window.select("mmsi", "track", "w_from", "w_to")
    silence = T.gap_overlap(P.gaps(tracks, gap_hours), asked)
    slow = T.window_speed(tracks, asked)
    turn = T.course_change(tracks, asked)
    heading = T.heading_near(tracks, asked.select("mmsi", "track", F.floor((F.col("w_from") + F.col("w_to")) / 2).cast("long").alias("t_mid"))).select("mmsi", "track", "heading_deg")
    about = tracks.groupBy("mmsi", "track").agg(F.median("sog_kn").alias("transit_kn"), F.min("ship_type").alias("ship_type"))
    on = ["mmsi", "track"]
    rows = window.join(silence.select(*on, "gap_hours"), on).join(slow.select(*on, "speed_kn"), on).join(turn.select(*on, "course_change_deg"), on).join(heading, on).join(about, on)
    rows = E.type_factor(rows.crossJoin(F.broadcast(P.baseline_gap(tracks, gap_hours)))).crossJoin(F.broadcast(unseen))  # one row each
    baseline = F.col("baseline_us") / HOUR_US
    prior = E.behavioural_prior(
        E.gap_factor(F.col("gap_hours"), baseline), E.speed_factor(F.col("speed_kn"), F.col("transit_kn")), E.course_factor(F.col("course_change_deg")),
        F.col("type_factor"), E.alignment_factor(F.col("heading_deg"), F.lit(axis_deg)),
    )
    notes = F.struct(
        E.gap_note(F.col("gap_hours"), baseline).alias("gap"), E.speed_note(F.col("speed_kn"), F.col("transit_kn")).alias("speed"), E.course_note(F.col("course_change_deg")).alias("course"),
        E.type_note(F.col("ship_type"), F.col("type_factor")).alias("type"), E.alignment_note(F.col("heading_deg"), F.lit(axis_deg)).alias("alignment"),
    )
    combined = R._checkpoint(E.combine(rows.withColumn("prior", prior).withColumn("notes", notes), "dark_log_marginal", dark_prior))
    ranked = E.rebalance(E.rank(combined, ["mover"]))
    return ranked.select("rank", "mover", "best_window", "log_marginal", "dark_log_marginal", "prior", "probability", "dark_probability", "notes")


def forecast(field: X.Field, mask: DataFrame, t_obs: float, cell_m: float, horizons_h: tuple[float, ...] = (6, 12, 24), particles: int = 2000) -> DataFrame:
    """(horizon_h, ix, iy, state): where the observed mask drifts to."""
    points = X.sample_cells(mask.filter("state = 'oil'"), particles)
    seeds = points.select(F.col("sample").alias("particle_id"), F.lit(0).cast("long").alias("origin"), ((F.col("ix") + F.col("dx")) * cell_m).alias("x"), ((F.col("iy") + F.col("dy")) * cell_m).alias("y"), F.lit(float(t_obs)).alias("seed_time"))
    out = None
    for h in horizons_h:
        drifted = X.usable(X.simulate(seeds, field, t_obs, t_obs + h * 3600))
        one = mask_from_points(drifted, cell_m, sigma=1.0).withColumn("horizon_h", F.lit(float(h)))
        out = one if out is None else out.unionByName(one)
    return out.select("horizon_h", "ix", "iy", "state")


def planted_mask(field: X.Field, spark: SparkSession, x: float, y: float, t0: float, t_obs: float, cell_m: float, n: int = 3000) -> DataFrame:
    """The mask that a known release makes."""
    i = F.col("id")
    jitter = lambda s: (G.hash_uniform(5, s, i) - 0.5) * 500.0
    seeds = spark.range(n).select(i.alias("particle_id"), F.lit(0).cast("long").alias("origin"), (x + jitter(1)).alias("x"), (y + jitter(2)).alias("y"), F.lit(float(t0)).alias("seed_time"))
    return R._checkpoint(mask_from_points(X.usable(X.simulate(seeds, field, t0, t_obs)), cell_m))


def calibration_trial(spark: SparkSession, field: X.Field, x: float, y: float, t0: float, t_obs: float, p: InversionParams = InversionParams()) -> DataFrame:
    """Whether the posterior of a planted release contains it, by cell: inside_50, inside_95, areas and the effective sample share."""
    mask = planted_mask(field, spark, x, y, t0, t_obs, p.cell_m)
    cells = Q.density(invert(spark, field, mask, t_obs, p).withColumn("ix", F.floor(F.col("x") / 4000.0)).withColumn("iy", F.floor(F.col("y") / 4000.0)), ["iy", "ix"])
    sets = Q.nested_levels(cells, 0.5, 0.95, ["iy", "ix"])
    here = (F.col("ix") == math.floor(x / 4000.0)) & (F.col("iy") == math.floor(y / 4000.0))
    return sets.agg(
        F.coalesce(F.bool_or(here & F.col("in_inner")), F.lit(False)).alias("inside_50"), F.coalesce(F.bool_or(here), F.lit(False)).alias("inside_95"),
        (F.count_if("in_inner") * 16.0).alias("area_50_km2"), (F.count("*") * 16.0).alias("area_95_km2"),
    )


QUERIES, ORACLE_SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def detect_scene(spark, sf_dir):
    """Detection on a generated scene with a slick drawn in."""
    rows, cols = 70, 90
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    wind = 7.0 + 0.01 * F.col("row")
    db = G.backscatter_db(wind, 30.5 + F.col("col") / 6.0, F.lit(False)) + 10 * F.log10(G.speckle(3, 8, F.col("row"), F.col("col")))
    slick = G.damping_db(F.when((F.pow(F.col("row") - 30, 2) / 16 + F.pow(F.col("col") - 45, 2) / 300) < 1, 5e-4).otherwise(0.0))
    scene = grid.select("row", "col", (db + slick).alias("value"), (F.col("row") > 66).alias("land"))
    course = grid.filter((F.col("row") == 30) & F.col("col").between(30, 60)).select("row", "col", F.lit(90.0).alias("heading_deg"))
    lanes = spark.range(9).select(F.col("id").alias("cx"), F.lit(5).cast("long").alias("cy"))
    found = detect(scene, rows, cols, 7.0, 0.01, wind=grid.select("row", "col", wind.alias("wind")), headings=course, lanes=lanes, incidence_deg=grid.select("row", "col", (30.5 + F.col("col") / 6.0).alias("incidence_deg")))
    return found


def _case(spark):
    field = synthetic_field(spark)
    t_obs = 24 * 3600.0
    x, y = field.x0 + 60_000.0, field.y0 + 70_000.0
    return field, planted_mask(field, spark, x, y, 12 * 3600.0, t_obs, 2000.0), t_obs, x, y


@query
def invert_planted(spark, sf_dir):
    """Posterior cells of a release planted 12 hours before the field's end, which leaves 36 hours to look back."""
    field, t_obs = synthetic_field(spark), 48 * 3600.0
    mask = planted_mask(field, spark, field.x0 + 60_000.0, field.y0 + 70_000.0, 36 * 3600.0, t_obs, 2000.0)
    found = invert(spark, field, mask, t_obs, FULL_INVERSION)
    return Q.density(found.withColumn("ix", F.floor(F.col("x") / 4000.0)).withColumn("iy", F.floor(F.col("y") / 4000.0)), ["iy", "ix"])


@query
def attribute_traffic(spark, sf_dir):
    """Candidates among generated traffic for a planted release."""
    field, mask, t_obs, x, y = _case(spark)
    tracks = P.reconstruct(G.traffic(spark, 40, 30))
    windows = [float(h * 3600) for h in range(6, 24, 3)]
    corners = [(x + i * 20_000.0, y + j * 20_000.0) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    lon, lat = utm_inverse(F.col("x"), F.col("y"), F.lit(ZONE))
    ring = [(r["lon"], r["lat"]) for r in spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "i int, x double, y double").orderBy("i").select(lon.alias("lon"), lat.alias("lat")).collect()]
    return attribute(field, mask, tracks, windows, 3 * 3600.0, t_obs, 2000.0, 1_704_067_200_000_000, ring)


@query
def forecast_mask(spark, sf_dir):
    """The planted slick 6, 12 and 24 hours on: cells by state."""
    field, mask, t_obs, _, _ = _case(spark)
    return forecast(field, mask, t_obs, 2000.0, (6, 12, 24)).groupBy("horizon_h", "state").agg(F.count("*").alias("cells"))


@query
def session_stream(spark, sf_dir):
    """Sessions of the position log through Structured Streaming, over the files that are there. A last row far beyond the log closes the sessions
    that its end leaves open; its own session stays open and is not returned."""
    import uuid

    from tidemark.operators.raster import _checkpoint
    from tidemark.plans.tables import positions
    from tidemark.streaming import positions as stream

    log = positions(spark, sf_dir).filter(P.valid_coordinate()).select("mmsi", F.timestamp_micros("t_us").alias("timestamp"), "lon", "lat")
    _checkpoint(log.limit(0))  # makes sure that a shared folder is set
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/tidemark-stream-{uuid.uuid4().hex}"
    log.repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.parquet(f"{path}/in")
    source = spark.readStream.schema(log.schema).parquet(f"{path}/in")
    drain = lambda: stream.sessions(source, "24 hours").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    drain()
    end = log.agg((F.max("timestamp") + F.expr("interval 30 days")).alias("timestamp")).filter("timestamp is not null")
    end.select(F.lit("").alias("mmsi"), "timestamp", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")).write.mode("append").parquet(f"{path}/in")
    drain()
    return spark.read.schema("mmsi string, t_start timestamp, t_end timestamp, n_fixes long").parquet(f"{path}/out")
