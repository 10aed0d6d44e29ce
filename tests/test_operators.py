"""Operators on small inputs whose results are known."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.rng import hash_uniform
from tidemark.operators import contracts as C
from tidemark.operators import evaluation as V
from tidemark.operators import evidence as E
from tidemark.operators import generate as G
from tidemark.operators import positions as P
from tidemark.operators import posterior as Q
from tidemark.operators import raster as R
from tidemark.operators import spatial as S
from tidemark.operators import temporal as T
from tidemark.operators import transport as X
from tidemark.plans import pipelines

H = P.HOUR_US
LOG = "ord long, mmsi string, t_us long, lon double, lat double, sog_kn double, cog_deg double, ship_type string"


def track(spark, times_h, mmsi="000000001", step=0.002):
    return spark.createDataFrame([(i, mmsi, int(t * H), 11 + step * i, 57 + step / 2 * i, 12.0, 60.0, "Cargo") for i, t in enumerate(times_h)], LOG)


def test_split_and_gap_counts(spark):
    log = track(spark, [i / 30 for i in range(60)] + [11 + i / 30 for i in range(60)])
    report = P.cleaning_report(log).first()
    assert (report["tracks_split_on_gap"], report["tracks_out"], report["rows_out"]) == (1, 2, 120)


def test_strict_refuses_teleports(spark):
    log = spark.createDataFrame([(i, "000000001", i * 2_000_000, 11 + 0.5 * (i % 2), 57.0, 12.0, 60.0, "Cargo") for i in range(400)], LOG)
    assert P.cleaning_report(log).first()["dropped_speed_jump"] == 399
    with pytest.raises(Exception, match="speed filter"):
        P.assert_sane(P.cleaning_report(log)).collect()


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert P.reconstruct(log).count() == 0
    assert P.cleaning_report(log).first()["rows_in"] == 0
    assert P.baseline_gap(P.reconstruct(log), 0.5).first()["baseline_us"] == 0


def test_gap_overlap_and_interpolation(spark):
    log = track(spark, [0, 0.1, 0.2, 2.2, 2.3]).withColumn("track", F.lit(0).cast("long"))
    gaps = P.gaps(log, 0.5)
    windows = spark.createDataFrame([("000000001", 0, 0, 4 * H), ("000000001", 0, int(1.2 * H), 4 * H), ("000000001", 0, 3 * H, 4 * H)], "mmsi string, track long, w_from long, w_to long")
    assert sorted(round(r["gap_hours"], 6) for r in T.gap_overlap(gaps, windows).collect()) == [0.0, 1.0, 2.0]
    probes = spark.createDataFrame([("000000001", 0, int(h * H)) for h in (-1, 0.15, 1.2, 9)], "mmsi string, track long, probe_us long")
    got = {r["probe_us"]: r for r in T.asof_interpolate(log, probes, gaps).collect()}
    assert got[-H]["lon"] == 11 and got[9 * H]["lon"] == pytest.approx(11.008)
    assert got[int(1.2 * H)]["in_gap"] and not got[int(0.15 * H)]["in_gap"]
    assert got[int(1.2 * H)]["lon"] == pytest.approx(11.005)


def test_circular_mean_wraps(spark):
    rows = spark.createDataFrame([(0, "1", 0, 0.0, 0.0, 1.0, 350.0, "Cargo"), (1, "1", 1, 0.0, 0.0, 1.0, 10.0, "Cargo")], LOG).withColumn("track", F.lit(0).cast("long"))
    moments = spark.createDataFrame([("1", 0, 0)], "mmsi string, track long, t_mid long")
    assert T.heading_near(rows, moments).first()["heading_deg"] % 360 == pytest.approx(0, abs=1e-9)


def test_utm_round_trip_within_a_millimetre(spark):
    rows = spark.createDataFrame([(lon, lat) for lon in (9.1, 10.2, 12.8) for lat in (1.0, 45.0, 57.25, 80.0)], "lon double, lat double")
    x, y = geo.utm_forward(F.col("lon"), F.col("lat"), F.lit(32))
    lon, lat = geo.utm_inverse(F.col("x"), F.col("y"), F.lit(32))
    worst = rows.withColumn("x", x).withColumn("y", y).select(F.max(F.abs(lon - F.col("lon"))).alias("a"), F.max(F.abs(lat - F.col("lat"))).alias("b")).first()
    assert max(worst) < 1.5e-8
    centre = spark.range(1).select(*geo.utm_forward(F.lit(9.0), F.lit(0.0), F.lit(32))).first()
    assert centre[0] == pytest.approx(500_000) and centre[1] == pytest.approx(0, abs=1e-6)


def test_convergence_turns_true_north_onto_the_grid(spark):
    lon, lat, zone = F.lit(11.5), F.lit(57.25), F.lit(32)
    (x0, y0), (x1, y1) = geo.utm_forward(lon, lat, zone), geo.utm_forward(lon, lat + 0.001, zone)
    east, north = geo.to_grid_vector(F.lit(0.0), F.lit(1.0), geo.grid_convergence(lon, lat, zone))
    row = spark.range(1).select((x1 - x0).alias("dx"), (y1 - y0).alias("dy"), east.alias("e"), north.alias("n")).first()
    assert math.atan2(row["dx"], row["dy"]) == pytest.approx(math.atan2(row["e"], row["n"]), abs=1e-4)


@pytest.mark.parametrize("wind, allowed", [(0.0, False), (1.4, False), (2.9, False), (3.0, True), (6.4, True), (12.0, True), (12.1, False), (18.0, False)])
def test_wind_gate(spark, wind, allowed):
    assert (spark.range(1).select(E.wind_gate(F.lit(wind))).first()[0] is None) == allowed


def test_log_sum_exp_of_nothing_finite(spark):
    rows = spark.createDataFrame([(1, float("-inf")), (1, float("-inf")), (2, 0.0), (2, float("-inf"))], "k int, v double")
    got = {r["k"]: r["o"] for r in E.log_sum_exp(rows, ["k"], "v", "o").collect()}
    assert got[1] == float("-inf") and got[2] == pytest.approx(0.0)


def test_combination_sums_to_one(spark):
    rows = spark.createDataFrame([(i, float(-i), 1.0 + i) for i in range(5)], "mover int, log_marginal double, prior double")
    out = E.rebalance(E.rank(E.combine(rows, -2.0, 0.15), ["mover"])).collect()
    assert sum(r["probability"] for r in out) + out[0]["dark_probability"] == pytest.approx(1)
    assert [r["rank"] for r in sorted(out, key=lambda r: -r["probability"])] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("weights, each, expected", [([1.0, 0, 0], 100, 100), ([0.25] * 4, 100, 400)])
def test_effective_sample_size(spark, weights, each, expected):
    assert Q.effective_sample_size(spark.createDataFrame([(w,) for w in map(float, weights)], "weight double"), each).first()["ess"] == expected


def test_loglik_against_brute_force(spark):
    rng = np.random.default_rng(0)
    points = [(int(h), int(x), int(y), bool(u)) for h, x, y, u in zip(rng.integers(0, 4, 500), rng.integers(0, 8, 500), rng.integers(0, 8, 500), rng.random(500) < 0.9, strict=True)]
    oil = [(x, y) for x in range(2, 5) for y in range(3, 6)]
    mask = spark.createDataFrame([(x, y, "oil") for x, y in oil] + [(1, 1, "annulus")], "ix int, iy int, state string")
    got = {r["hyp"]: r["log_lik"] for r in Q.bernoulli_loglik(spark.createDataFrame(points, "hyp int, ix int, iy int, usable boolean"), mask).collect()}
    for h in range(4):
        mine = [(x, y) for k, x, y, u in points if k == h and u]
        q = [0.01 + 0.99 * (1 - math.exp(-2.5 * mine.count(c) * len(oil) / len(mine))) for c in oil]
        outside = sum(c not in oil and c != (1, 1) for c in mine) / len(mine)
        assert got[h] == pytest.approx(sum(map(math.log, q)) - 2.5 * outside * len(oil))


@pytest.mark.parametrize("u, v, uw, hours, expected", [(1.0, 0.0, 0.0, 1, (3600, 0)), (0.0, 0.5, 0.0, 2, (0, 3600)), (0.0, 0.0, 10.0, 1, (720, 0)), (0.0, 0.0, 0.0, 1, (0, 0))])
def test_uniform_transport(u, v, uw, hours, expected):
    full = lambda x: np.full((73, 60, 60), x)
    field = X.Field(400_000, 6_200_000, 2000, 2000, 0, 3600, full(u), full(v), full(uw), full(0.0), np.zeros((60, 60), bool))
    start = np.array([450_000.0]), np.array([6_250_000.0])
    x, y, state = X.run_particles(field, *start, np.zeros(1), np.full(1, 0.02), np.ones(1), np.zeros(1, int), 0.0, hours * 3600.0, X.TransportParams(diffusion=False))
    assert (x[0] - 450_000, y[0] - 6_250_000) == pytest.approx(expected, abs=1) and state[0] == X.ACTIVE


def test_transport_does_not_depend_on_partitions(spark):
    from tidemark.plans.raster_queries import uniform_field

    seeds = spark.range(500).select(F.col("id").alias("particle_id"), F.lit(0).cast("long").alias("origin"), F.lit(450_000.0).alias("x"), F.lit(6_250_000.0).alias("y"), F.lit(0.0).alias("seed_time"))
    runs = [X.simulate(seeds.repartition(n), uniform_field(), 0.0, 7200.0).orderBy("particle_id").collect() for n in (1, 7)]
    assert runs[0] == runs[1]
    with pytest.raises(ValueError, match="backward"):
        X.simulate(seeds, uniform_field(), 7200.0, 0.0)


def test_components_and_outline(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 5), (6, 6), (9, 0)], "row int, col int")
    sizes = sorted(r["count"] for r in R.label_components(cells).groupBy("patch").count().collect())
    assert sizes == [1, 2, 3]
    ring = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    areas = sorted(abs(r["area"]) for r in R.outlines(spark.createDataFrame(ring, "row int, col int")).collect())
    assert areas == [1.0, 9.0]


def test_masks_of_nothing(spark):
    none = spark.createDataFrame([], "row int, col int")
    assert R.dilate(none).count() == R.erode(none).count() == 0
    assert tuple(R.overlap_scores(none, none).first()) == (0.0, 0.0)


def test_hash_uniform_is_uniform(spark):
    row = spark.range(20_000).select(hash_uniform(1, 2, F.col("id")).alias("u")).agg(F.avg("u"), F.var_pop("u"), F.min("u"), F.max("u")).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and row[1] == pytest.approx(1 / 12, abs=0.003) and 0 < row[2] and row[3] < 1


def test_contracts(spark):
    rows = spark.createDataFrame([(True, "undetermined", 1.4), (False, "oil", 6.0), (True, "oil", 6.0), (False, "oil", 15.0)], "abstained boolean, kind string, wind double")
    rules = {"abstention": C.abstention_consistent("abstained", "kind"), "gate": C.wind_gate_enforced("wind", "kind")}
    assert {r["rule"]: r["violated"] for r in C.violations(rows, rules).collect()} == {"abstention": 1, "gate": 1}
    with pytest.raises(Exception, match="contract broken"):
        C.enforce(rows, rules).collect()
    with pytest.raises(ValueError, match="missing"):
        C.assert_schema(rows, ("mmsi",))
    with pytest.raises(ValueError, match="instant"):
        C.assert_utc(rows.withColumn("t", F.lit("2024-01-01").cast("timestamp_ntz")), "t")


def test_external_log(spark, tmp_path):
    from tidemark.sources.readers import read_external_log

    (tmp_path / "log.csv").write_text(
        "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,COG\n01/02/2024 03:04:05,A,1234567,57.0,11.0,9.5,80\nnot-a-date,A,1234567,57.0,11.0,9.5,80\n"
        "01/02/2024 03:04:06,A,1234567,,11.0,9.5,80\n01/02/2024 03:04:07,A,1234567,57.0,20.0,9.5,80\n"
    )
    kept, counts = read_external_log(spark, str(tmp_path / "log.csv"), box=(10, 56, 13, 58))
    row = kept.first()
    assert row["mmsi"] == "001234567" and row["timestamp"] == dt.datetime(2024, 2, 1, 3, 4, 5) and row["heading_deg"] == 80
    assert {r["reason"]: r["rows"] for r in counts.collect()} == {"kept": 1, "bad timestamp": 1, "missing value": 1, "outside the area": 1}


def test_grid_normalisation(spark):
    from tidemark.sources.readers import normalise_grid, subset

    when = dt.datetime(2024, 1, 1)
    grid = spark.createDataFrame([(when, d, 57.0, lon, 1.0) for d in (0.5, 5.0) for lon in (359.0, 11.0)], "valid_time timestamp, depth double, lat double, lon double, u double")
    out = normalise_grid(grid)
    assert sorted(r["longitude"] for r in out.collect()) == [-1.0, 11.0]
    assert subset(out, (10, 56, 12, 58), when, when).count() == 1
    with pytest.raises(ValueError, match="latitude"):
        normalise_grid(grid.drop("lat"))


def test_manifest_and_parameters(spark, tmp_path):
    from tidemark.sources import readers, sinks

    (tmp_path / "p.yaml").write_text("transport: {step_s: 600, alpha: [0.02, 0.03]}\n")
    assert readers.read_parameters(tmp_path / "p.yaml", "transport", X.TransportParams).alpha == (0.02, 0.03)
    (tmp_path / "q.yaml").write_text("transport: {speed: 1}\n")
    with pytest.raises(ValueError, match="unknown"):
        readers.read_parameters(tmp_path / "q.yaml", "transport", X.TransportParams)
    folder = tmp_path / "cases/one"
    folder.mkdir(parents=True)
    (folder / "case.json").write_text('{"case_id":"one","seed":1,"t_start":"2024-01-01T00:00:00Z","t_obs":"2024-01-02T00:00:00Z","aoi":{"min_lon":1,"min_lat":1,"max_lon":2,"max_lat":2}}')
    assert readers.list_cases(spark, str(tmp_path / "cases")).first()["case_id"] == "one"
    grid = spark.createDataFrame([(1.0, float("nan")), (None, 2.0), (3.0, 4.0)], "u double, v double")
    assert sinks.write_currents(grid, str(tmp_path / "c")).first()["missing_share"] == pytest.approx(1 / 3)
    assert spark.read.parquet(str(tmp_path / "c")).filter("u = 0 or v = 0").count() == 2


def test_degenerate_gate_is_reported(spark):
    rows = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 5.0).alias("a"), (F.col("id") % 7 * 1.0).alias("b"))
    model, _, _ = V.train_gate(rows, ["a", "b"], trees=2)
    assert V.single_feature_share(model, ["a", "b"])[1]


def test_dark_samples_and_prefilter(spark):
    samples = spark.createDataFrame([(1, 0, 11.0, 57.0), (2, 0, 12.0, 57.0), (3, 5, 11.0, 57.0)], "sample int, t_us long, lon double, lat double")
    movers = spark.createDataFrame([(0, 11.05, 57.02)], "t_us long, lon double, lat double")
    assert sorted(r["sample"] for r in S.unexplained(samples, movers, 0.1).collect()) == [2, 3]
    square = [(11.0, 57.0), (12.0, 57.0), (12.0, 58.0), (11.0, 58.0), (11.0, 57.0)]
    fixes = spark.createDataFrame([("a", 0, 0, 11.5, 57.5), ("b", 0, 0, 12.2, 57.5), ("c", 0, 0, 14.0, 57.5), ("d", 0, 99 * H, 11.5, 57.5)], "mmsi string, track long, t_us long, lon double, lat double")
    assert sorted(r["mmsi"] for r in S.prefilter(fixes, square, 0, H).collect()) == ["a", "b"]


def test_stream_matches_batch(spark, tmp_path):
    from tidemark.streaming import positions as stream

    log = G.traffic(spark, 3, 5).select("mmsi", F.timestamp_micros("t_us").alias("timestamp"), "lon", "lat", F.lit(12.0).alias("sog_kn"), "ord", "t_us")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    got = stream.collected(stream.speed_filter(source), "kept").count()
    assert got == P.drop_speed_jumps(log, 40.0).count()
    assert stream.collected(stream.dedupe(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))), "once").count() == log.select("mmsi", "timestamp").distinct().count()


def test_planted_release_is_found(spark):
    field = pipelines.synthetic_field(spark)
    p = pipelines.InversionParams(max_hypotheses=200, each=12)
    row = pipelines.calibration_trial(spark, field, field.x0 + 60_000, field.y0 + 70_000, 12 * 3600.0, 24 * 3600.0, p).first()
    assert row["area_95_km2"] >= row["area_50_km2"] > 0


def test_stages_follow_their_inputs(spark, tmp_path):
    import time

    from tidemark.plans.stages import Runner, Stage

    made = []

    def stage(name, needs):
        def make(spark, tables):
            made.append(name)
            return spark.range(1 + sum(t.count() for t in tables.values() if t is not None))

        return Stage(name, needs, make)

    stages = (stage("a", ()), stage("b", ("a",)), stage("c", ("b",)))
    run = lambda only=None: Runner(spark, str(tmp_path / "case"), stages).run(only)
    run({"b"})
    assert made == ["a", "b"]
    run()
    assert made == ["a", "b", "c"]
    time.sleep(1.1)
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "case/a"))
    run()
    assert made == ["a", "b", "c", "b", "c"]
    with pytest.raises(ValueError, match="unknown"):
        run({"x"})


def test_hypotheses_around_the_proposal(spark):
    points = spark.createDataFrame([(100.0, 100.0, 0.0)], "x double, y double, t0 double")
    grid, cell = X.hypothesis_grid(points, 1000.0, 100, margin=2000.0)
    assert cell == 1000.0 and {(r["ix"], r["iy"]) for r in grid.collect()} == {(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) <= 2}


def test_planted_inversion_has_the_original_settings(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(pipelines, "synthetic_field", lambda s: X.Field(0.0, 0.0, 4000.0, 4000.0, 0.0, 3600.0, *[np.zeros((49, 60, 60))] * 4, np.zeros((60, 60), bool)))
    monkeypatch.setattr(pipelines, "invert", lambda s, f, m, t, p: asked.append((t, p)) or m.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0)).withColumn("weight", F.lit(1.0)))
    pipelines.QUERIES["invert_planted"](spark, sf)
    t, p = asked[0]
    assert (p.lookback_h, p.bin_h, p.each, p.each_refined, p.max_hypotheses, p.proposal, p.margin_m) == (36.0, 1.0, 40, 110, 4096, 3000, 15_000.0) and t >= p.lookback_h * 3600


def test_session_stream_returns_the_last_sessions(spark, sf):
    from tidemark.plans.tables import positions

    log = positions(spark, sf).filter(P.valid_coordinate()).select("mmsi", F.timestamp_micros("t_us").alias("timestamp"))
    want = log.groupBy("mmsi", F.session_window("timestamp", "24 hours")).agg(F.count("*").alias("n_fixes"), F.max("timestamp").alias("t_end"))
    got = pipelines.QUERIES["session_stream"](spark, sf)
    assert sorted(map(tuple, got.select("mmsi", "t_end", "n_fixes").collect())) == sorted(map(tuple, want.select("mmsi", "t_end", "n_fixes").collect()))


def test_components_that_do_not_settle_raise(spark):
    cells = spark.createDataFrame([(0, c) for c in range(200)], "row int, col int")
    with pytest.raises(RuntimeError):
        R.label_components(cells, max_rounds=2)


def test_rebalance_is_case_by_case(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 0.2), (1, 2, 0.2, 0.2), (2, 1, 0.6, 0.3)], "case_id int, rank int, probability double, dark_probability double")
    got = {(r["case_id"], r["rank"]): r["probability"] for r in E.rebalance(rows, keys=["case_id"]).collect()}
    assert got == pytest.approx({(1, 1): 0.6, (1, 2): 0.2, (2, 1): 0.7})


def test_trails_are_one_run(spark):
    from tidemark.plans.raster_queries import uniform_field

    seeds = spark.createDataFrame([(i, 0, 430_000.0 + 100 * i, 6_230_000.0, 1800.0 * (i % 3)) for i in range(20)], "particle_id long, origin long, x double, y double, seed_time double")
    whole = {r["particle_id"]: (r["x"], r["y"], r["status"]) for r in X.simulate(seeds, uniform_field(), 0.0, 21_600.0).collect()}
    last = {r["particle_id"]: (r["x"], r["y"], r["status"]) for r in X.trails(seeds, uniform_field(), 0.0, [7200.0, 14_400.0, 21_600.0]).filter("t = 21600").collect()}
    assert last == whole
    assert X.trails(seeds, uniform_field(), 0.0, [900.0], first=3).count() == 6
    with pytest.raises(ValueError):
        X.trails(seeds, uniform_field(), 0.0, [1000.0])


def test_dark_sources_keep_away_from_tracks(spark):
    from tidemark.plans.pipelines import dark_sources

    ring = [(10.0, 56.0), (10.4, 56.0), (10.4, 56.2), (10.0, 56.2), (10.0, 56.0)]
    fixes = [("000000001", 0, k * 600_000_000, 10.2, 56.0 + 0.2 * k / 60, k) for k in range(61)]
    tracks = spark.createDataFrame(fixes, "mmsi string, track long, t_us long, lon double, lat double, ord long")
    got = dark_sources(tracks, ring, [0.0, 14_400.0], 7200.0, 0, 40, 3.0).collect()
    assert 0 < len(got) <= 40
    wide = 3.0 / (111.32 * np.cos(np.radians(56.1)))
    for r in got:
        at = 56.0 + 0.2 * r["t"] / 36_000
        assert not (abs(r["lon"] - 10.2) < wide and abs(r["lat"] - at) < wide)


def test_speed_notes_round_as_sql_does(spark, tmp_path):
    """Medians such as 6.949999999999999, which times ten is 69.5."""
    import duckdb

    from tidemark.plans import catalog

    pairs = [(a, 13900 - a) for a in range(6500, 6950) if (m := 0.5 * (a / 100 / 10) + 0.5 * ((13900 - a) / 100 / 10)) < 6.95 and m * 10 == 69.5][:5]
    assert pairs
    path = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    for user, (a, b) in enumerate(pairs):
        for i, v in enumerate((a, b, a - 100, b + 100)):
            con.execute("insert into e values (?, timestamp '2024-01-02' + to_hours(?), ?, 'x', ?, '{}')", [1 + user * 4 + i, 3 * i, user, v / 100])
    con.execute(f"copy e to '{path}' (format parquet)")
    con.execute(f"create view events as select * from '{path}'")
    want = con.execute(catalog.ORACLE_SQL["speed_notes"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["speed_notes"](spark, str(tmp_path)).select("mmsi", "track", "note").collect()]
    assert len(got) == len(pairs) and sorted(got) == sorted(want)
