"""Lagrangian transport of independent particles, in batches of numpy over Arrow, and the sampling around it.

Particles never interact: a run is one narrow stage without a shuffle. The forcing is bounded by its grid (tens of
megabytes), is checked against `MAX_FIELD_BYTES`, and is broadcast; noise is a counter-based function of particle and step, so results do
not depend on partitioning or retries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import grid_convergence, to_grid_vector, utm_inverse
from tidemark.functions.rng import hash_uniform
from tidemark.operators.spatial import resample
from tidemark.sources.readers import axes_agree

ACTIVE, BEACHED, EXITED, PENDING = 1, 2, 3, 0
MAX_FIELD_BYTES = 512 << 20


@dataclass(frozen=True)
class Field:
    """Currents u, v and wind uw, vw as (time, y, x), land as (y, x); x and y in metres, t in seconds."""

    x0: float
    y0: float
    dx: float
    dy: float
    t0: float
    dt: float
    u: np.ndarray
    v: np.ndarray
    uw: np.ndarray
    vw: np.ndarray
    land: np.ndarray

    def __post_init__(self):
        if sum(a.nbytes for a in (self.u, self.v, self.uw, self.vw, self.land)) > MAX_FIELD_BYTES:
            raise ValueError("the field is too large to broadcast; cut it by region or time first")

    def covers(self, t: float) -> bool:
        return self.t0 <= t <= self.t0 + (len(self.u) - 1) * self.dt

    def _at(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        ny, nx = self.land.shape
        fx, fy = np.clip((x - self.x0) / self.dx, 0, nx - 1.001), np.clip((y - self.y0) / self.dy, 0, ny - 1.001)
        ix, iy = fx.astype(int), fy.astype(int)
        p, q = fx - ix, fy - iy
        ft = min(max((t - self.t0) / self.dt, 0.0), len(a) - 1.0)
        k = min(int(ft), max(len(a) - 2, 0))
        w = ft - k
        out = []
        for grid in (a, b):
            value = 0.0
            for layer, share in ((k, 1 - w), (min(k + 1, len(grid) - 1), w)):
                g = grid[layer]
                value = value + share * ((g[iy, ix] * (1 - p) + g[iy, ix + 1] * p) * (1 - q) + (g[iy + 1, ix] * (1 - p) + g[iy + 1, ix + 1] * p) * q)
            out.append(value)
        return out[0], out[1]

    def current(self, x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        return self._at(self.u, self.v, x, y, t)

    def wind(self, x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        return self._at(self.uw, self.vw, x, y, t)

    def inside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ny, nx = self.land.shape
        return (x >= self.x0) & (x <= self.x0 + (nx - 1) * self.dx) & (y >= self.y0) & (y <= self.y0 + (ny - 1) * self.dy)

    def is_land(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ny, nx = self.land.shape
        return self.land[np.clip(((y - self.y0) / self.dy).astype(int), 0, ny - 1), np.clip(((x - self.x0) / self.dx).astype(int), 0, nx - 1)]


@dataclass(frozen=True)
class TransportParams:
    step_s: float = 900.0
    alpha: tuple[float, float] = (0.01, 0.04)
    diffusivity: tuple[float, float] = (1.0, 10.0)
    diffusion: bool = True
    windage: bool = True
    seed: int = 0


def proposal(params: TransportParams = TransportParams()) -> TransportParams:
    """Parameters of a backward run: no diffusion, windage fixed at its middle."""
    mid = sum(params.alpha) / 2
    return TransportParams(params.step_s, (mid, mid), params.diffusivity, False, params.windage, params.seed)


def with_parameters(seeds: DataFrame, params: TransportParams) -> DataFrame:
    """alpha (uniform) and kh (log-uniform) for each particle, drawn by its id."""
    a, k = params.alpha, params.diffusivity
    return seeds.withColumn("alpha", a[0] + (a[1] - a[0]) * hash_uniform(params.seed, 1, F.col("particle_id"))).withColumn(
        "kh", F.exp(float(np.log(k[0])) + float(np.log(k[1] / k[0])) * hash_uniform(params.seed, 2, F.col("particle_id")))
    )


def _normals(ids: np.ndarray, step: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03 + seed * 0x94D049BB133111EB) & (2**64 - 1))
        draws = []
        for _ in range(2):
            z = z + np.uint64(0x9E3779B97F4A7C15)
            v = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            draws.append(((v ^ (v >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)
    radius = np.sqrt(-2 * np.log(draws[0]))
    return radius * np.cos(2 * np.pi * draws[1]), radius * np.sin(2 * np.pi * draws[1])


def run_particles(field: Field, x, y, seed_time, alpha, kh, ids, t_start: float, t_end: float, params: TransportParams, state=None, step: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and states at t_end. RK4 advection, windage at the step's middle, Euler-Maruyama diffusion; a particle
    that leaves the grid or meets land stays where it was before. The last step is cut to end on t_end. state and step go on from
    an earlier run of whole steps."""
    x, y = x.astype(float).copy(), y.astype(float).copy()
    sign = 1.0 if t_end >= t_start else -1.0
    if state is None:
        state = np.where((seed_time <= t_start) if sign > 0 else (seed_time >= t_start), ACTIVE, PENDING).astype(np.int8)
    state, t = state.copy(), t_start
    while sign * (t_end - t) > 1e-9:
        h = sign * min(params.step_s, abs(t_end - t))
        due = (seed_time <= t + h) if sign > 0 else (seed_time >= t + h)
        state[(state == PENDING) & due] = ACTIVE
        on = np.flatnonzero(state == ACTIVE)
        if len(on):
            px, py = x[on], y[on]
            wind_u, wind_v = field.wind(px, py, t + h / 2) if params.windage else (0.0, 0.0)
            drift_u, drift_v = alpha[on] * wind_u, alpha[on] * wind_v
            k1 = field.current(px, py, t)
            k2 = field.current(px + h / 2 * (k1[0] + drift_u), py + h / 2 * (k1[1] + drift_v), t + h / 2)
            k3 = field.current(px + h / 2 * (k2[0] + drift_u), py + h / 2 * (k2[1] + drift_v), t + h / 2)
            k4 = field.current(px + h * (k3[0] + drift_u), py + h * (k3[1] + drift_v), t + h)
            nx = px + h * ((k1[0] + 2 * k2[0] + 2 * k3[0] + k4[0]) / 6 + drift_u)
            ny = py + h * ((k1[1] + 2 * k2[1] + 2 * k3[1] + k4[1]) / 6 + drift_v)
            if params.diffusion:
                zx, zy = _normals(ids[on], step, params.seed)
                spread = np.sqrt(2 * kh[on] * abs(h))
                nx, ny = nx + spread * zx, ny + spread * zy
            gone = ~field.inside(nx, ny)
            ashore = ~gone & field.is_land(nx, ny)
            moved = ~gone & ~ashore
            x[on[moved]], y[on[moved]] = nx[moved], ny[moved]
            state[on[gone]], state[on[ashore]] = EXITED, BEACHED
        t, step = t + h, step + 1
    return x, y, state


def simulate(seeds: DataFrame, field: Field, t_start: float, t_end: float, params: TransportParams = TransportParams(), batch_rows: int = 50_000) -> DataFrame:
    """(particle_id, origin, x, y, status, alpha, kh) of seeds (particle_id, origin, x, y, seed_time)."""
    if t_start == t_end:
        raise ValueError("the window has no length")
    if t_end < t_start and params.diffusion:
        raise ValueError("diffusion can't run backward")
    if not (field.covers(t_start) and field.covers(t_end)):
        raise ValueError("the window is outside the forcing")
    held = seeds.sparkSession.sparkContext.broadcast(field)
    rows = with_parameters(seeds, params).select("particle_id", "origin", "x", "y", "seed_time", "alpha", "kh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), batch_rows):
                part = batch.slice(begin, batch_rows)
                ids, x, y, seed_time, alpha, kh = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("particle_id", "x", "y", "seed_time", "alpha", "kh"))
                x, y, state = run_particles(held.value, x, y, seed_time, alpha, kh, ids, t_start, t_end, params)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x), pa.array(y), pa.array(state), part.column(5), part.column(6)], names=["particle_id", "origin", "x", "y", "status", "alpha", "kh"])

    return rows.mapInArrow(run, "particle_id long, origin long, x double, y double, status byte, alpha double, kh double")


def history(seeds: DataFrame, field: Field, t_start: float, times: list[float], params: TransportParams = TransportParams()) -> DataFrame:
    """(x, y, t0) of each usable particle of seeds, all released at t_start, at each of the times, which lead away from it. One that met
    land stays where it was before. Without diffusion, as no step has noise of its own here."""
    if params.diffusion:
        raise ValueError("diffusion has no place in a history")
    if not all(field.covers(t) for t in (t_start, *times)):
        raise ValueError("the window is outside the forcing")
    held = seeds.sparkSession.sparkContext.broadcast(field)
    rows = with_parameters(seeds, params).select("particle_id", "x", "y", "alpha", "kh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, y, alpha, kh = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x, y, state, now = x.astype(float), y.astype(float), np.full(len(x), ACTIVE, np.int8), t_start
            for t in times:
                on = np.flatnonzero(state == ACTIVE)
                x[on], y[on], state[on] = run_particles(held.value, x[on], y[on], np.full(len(on), now), alpha[on], kh[on], ids[on], now, t, params)
                good = state != EXITED
                now = t
                yield pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array(y[good]), pa.array(np.full(int(good.sum()), t))], names=["x", "y", "t0"])

    return rows.mapInArrow(run, "x double, y double, t0 double")


def trails(seeds: DataFrame, field: Field, t_start: float, times: list[float], params: TransportParams = TransportParams(), first: int | None = None) -> DataFrame:
    """(particle_id, origin, t, x, y, status) at t_start and each of the times, of all seeds or of the `first` ones by id. Times are whole
    steps apart and lead one way, so positions are those of one run to the last time; particles that wait, are ashore or have left
    are told by their status."""
    stops = [t_start, *times]
    hops = np.diff(stops)
    if not len(hops) or (hops > 0).any() and (hops < 0).any() or (hops == 0).any():
        raise ValueError("times must lead one way")
    if any(abs(h / params.step_s - round(h / params.step_s)) > 1e-9 for h in hops):
        raise ValueError("times must be whole steps apart")
    if hops[0] < 0 and params.diffusion:
        raise ValueError("diffusion can't run backward")
    if not all(field.covers(t) for t in stops):
        raise ValueError("the window is outside the forcing")
    held = seeds.sparkSession.sparkContext.broadcast(field)
    chosen = seeds if first is None else seeds.orderBy("particle_id").limit(first)
    rows = with_parameters(chosen, params).select("particle_id", "origin", "x", "y", "seed_time", "alpha", "kh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, x, y, seed_time, alpha, kh = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            state, step = None, 0
            for before, now in zip([None, *stops[:-1]], stops, strict=True):
                if before is None:
                    late = seed_time > t_start if hops[0] > 0 else seed_time < t_start
                    shown = np.where(late, PENDING, ACTIVE).astype(np.int8)
                else:
                    x, y, state = run_particles(held.value, x, y, seed_time, alpha, kh, ids, before, now, params, state, step)
                    shown, step = state, step + round(abs(now - before) / params.step_s)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(ids), float(now))), pa.array(x.astype(float)), pa.array(y.astype(float)), pa.array(shown)], names=["particle_id", "origin", "t", "x", "y", "status"])

    return rows.mapInArrow(run, "particle_id long, origin long, t double, x double, y double, status byte")


def field_from_grids(currents: DataFrame, winds: DataFrame, land: DataFrame | None, zone: int, x0: float, y0: float, cell_m: float, nx: int, ny: int) -> Field:
    """Read grids as a field on a metric grid of nx x ny nodes.

    currents and winds are (time, latitude, longitude, u, v) on regular axes of their own, true east and north, with the same times a
    fixed step apart; missing values count as 0. Both are interpolated to the nodes (beyond the grids their outer planes go on) and turned
    by the grid's convergence. land is (latitude, longitude) of land nodes of the currents' grid (null: none); a node takes its nearest. Sizes
    are checked before anything reaches the driver.
    """
    if not axes_agree(currents, winds):
        raise ValueError("currents and winds have different times")
    times = sorted(r["t"] for r in currents.select(F.unix_micros("time").alias("t")).distinct().limit(1 << 16).collect())  # a bounded axis
    steps = np.diff(times)
    if len(times) < 2 or (steps != steps[0]).any():
        raise ValueError("times must be a fixed step apart")
    if nx * ny * (len(times) * 32 + 1) > MAX_FIELD_BYTES:
        raise ValueError("the field is too large to broadcast; cut it by region or time first")
    spark = currents.sparkSession
    nodes = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("node_x"), F.floor(F.col("id") / nx).cast("int").alias("node_y"))
    lon, lat = utm_inverse(x0 + F.col("node_x") * cell_m, y0 + F.col("node_y") * cell_m, F.lit(zone))
    nodes = nodes.withColumn("lon", lon).withColumn("lat", lat).withColumn("convergence", grid_convergence(F.col("lon"), F.col("lat"), F.lit(zone)))

    def cube(grid: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        axis = grid.agg(*[f(c).alias(f"{n}_{c}") for c in ("longitude", "latitude") for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count_distinct))]).first()  # six scalars
        lon0, lat0, n_lon, n_lat = axis["lo_longitude"], axis["lo_latitude"], axis["n_longitude"], axis["n_latitude"]
        if min(n_lon, n_lat) < 2:
            raise ValueError("a grid needs two nodes on each axis")
        d_lon, d_lat = (axis["hi_longitude"] - lon0) / (n_lon - 1), (axis["hi_latitude"] - lat0) / (n_lat - 1)
        whole = lambda c: F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c)).cast("double").alias(c)
        placed = grid.select(F.unix_micros("time").alias("t_us"), F.round((F.col("latitude") - lat0) / d_lat).cast("int").alias("iy"), F.round((F.col("longitude") - lon0) / d_lon).cast("int").alias("ix"), whole("u"), whole("v"))
        asked = nodes.select("node_x", "node_y", "convergence", F.col("lon").alias("x"), F.col("lat").alias("y")).crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in times], "t_us long")))
        found = resample(asked, placed, ["u", "v"], lon0, lat0, d_lon, d_lat, n_lon, n_lat, keys=["t_us"])
        gx, gy = to_grid_vector(F.col("u"), F.col("v"), F.col("convergence"))
        rows = found.select("t_us", "node_y", "node_x", gx.alias("u"), gy.alias("v")).toPandas().sort_values(["t_us", "node_y", "node_x"])
        if len(rows) != len(times) * ny * nx:
            raise ValueError("a grid has holes: every time needs every node")
        return tuple(rows[c].to_numpy(float).reshape(len(times), ny, nx) for c in ("u", "v"))

    shore = np.zeros((ny, nx), bool)
    if land is not None:
        marks = currents.select("latitude", "longitude").distinct().join(land.select("latitude", "longitude").distinct().withColumn("land", F.lit(True)), ["latitude", "longitude"], "left")
        axis = marks.agg(F.min("longitude").alias("x"), F.min("latitude").alias("y"), F.max("longitude").alias("x1"), F.max("latitude").alias("y1"), F.count_distinct("longitude").alias("nx"), F.count_distinct("latitude").alias("ny")).first()
        d_lon, d_lat = (axis["x1"] - axis["x"]) / (axis["nx"] - 1), (axis["y1"] - axis["y"]) / (axis["ny"] - 1)
        near = lambda c, o, d, n: F.least(F.greatest(F.round((c - o) / d), F.lit(0)), F.lit(n - 1)).cast("int")
        at = marks.filter("land").select(near(F.col("longitude"), axis["x"], d_lon, axis["nx"]).alias("ix"), near(F.col("latitude"), axis["y"], d_lat, axis["ny"]).alias("iy")).distinct()
        hit = nodes.select("node_x", "node_y", near(F.col("lon"), axis["x"], d_lon, axis["nx"]).alias("ix"), near(F.col("lat"), axis["y"], d_lat, axis["ny"]).alias("iy")).join(at, ["ix", "iy"], "left_semi").toPandas()
        shore[hit["node_y"], hit["node_x"]] = True
    (u, v), (uw, vw) = cube(currents), cube(winds)
    return Field(x0, y0, cell_m, cell_m, 0.0, float(steps[0]) / 1e6, u, v, uw, vw, shore)


def outcomes(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy("status").agg(F.count("*").alias("n"))


def usable(trajectories: DataFrame) -> DataFrame:
    return trajectories.filter(F.col("status").isin(ACTIVE, BEACHED))


def hypothesis_seeds(grid: DataFrame, each: int, cell: float, seed: int = 0) -> DataFrame:
    """Seeds of hypotheses (hyp, x, y, t0): `each` particles spread over the hypothesis's cell."""
    rows = grid.select("hyp", "x", "y", "t0", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("m"))
    jitter = lambda stream: (hash_uniform(seed, stream, F.col("hyp"), F.col("m")) - 0.5) * cell
    return rows.select((F.col("hyp") * each + F.col("m")).alias("particle_id"), F.col("hyp").alias("origin"), (F.col("x") + jitter(11)).alias("x"), (F.col("y") + jitter(12)).alias("y"), F.col("t0").cast("double").alias("seed_time"))


def release_origin(mover: Column, bin_: Column) -> Column:
    """The source number of a mover's release window: 40 bits of a hash, the same wherever it is computed."""
    return F.xxhash64(mover.cast("string"), bin_.cast("long")).bitwiseAND((1 << 40) - 1)


def release_seeds(positions: DataFrame, each: int, window_s: float, seed: int = 0) -> DataFrame:
    """Seeds of movers by release window (mover, bin, w_from seconds, x, y): `each` particles over the window. origin is
    `release_origin`, so no order over all movers is needed and groups of seeds can be put together by union."""
    rows = positions.withColumn("origin", release_origin(F.col("mover"), F.col("bin"))).select("*", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("m"))
    when = F.col("w_from") + hash_uniform(seed, 13, F.col("origin"), F.col("m")) * window_s
    return rows.select((F.col("origin") * each + F.col("m")).cast("long").alias("particle_id"), F.col("origin").cast("long"), "x", "y", when.alias("seed_time"))


def sample_cells(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points (sample, ix, iy, dx, dy), uniform over the cells: the cell by rank, and a place in it."""
    spark = cells.sparkSession
    ranked = cells.select("ix", "iy", (F.row_number().over(Window.orderBy("iy", "ix")) - 1).alias("nth"))  # cells of one mask
    count = ranked.agg(F.count("*").alias("n"))
    draws = spark.range(n).select(F.col("id").alias("sample")).crossJoin(F.broadcast(count))
    draws = draws.filter("n > 0").select("sample", F.floor(hash_uniform(seed, 14, F.col("sample")) * F.col("n")).cast("int").alias("nth"))
    return draws.join(ranked, "nth").select("sample", "ix", "iy", hash_uniform(seed, 15, F.col("sample")).alias("dx"), hash_uniform(seed, 16, F.col("sample")).alias("dy"))


def accept_first(draws: DataFrame, n: int, key: str = "sample") -> DataFrame:
    """Rejection sampling: the first n accepted of draws that were all made at once (40 n of them give the usual bound)."""
    return draws.orderBy(key).limit(n)


def hypothesis_grid(proposal_points: DataFrame, cell: float, max_hypotheses: int, growth: float = 1.35, margin: float = 0.0) -> tuple[DataFrame, float]:
    """Distinct cells (ix, iy, t0) of backward points (x, y, t0), dilated by steps to the four sides as far as the margin, at least one,
    as a source can lie outside what a run without diffusion passes; none without a margin. Widened until there are few enough.
    Scalars alone reach the driver, once for each widening."""
    while True:
        found = proposal_points.select(F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy"), "t0").distinct()
        if margin > 0:
            pad = max(1, round(margin / cell))
            steps = [(i, j) for i in range(-pad, pad + 1) for j in range(abs(i) - pad, pad - abs(i) + 1)]
            around = found.withColumn("_by", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
            found = around.select((F.col("ix") + F.col("_by.i")).alias("ix"), (F.col("iy") + F.col("_by.j")).alias("iy"), "t0").distinct()
        if found.count() <= max_hypotheses:
            return found.withColumn("x", (F.col("ix") + 0.5) * cell).withColumn("y", (F.col("iy") + 0.5) * cell), cell
        cell *= growth
