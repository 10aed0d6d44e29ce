"""Sources: position logs, external CSV logs, gridded fields, scenes, tiles, manifests and parameters."""

from __future__ import annotations

import dataclasses
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.contracts import FORCING, MANIFEST, REQUIRED_LOG, assert_schema, assert_utc

#: Header names of the external log format, lower-cased, and the columns they become.
HEADERS = {
    "# timestamp": "timestamp", "timestamp": "timestamp", "mmsi": "mmsi", "latitude": "lat", "longitude": "lon", "sog": "sog_kn", "cog": "cog_deg",
    "heading": "heading_deg", "navigational status": "nav_status", "name": "ship_name", "ship type": "ship_type", "length": "length_m",
}
DAY_FIRST = "dd/MM/yyyy HH:mm:ss"


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet log with its required columns; mmsi is text, timestamps are instants, and t_us and ord are added."""
    log = assert_utc(assert_schema(spark.read.parquet(path), REQUIRED_LOG), "timestamp")
    if "ord" not in log.columns:
        log = log.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))  # the input's own order
    return log.withColumn("mmsi", F.lpad(F.col("mmsi").cast("string"), 9, "0")).withColumn("t_us", F.unix_micros("timestamp"))


def read_external_log(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, window_us: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts by reason) of a CSV log with day-first times. Headers are matched without case; values that do not
    parse, positions out of range and rows outside the box (lon, lat, lon, lat) or window are counted, not just dropped. ord counts rows
    in the order of the scan, so kept rows enter `positions.reconstruct` as they are."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    renamed = raw.select(*[F.col(f"`{c}`").alias(HEADERS[c.strip().lower()]) for c in raw.columns if c.strip().lower() in HEADERS])
    renamed = assert_schema(renamed, REQUIRED_LOG).withColumn("ord", F.monotonically_increasing_id())
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    rows = renamed.withColumns({c: number(c) for c in ("lat", "lon", "sog_kn", "cog_deg", "heading_deg", "length_m") if c in renamed.columns})
    rows = rows.withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit(DAY_FIRST))).withColumn("t_us", F.unix_micros("timestamp")).withColumn("mmsi", F.lpad("mmsi", 9, "0"))
    if "heading_deg" not in rows.columns:
        rows = rows.withColumn("heading_deg", F.col("cog_deg"))
    for name, value in (("nav_status", "Unknown"), ("ship_name", ""), ("ship_type", "Unknown"), ("length_m", 0.0)):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)) if name in rows.columns else F.lit(value))
    reason = F.when(F.col("t_us").isNull(), "bad timestamp").when(F.col("lat").isNull() | F.col("lon").isNull() | F.col("mmsi").isNull(), "missing value")
    reason = reason.when(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180), "bad position")
    if box:
        reason = reason.when(~F.col("lon").between(box[0], box[2]) | ~F.col("lat").between(box[1], box[3]), "outside the area")
    if window_us:
        reason = reason.when(~F.col("t_us").between(*window_us), "outside the window")
    rows = rows.withColumn("_reason", F.coalesce(reason, F.lit("kept")))
    return rows.filter("_reason = 'kept'").drop("_reason"), rows.groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("rows"))


#: Other names of coordinates in gridded products.
ALIASES = {"time": ("time", "valid_time"), "latitude": ("latitude", "lat", "y"), "longitude": ("longitude", "lon", "x"), "depth": ("depth",)}


def normalise_grid(grid: DataFrame) -> DataFrame:
    """Long-form grid with time, latitude, longitude in -180..180; of several depths the least stays. A grid without a
    coordinate is refused."""
    low = {c.lower(): c for c in grid.columns}
    for name, others in ALIASES.items():
        found = next((low[o] for o in others if o in low), None)
        if found is None and name != "depth":
            raise ValueError(f"no {name} among {grid.columns}")
        if found and found != name:
            grid = grid.withColumnRenamed(found, name)
    if "depth" in grid.columns:
        top = grid.agg(F.min("depth").alias("_d"))
        grid = grid.crossJoin(F.broadcast(top)).filter("depth = _d").drop("_d", "depth")
    return grid.withColumn("longitude", F.pmod(F.col("longitude") + 180, F.lit(360)) - 180)


def assert_regular(grid: DataFrame) -> DataFrame:
    """grid, or an error where a time has a node twice or an axis is not evenly spaced (to a thousandth of its step)."""
    twice = grid.groupBy("time", "latitude", "longitude").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError("a node stands twice at one time")
    for axis in ("latitude", "longitude"):
        steps = grid.select(axis).distinct().select((F.col(axis) - F.lag(axis).over(Window.orderBy(axis))).alias("d"))  # one axis of a grid
        found = steps.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
        if found["lo"] is not None and found["hi"] - found["lo"] > 1e-3 * found["hi"]:
            raise ValueError(f"{axis} is not evenly spaced")
    return grid


def subset(grid: DataFrame, box: tuple[float, float, float, float], t_start, t_end, margin_deg: float = 0.5, margin_hours: int = 2) -> DataFrame:
    """Rows inside the box and window with margins, ends included; plain comparisons, so they reach the scan."""
    margin = F.expr(f"INTERVAL {margin_hours} HOURS")
    return grid.filter(
        F.col("longitude").between(box[0] - margin_deg, box[2] + margin_deg) & F.col("latitude").between(box[1] - margin_deg, box[3] + margin_deg)
        & F.col("time").between(F.lit(t_start) - margin, F.lit(t_end) + margin)
    )


def axes_agree(a: DataFrame, b: DataFrame) -> Column | bool:
    """Whether two grids have the same times."""
    times = a.select(F.col("time").alias("t")).distinct().withColumn("a", F.lit(1)).join(b.select(F.col("time").alias("t")).distinct().withColumn("b", F.lit(1)), "t", "full")
    return times.filter("a is null or b is null").isEmpty()


def read_scene(spark: SparkSession, path: str, height: int) -> DataFrame:
    """A long-form scene with rows turned so that they count northward."""
    return spark.read.parquet(path).withColumn("row", F.lit(height - 1) - F.col("row"))


def scene_axes(scene: DataFrame, affine: tuple[float, float, float, float, float, float], height: int) -> DataFrame:
    """A scene whose rows count northward with x and y of the cells' centres, from the affine of its northward-up file: (width of a cell, row
    turn, left edge, column turn, negative height of a cell, upper edge). A turned scene is refused."""
    a, b, left, d, e, upper = affine
    if b or d:
        raise ValueError("a turned scene has no axes")
    file_row = F.lit(height - 1) - F.col("row")
    return scene.withColumn("x", left + a * (F.col("col") + 0.5)).withColumn("y", upper + e * (file_row + 0.5))


def assert_georeferenced(crs: str | None) -> str:
    """A scene's reference system, or an error where it has none."""
    if not crs:
        raise ValueError("the scene has no reference system")
    return crs


def scene_guards(scene: DataFrame, value: str = "value") -> DataFrame:
    """One row (p01, p50, p99, linear, out_of_range): a scene in linear units or with an odd median is to be refused."""
    out = scene.agg(F.percentile(value, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("p"))
    out = out.select(F.col("p")[0].alias("p01"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p99"))
    return out.withColumn("linear", (F.col("p01") >= 0) & (F.col("p99") < 2)).withColumn("out_of_range", ~F.col("p50").between(-60, 10))


def inspect_tiles(pixels: DataFrame) -> DataFrame:
    """One row a tile of (tile, band, value): spread, medians of VV and VH, whether it looks like decibels with VV at least
    3 dB above VH."""
    by_band = pixels.groupBy("tile").pivot("band", ["vv", "vh"]).agg(F.median("value"))
    spread = pixels.groupBy("tile").agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("p")).select("tile", F.col("p")[0].alias("p01"), F.col("p")[1].alias("p99"))
    out = spread.join(by_band, "tile")
    return out.withColumn("looks_like_db", ~((F.col("p01") >= 0) & (F.col("p99") < 2))).withColumn("band_order_ok", F.col("vv") - F.col("vh") >= 3)


def load_tile(pixels: DataFrame, tile: str, band: str = "vv") -> DataFrame:
    """(row, col, value) of one band of (tile, band, row, col, value); a band that no tile has is refused when this is built."""
    if band not in ("vv", "vh"):
        raise ValueError(f"no band {band}")
    return pixels.filter((F.col("tile") == tile) & (F.col("band") == band)).select("row", "col", "value")


def load_mask(pixels: DataFrame, tile: str) -> DataFrame:
    return pixels.filter((F.col("tile") == tile) & (F.col("value") > 0)).select("row", "col")


def tile_problems(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """(tile, problem): every broken rule of every tile, as rows instead of errors."""
    found = [(~F.col("looks_like_db"), "values look linear"), (~F.col("band_order_ok"), "bands look swapped"), (F.col("vv").isNull() | F.col("vh").isNull(), "band missing")]
    out = None
    for rule, name in found:
        one = tiles.filter(rule).select("tile", F.lit(name).alias("problem"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(tiles.join(masks.select("tile").distinct(), "tile", "left_anti").select("tile", F.lit("mask missing").alias("problem")))


def pair_by_stem(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(stem, image, mask) of two listings with a path, matched by file name without its extension."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:_mask)?\.[^./]+$", 1)
    return images.select(stem("path").alias("stem"), F.col("path").alias("image")).join(masks.select(stem("path").alias("stem"), F.col("path").alias("mask")), "stem")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_forcing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORCING).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_parameters(path: str | Path, section: str, kind: type, **overrides):
    """A frozen dataclass from a section of a YAML file; unknown names are refused, overrides win."""
    import yaml

    values = (yaml.safe_load(Path(path).read_text()) or {}).get(section, {}) | overrides
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - names):
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def parse_or_default(column: Column, schema: str, default: Column) -> Column:
    """A JSON text's value, or the default where it can't be read."""
    return F.coalesce(F.from_json(column, schema), default)


def list_cases(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all case folders under root, by id."""
    return read_manifest(spark, f"{root}/*/case.json").select("case_id", "t_start", "t_obs", "aoi").orderBy("case_id")
