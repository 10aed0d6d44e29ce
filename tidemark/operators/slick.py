"""Drawing slicks into scenes, patch context (wind, lanes), labelled patches and level maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import raster as R
from tidemark.operators.generate import damping_db


def render_damping(particles: DataFrame, rows: int, cols: int, cell_m2: float, sigma_cells: float = 1.0) -> DataFrame:
    """(row, col, damping): particles (row, col) as a smoothed share of the release for each square metre, scaled and
    saturated. Cells that no particle comes near have 0."""
    spark = particles.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    counts = particles.groupBy("row", "col").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    dense = grid.join(counts, ["row", "col"], "left").crossJoin(F.broadcast(total))  # one row
    share = dense.select("row", "col", (F.coalesce(F.try_divide("n", "total"), F.lit(0.0)) / cell_m2 * 1e4).alias("value"))
    smooth = R.gaussian(share, sigma_cells, rows, cols)
    return smooth.select("row", "col", damping_db(F.greatest("value", F.lit(0.0))).alias("damping"))


def inject(scene: DataFrame, damping: DataFrame, threshold_db: float = -1.5) -> DataFrame:
    """The scene with the damping added on water, and truth: where that is at or below the threshold."""
    rows = scene.join(damping, ["row", "col"], "left").withColumn("damping", F.when(F.col("land"), 0.0).otherwise(F.coalesce("damping", F.lit(0.0))))
    return rows.withColumn("value", F.col("value") + F.col("damping")).withColumn("truth", F.col("damping") <= threshold_db)


def peak_damping(damping: DataFrame) -> DataFrame:
    return damping.agg(F.min("damping").alias("peak_db"))


def wind_spread(patches: DataFrame, wind: DataFrame, cell_km: float) -> DataFrame:
    """(patch, wind_gradient): range of wind (row, col, wind) over each patch's block, by the block's longer side in km."""
    box = patches.groupBy("patch").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    # A block's cells are listed, so that the wind is met by equal cells and not by ranges.
    cells = box.select("*", F.explode(F.sequence("r0", "r1")).alias("row")).select("*", F.explode(F.sequence("c0", "c1")).alias("col"))
    extent = (F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) + 1) * cell_km
    return cells.withColumn("_extent", extent).join(wind, ["row", "col"]).groupBy("patch").agg(((F.max("wind") - F.min("wind")) / F.first("_extent")).alias("wind_gradient"))


def distance_to_busy(cells: DataFrame, busy: DataFrame, reach: int) -> DataFrame:
    """(cx, cy, distance): cells to the nearest busy cell, in cells; null beyond `reach`. Busy cells are spread over their
    surroundings, so no cell is compared with all of them."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach])
    spread = busy.select("cx", "cy", F.explode(around).alias("o")).select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), F.sqrt(F.pow("o.i", F.lit(2)) + F.pow("o.j", F.lit(2))).alias("distance"))
    return cells.select("cx", "cy").distinct().join(spread.groupBy("cx", "cy").agg(F.min("distance").alias("distance")), ["cx", "cy"], "left")


def harvest(patches: DataFrame, truth: DataFrame, wind: Column, least_overlap: float = 0.30) -> DataFrame:
    """(patch, overlap, label): patches are oil where enough of their cells are; rows outside the wind window are left out."""
    met = patches.join(truth.select("row", "col", F.lit(1.0).alias("t")), ["row", "col"], "left")
    out = met.groupBy("patch").agg(F.avg(F.coalesce("t", F.lit(0.0))).alias("overlap"))
    return out.filter(wind.between(3.0, 12.0)).withColumn("label", (F.col("overlap") >= least_overlap).cast("int"))


def level_map(regions: DataFrame) -> DataFrame:
    """(case_id, credible_regions): a map from level, as text, to its area, of (case_id, level, area_km2)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("level").cast("string"), "area_km2")))
    return regions.groupBy("case_id").agg(F.map_from_entries(pairs).alias("credible_regions"))


def even_index(rows: DataFrame, order: list[str], keep: int) -> DataFrame:
    """keep rows spread evenly over an order, ends included."""
    at = rows.withColumn("_nth", F.row_number().over(Window.orderBy(*order)) - 1)  # vertices of one outline
    count = at.agg(F.count("*").alias("_n"))
    wanted = rows.sparkSession.range(keep).crossJoin(F.broadcast(count)).select(F.floor(F.col("id") * (F.col("_n") - 1) / max(keep - 1, 1)).alias("_nth")).distinct()
    return at.join(wanted, "_nth", "left_semi").drop("_nth")
