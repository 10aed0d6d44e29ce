"""Raster analytics on long-form rasters (row, col, value): neighbourhoods are joins on integer cells or row windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in pairs]))


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def dilate(cells: DataFrame, footprint: list[tuple[int, int]] = CROSS, times: int = 1) -> DataFrame:
    """(row, col) of a mask grown by a footprint. Copies go through one distinct, which combines before the shuffle."""
    for _ in range(times):
        cells = cells.select("row", "col", _offsets(footprint).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()
    return cells


def erode(cells: DataFrame, footprint: list[tuple[int, int]] = CROSS, times: int = 1) -> DataFrame:
    """Cells whose whole footprint is in the mask."""
    for _ in range(times):
        reached = cells.select("row", "col", _offsets([(-r, -c) for r, c in footprint]).alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
        cells = reached.groupBy("row", "col").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(footprint)).select("row", "col")
    return cells


def opening(cells: DataFrame, footprint: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(cells, footprint), footprint)


def closing(cells: DataFrame, footprint: list[tuple[int, int]]) -> DataFrame:
    return erode(dilate(cells, footprint), footprint)


def within(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    return cells.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def ring(cells: DataFrame) -> DataFrame:
    """Cells beside the mask, not in it; their number is the perimeter."""
    return dilate(cells).join(cells, ["row", "col"], "left_anti")


def erode_keeping(cells: DataFrame, pad: int) -> DataFrame:
    """Erosion by pad steps, or by fewer where nothing would be left. At most pad small jobs."""
    for steps in range(pad, 0, -1):
        out = erode(cells, CROSS, steps)
        if not out.isEmpty():
            return out
    return cells


def box_mean(raster: DataFrame, half: int, rows: int, cols: int, value: str = "value") -> DataFrame:
    """Mean over (2 half + 1)^2 cells with edges repeated, by running sums along rows and then columns: each cell reads two
    sums whatever the window's size, so a pass is one window over lines of the raster."""

    def along(df: DataFrame, line: str, at: str, n: int) -> DataFrame:
        order = Window.partitionBy(line).orderBy(at)
        total = F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0))
        whole = Window.partitionBy(line).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        summed = df.withColumn("_s", total).withColumn("_first", F.first("v").over(whole)).withColumn("_last", F.last("v").over(whole)).withColumn("_all", F.last("_s").over(whole))
        upper, lower = F.lead("_s", half).over(order), F.lag("_s", half + 1).over(order)
        over = F.greatest(F.lit(0), F.col(at) + half - (n - 1))
        under = F.greatest(F.lit(0), half - F.col(at))
        mean = (F.coalesce(upper, F.col("_all")) - F.coalesce(lower, F.lit(0.0)) + over * F.col("_last") + under * F.col("_first")) / (2 * half + 1)
        return summed.withColumn("v", mean).drop("_s", "_first", "_last", "_all")

    out = along(raster.select("row", "col", F.col(value).alias("v")), "row", "col", cols)
    return along(out, "col", "row", rows).select("row", "col", F.col("v").alias(value))


def gaussian_kernel(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def gaussian(raster: DataFrame, sigma: float, rows: int, cols: int, mode: str = "reflect", value: str = "value") -> DataFrame:
    """Separable Gaussian filter, four deviations wide. mode: `reflect` mirrors beyond the edges, `nearest` repeats them.

    Along each axis a task has bands of whole lines, of a bounded number of cells, and filters them as one matrix: two shuffles of
    the raster at any width. A cell that is not there counts as 0.
    """
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2

    def along(df: DataFrame, at: str, n: int) -> DataFrame:
        other = "col" if at == "row" else "row"
        band = max(1, min(256, (1 << 22) // max(n, 1)))

        def smooth(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            i, j = table[at].to_numpy().astype(np.int64), table[other].to_numpy().astype(np.int64) - key[0].as_py() * band
            grid = np.zeros((n, band))
            grid[i, j] = table["v"].to_numpy()
            padded = np.pad(grid, ((radius, radius), (0, 0)), mode="edge" if mode == "nearest" else "symmetric")
            out = sum(w * padded[k : k + n] for k, w in enumerate(kernel))
            return table.set_column(table.schema.get_field_index("v"), "v", pa.array(out[i, j]))

        rows_ = df.select("row", "col", F.col("v").cast("double").alias("v"))
        kinds = {f.name: f.dataType.simpleString() for f in rows_.schema}
        return rows_.groupBy(F.floor(F.col(other) / band).alias("band")).applyInArrow(smooth, f"row {kinds['row']}, col {kinds['col']}, v double")

    out = along(raster.select("row", "col", F.col(value).alias("v")), "row", rows)
    return along(out, "col", cols).select("row", "col", F.col("v").alias(value))


def gradient(raster: DataFrame, value: str = "value") -> DataFrame:
    """(row, col, g_row, g_col, magnitude): central differences, one-sided at the edges."""

    def slope(line: str, at: str) -> Column:
        order = Window.partitionBy(line).orderBy(at)
        ahead, behind = F.lead(value).over(order), F.lag(value).over(order)
        return F.when(ahead.isNull(), F.col(value) - behind).when(behind.isNull(), ahead - F.col(value)).otherwise((ahead - behind) / 2)

    out = raster.withColumn("g_col", slope("row", "col")).withColumn("g_row", slope("col", "row"))
    return out.select("row", "col", "g_row", "g_col", F.sqrt(F.pow("g_row", 2) + F.pow("g_col", 2)).alias("magnitude"))


def dark_candidates(raster: DataFrame, background: DataFrame, below: float) -> DataFrame:
    """Cells darker than their background by `below` or more."""
    joined = raster.join(background.select("row", "col", F.col("value").alias("_b")), ["row", "col"])
    return joined.filter(F.col("value") <= F.col("_b") - below).select("row", "col")


def label_components(cells: DataFrame, least: int = 1, diagonal: bool = True, max_rounds: int = 40) -> DataFrame:
    """(row, col, patch): connected cells share a patch, named by its smallest cell; patches below `least` cells go.

    Every round takes the smallest label of the neighbourhood and then the label of that label (pointer jumping), so rounds
    grow with the logarithm of a patch's extent; each one is checkpointed to the shared folder.
    """
    near = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if diagonal or not (r and c)]
    key = F.col("row").cast("long") * (1 << 31) + F.col("col")
    state = _checkpoint(cells.select("row", "col", key.alias("cell"), key.alias("patch")))
    for _ in range(max_rounds):
        spread = state.select("patch", "row", "col", _offsets(near).alias("o")).select("patch", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
        least_near = spread.groupBy("row", "col").agg(F.min("patch").alias("low"))
        hooked = state.join(least_near, ["row", "col"]).select("row", "col", "cell", F.least("patch", "low").alias("patch"))
        jump = hooked.select(F.col("cell").alias("patch"), F.col("patch").alias("root"))
        following = _checkpoint(hooked.join(jump, "patch", "left").select("row", "col", "cell", F.coalesce("root", "patch").alias("patch")))
        changed = following.join(state.select("cell", F.col("patch").alias("was")), "cell").filter("patch <> was").isEmpty()
        state = following
        if changed:
            break
    else:
        raise RuntimeError(f"patches did not settle in {max_rounds} rounds")
    counted = state.withColumn("_n", F.count("*").over(Window.partitionBy("patch")))
    return counted.filter(F.col("_n") >= least).select("row", "col", "patch")


def _checkpoint(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(found)
    return df.checkpoint()


def patch_summary(patches: DataFrame, raster: DataFrame, background: float) -> DataFrame:
    """One row a patch: cells, centroid, mean, population deviation, damping, principal axis and elongation."""
    rows = patches.join(raster, ["row", "col"])
    a, b, c = F.col("vr"), F.col("vc"), F.col("cov")
    root = F.sqrt(F.pow(a - b, 2) / 4 + c * c)
    out = rows.groupBy("patch").agg(
        F.count("*").alias("n_cells"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.min("value").alias("darkest"), F.var_samp("row").alias("vr"), F.var_samp("col").alias("vc"), F.covar_samp("row", "col").alias("cov"),
    )
    major, minor = (a + b) / 2 + root, (a + b) / 2 - root
    axis = F.pmod(F.degrees(0.5 * F.atan2(2 * c, b - a)), F.lit(180.0))
    out = out.withColumn("elongation", F.sqrt(F.try_divide(F.greatest(major, F.lit(0.0)), F.greatest(minor, F.lit(1e-9))))).withColumn("axis_deg", axis)
    return out.withColumn("damping", background - F.col("mean")).drop("vr", "vc", "cov")


def shape_features(patches: DataFrame, cell_km2: float) -> DataFrame:
    """perimeter (cells beside the patch), complexity P^2 / (4 pi A) and hole share, patch by patch."""
    grown = patches.select("patch", "row", "col", _offsets(CROSS).alias("o")).select("patch", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()
    beside = grown.join(patches, ["patch", "row", "col"], "left_anti").groupBy("patch").agg(F.count("*").alias("perimeter"))
    area = patches.groupBy("patch").agg(F.count("*").alias("n_cells"))
    out = area.join(beside, "patch").withColumn("area_km2", F.col("n_cells") * cell_km2)
    return out.withColumn("complexity", F.col("perimeter") * F.col("perimeter") / (4 * math.pi * F.col("n_cells")))


def overlap_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """iou and recall of two masks; 0 where they are not defined."""
    both = predicted.select("row", "col", F.lit(1).alias("p")).join(truth.select("row", "col", F.lit(1).alias("t")), ["row", "col"], "full")
    out = both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("shared"), F.count("*").alias("any"), F.count("t").alias("truth"))
    return out.select(F.coalesce(F.try_divide("shared", "any"), F.lit(0.0)).alias("iou"), F.coalesce(F.try_divide("shared", "truth"), F.lit(0.0)).alias("recall"))


def lane_distance(fixes: DataFrame, width: float, quantile: float = 0.7, sigma: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of fixes by coarse cell (cx, cy), and the busy cells: those at or above the quantile of non-empty ones. With sigma the
    counts are smoothed first, over the box of the cells that have any."""
    counts = fixes.groupBy(F.floor(F.col("lon") / width).alias("cx"), F.floor(F.col("lat") / width).alias("cy")).agg(F.count("*").alias("n"))
    if sigma:
        box = counts.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1")).first()  # four scalars
        if box["x0"] is not None:
            rows, cols = box["y1"] - box["y0"] + 1, box["x1"] - box["x0"] + 1
            grid = fixes.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
            at = counts.select((F.col("cy") - box["y0"]).alias("row"), (F.col("cx") - box["x0"]).alias("col"), "n")
            dense = grid.join(at, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("double").alias("value"))
            smooth = gaussian(dense, sigma, rows, cols).filter("value > 1e-12")
            counts = smooth.select((F.col("col") + box["x0"]).alias("cx"), (F.col("row") + box["y0"]).alias("cy"), F.col("value").alias("n"))
    limit = counts.agg(F.percentile("n", quantile).alias("limit"))
    return counts, counts.crossJoin(F.broadcast(limit)).filter("n >= limit").select("cx", "cy")


def hull_solidity(patches: DataFrame) -> DataFrame:
    """(patch, hull_area, solidity): cells over the area of the convex hull of their corners.

    Of each patch only the first and last cell of every row can be on the hull, so those are aggregated first and the hull
    runs over two points a row.
    """
    ends = patches.groupBy("patch", "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.count("*").alias("n"))

    def hull(rows):
        import pandas as pd

        def chain(points):
            out = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        corners = sorted({(r + dr, c) for r, lo, hi in zip(rows["row"], rows["lo"], rows["hi"], strict=True) for dr in (0, 1) for c in (lo, hi + 1)})
        loop = chain(corners) + chain(corners[::-1])
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:] + loop[:1], strict=True))) / 2
        return pd.DataFrame({"patch": [rows["patch"].iloc[0]], "hull_area": [float(area)], "solidity": [float(rows["n"].sum() / area)]})

    return ends.groupBy("patch").applyInPandas(hull, "patch long, hull_area double, solidity double")


def region_edges(cells: DataFrame) -> DataFrame:
    """(r0, c0, r1, c1): cell edges between the region and its outside, those that only one cell has, left side inside."""
    r, c = F.col("row"), F.col("col")
    sides = F.explode(F.array(*[
        F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"), nr.alias("nr"), nc.alias("nc"))
        for r0, c0, r1, c1, nr, nc in ((r, c, r, c + 1, r - 1, c), (r, c + 1, r + 1, c + 1, r, c + 1), (r + 1, c + 1, r + 1, c, r + 1, c), (r + 1, c, r, c, r, c - 1))
    ]))
    edges = cells.select(sides.alias("s")).select("s.*")
    return edges.join(cells.select(r.alias("nr"), c.alias("nc")), ["nr", "nc"], "left_anti").select("r0", "c0", "r1", "c1")


def outlines(cells: DataFrame) -> DataFrame:
    """(component, ring, area, vertices): boundary rings of each component, corners only; holes have negative area."""
    labelled = label_components(cells, diagonal=False)
    by_cell = labelled.select("row", "col", "patch")
    r, c = F.col("row"), F.col("col")
    sides = F.explode(F.array(*[
        F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"), nr.alias("nr"), nc.alias("nc"))
        for r0, c0, r1, c1, nr, nc in ((r, c, r, c + 1, r - 1, c), (r, c + 1, r + 1, c + 1, r, c + 1), (r + 1, c + 1, r + 1, c, r + 1, c), (r + 1, c, r, c, r, c - 1))
    ]))
    edges = by_cell.select("patch", sides.alias("s")).select("patch", "s.*")
    edges = edges.join(cells.select(r.alias("nr"), c.alias("nc")), ["nr", "nc"], "left_anti").select("patch", "r0", "c0", "r1", "c1")

    def stitch(rows):
        import pandas as pd

        follow: dict[tuple, list] = {}
        for a, b, x, y in sorted(zip(rows["r0"], rows["c0"], rows["r1"], rows["c1"], strict=True)):
            follow.setdefault((a, b), []).append((x, y))
        made = []
        while follow:
            start = min(follow)
            at, before, loop = start, None, []
            while at in follow:
                steps = follow[at]
                if before is not None and len(steps) > 1:  # two rings touch: keep to the right
                    d = (at[0] - before[0], at[1] - before[1])
                    steps.sort(key=lambda n: (n[0] - at[0]) * d[1] - (n[1] - at[1]) * d[0])
                step = steps.pop(0)
                if not steps:
                    del follow[at]
                if not loop or before is None or (step[0] - at[0], step[1] - at[1]) != (at[0] - before[0], at[1] - before[1]):
                    loop.append(at)
                before, at = at, step
            area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(loop, loop[1:] + loop[:1], strict=True)) / 2
            made.append((int(rows["patch"].iloc[0]), len(made), float(area), [[int(v) for v in p] for p in [*loop, loop[0]]]))
        return pd.DataFrame(made, columns=["component", "ring", "area", "vertices"])

    return edges.groupBy("patch").applyInPandas(stitch, "component long, ring int, area double, vertices array<array<int>>")


def rasterise(ring_lonlat: list[tuple[float, float]], cells: DataFrame, x: Column, y: Column) -> DataFrame:
    """Cells whose centre (x, y) is inside the ring."""
    from tidemark.functions.geo import point_in_ring

    return cells.filter(point_in_ring(x, y, ring_lonlat))


def longest_ring(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each region (keys) the ring of most vertices; the larger area, then the smaller number, settles equals."""
    order = F.struct(F.size("vertices"), F.abs("area"), -F.col("ring"))
    return rings.groupBy(*keys).agg(F.max_by(F.struct("ring", "area", "vertices"), order).alias("r")).select(*keys, "r.*")


def unit_scale(value: Column, low_db: float = -30.0, high_db: float = 0.0) -> Column:
    """Decibels as 0 to 1 between two levels, clipped."""
    return F.least(F.greatest((value - low_db) / (high_db - low_db), F.lit(0.0)), F.lit(1.0))
