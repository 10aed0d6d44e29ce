"""Hypothesis scoring and posterior summaries over long-form grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bernoulli_loglik(particles: DataFrame, mask: DataFrame, lam: float = 2.5, floor: float = 0.01, n_effective: float | None = None) -> DataFrame:
    """(hyp, n, coverage, spill, log_lik) of particles (hyp, ix, iy, usable) against mask cells (ix, iy, state).

    state is `oil` or `annulus`; particles on neither count as spill. Cells without particles add a constant, so only
    hit cells are summed: log q(0) for each of the others. A hypothesis without a usable particle has minus infinity.
    The mask's cells meet the particles in a hash join on the cell; counts go through two hash aggregates.
    """
    oil = mask.filter("state = 'oil'").agg(F.count("*").alias("n_cells"))
    cells = mask.select("ix", "iy", "state")
    rows = particles.join(cells, ["ix", "iy"], "left")
    by_cell = rows.groupBy("hyp", "ix", "iy", "state").agg(F.count_if("usable").alias("c"))
    totals = by_cell.groupBy("hyp").agg(F.sum("c").alias("n"))
    scaled = by_cell.join(totals, "hyp").crossJoin(F.broadcast(oil))  # one row
    rho = F.try_divide(F.col("c") * F.col("n_cells"), F.col("n"))
    q = floor + (1 - floor) * (1 - F.exp(-lam * rho))
    hit = (F.col("state") == "oil") & (F.col("c") > 0)
    out = scaled.groupBy("hyp").agg(
        F.first("n").alias("n"), F.first("n_cells").alias("n_cells"), F.count_if(hit).alias("hits"),
        F.coalesce(F.sum(F.when(hit, F.log(q))), F.lit(0.0)).alias("hit_term"),
        F.coalesce(F.sum(F.when(F.col("state").isNull(), F.col("c"))), F.lit(0)).alias("outside"),
    )
    temper = F.lit(1.0) if n_effective is None else F.lit(n_effective) / F.col("n_cells")
    empty = (F.col("n_cells") - F.col("hits")) * F.log(F.lit(floor))
    spill = F.coalesce(F.try_divide("outside", "n"), F.lit(0.0))
    score = (F.col("hit_term") + empty - lam * spill * F.col("n_cells")) * temper
    return out.select(
        "hyp", "n", F.coalesce(F.try_divide("hits", "n_cells"), F.lit(0.0)).alias("coverage"), spill.alias("spill"),
        F.when(F.col("n") > 0, score).otherwise(F.lit(float("-inf"))).alias("log_lik"),
    )


def effective_cells(n_cells: Column, cell_km2: Column, correlation_m: float) -> Column:
    area = n_cells * cell_km2
    return F.least(F.greatest(area / max((correlation_m / 1000) ** 2, 1e-9), F.lit(1.0)), n_cells.cast("double"))


def _with_totals(rows: DataFrame, keys: list[str] | None, *totals: Column) -> DataFrame:
    """rows with aggregates over each case, or over all of them: a hash aggregate joined back, so rows stay spread."""
    if keys:
        return rows.join(rows.groupBy(*keys).agg(*totals), keys)
    return rows.crossJoin(F.broadcast(rows.agg(*totals)))  # one row


def softmax(scores: DataFrame, value: str = "log_lik", prior: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """weight of each row within its case, shifted by the maximum."""
    finite = F.when(F.col(value) > float("-inf"), F.col(value))
    rows = _with_totals(scores, keys, F.max(finite).alias("_top"))
    rows = rows.withColumn("_e", F.coalesce(F.exp(finite - F.col("_top")), F.lit(0.0)) * (F.col(prior) if prior else F.lit(1.0)))
    out = _with_totals(rows, keys, F.sum("_e").alias("_sum")).withColumn("weight", F.try_divide("_e", "_sum"))
    return out.select(*scores.columns, "weight")


def effective_sample_size(weights: DataFrame, particles_per_hypothesis: float, keys: list[str] | None = None) -> DataFrame:
    share = F.coalesce(F.try_divide(F.lit(float(particles_per_hypothesis)), F.sum(F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("ess")
    return weights.groupBy(*keys).agg(share) if keys else weights.agg(share)


def density(rows: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(weight).alias("w"))


def marginals(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Spatial and time marginals of (it, iy, ix, weight) in one pass with grouping sets: axis tells which."""
    out = rows.groupingSets([["iy", "ix"], ["it"]], "it", "iy", "ix").agg(F.sum(weight).alias("w"), F.grouping("it").alias("g"))
    return out.select(F.when(F.col("g") == 1, "space").otherwise("time").alias("axis"), "it", "iy", "ix", "w")


def highest_density(cells: DataFrame, level: float, order: list[str], weight: str = "w", groups: list[str] | None = None) -> DataFrame:
    """Cells of the smallest set that holds `level` of the mass: those before which less than that has been gathered,
    heaviest first. order settles ties."""
    window = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(F.desc(weight), *order)
    before = F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    total = F.sum(weight).over(Window.partitionBy(*(groups or [F.lit(1)])))
    marked = cells.withColumn("_before", before).withColumn("_total", total).withColumn("hd_rank", F.row_number().over(window))
    return marked.filter(F.col("_before") < level * F.col("_total")).drop("_before", "_total")


def nested_levels(cells: DataFrame, inner: float, outer: float, order: list[str], groups: list[str] | None = None) -> DataFrame:
    """Outer set with in_inner, where the inner set has fewer cells than the outer one, case by case."""
    out = highest_density(cells, outer, order, groups=groups)
    small = highest_density(cells, inner, order, groups=groups)
    small = small.groupBy(*groups).agg(F.count("*").alias("_k")) if groups else small.agg(F.count("*").alias("_k"))
    rows = _with_totals(out, groups, F.count("*").alias("_n"))
    rows = rows.join(small, groups) if groups else rows.crossJoin(F.broadcast(small))
    limit = F.when(F.col("_k") >= F.col("_n"), F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(F.col("_k"))
    return rows.withColumn("in_inner", F.col("hd_rank") <= limit).drop("_k", "_n")


def peak_normalised(cells: DataFrame, floor: float = 0.02, weight: str = "w", keys: list[str] | None = None) -> DataFrame:
    """share of the case's largest weight, without shares below the floor."""
    out = _with_totals(cells, keys, F.max(weight).alias("_top")).withColumn("share", F.try_divide(weight, "_top"))
    return out.select(*cells.columns, "share").filter(F.col("share") >= floor)


def keep_best(scores: DataFrame, fraction: float, value: str, tie: str, least: int = 4, keys: list[str] | None = None) -> DataFrame:
    """The best round(n * fraction) rows of each case, at least `least`; half rounds to even, minus infinity goes last. Over one
    case a limit by order, which takes the best of each task first; over several a window a case, which are thousands of rows."""
    count = F.greatest(F.lit(least), F.bround(F.count("*") * fraction).cast("int"))
    if not keys:
        return scores.orderBy(F.desc(value), tie).limit(scores.agg(count.alias("k")).first()["k"])  # one scalar
    ranked = scores.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie)))
    return _with_totals(ranked, keys, count.alias("_k")).filter("_nth <= _k").select(*scores.columns)


def refine(parents: DataFrame, cell: float) -> DataFrame:
    """Each parent (hyp, x, y, t0) as four children at the centres of its quarters."""
    quarters = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-0.25, 0.25) for dy in (-0.25, 0.25)])
    rows = parents.select("hyp", "x", "y", "t0", F.posexplode(quarters).alias("child", "o"))
    return rows.select("hyp", "child", (F.col("x") + F.col("o.dx") * cell).alias("x"), (F.col("y") + F.col("o.dy") * cell).alias("y"), "t0")
