"""Sinks: gridded fields, posteriors, evaluation tables, event logs and the display bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.posterior import peak_normalised


def write_currents(grid: DataFrame, path: str, u: str = "u", v: str = "v") -> DataFrame:
    """Write with missing values as 0, and give the share of nodes that missed the first component."""
    gone = lambda c: F.col(c).isNull() | F.isnan(c)
    note = grid.agg(F.avg(gone(u).cast("double")).alias("missing_share"))
    grid.withColumns({c: F.when(gone(c), 0.0).otherwise(F.col(c)) for c in (u, v)}).write.mode("overwrite").parquet(path)
    return note


def write_wind(grid: DataFrame, path: str, u: str = "u", v: str = "v") -> DataFrame:
    """Write, and give the range of speeds and the share below the gate."""
    speed = F.hypot(u, v)
    grid.write.mode("overwrite").parquet(path)
    return grid.agg(F.min(speed).alias("least_ms"), F.max(speed).alias("most_ms"), F.avg((speed < 3).cast("double")).alias("gated_share"))


def write_posterior(cells: DataFrame, path: str) -> None:
    """Long-form cells (case_id, it, iy, ix, w), a folder a case."""
    cells.write.mode("overwrite").partitionBy("case_id").parquet(path)


def write_trials(trials: DataFrame, csv_path: str, summary: DataFrame, json_path: str) -> None:
    trials.write.mode("overwrite").option("header", True).csv(csv_path)
    summary.write.mode("overwrite").json(json_path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def to_storage_time(df: DataFrame, *columns: str) -> DataFrame:
    """Instants as UTC times without a zone, for stores that have none. The session's zone must be UTC."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def display_cells(cells: DataFrame, floor: float = 0.02) -> DataFrame:
    """Posterior cells as shares of the largest one, without faint ones."""
    return peak_normalised(cells, floor)
