"""Streaming forms of the position-log operators, on event time with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe(stream: DataFrame, delay: str = "6 hours") -> DataFrame:
    """The first arrival of each vessel and time; state goes when the watermark passes."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["mmsi", "timestamp"])


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """(mmsi, t_start, t_end, n_fixes) of runs without a silence of `gap`, once the watermark closes them."""
    grouped = stream.withWatermark("timestamp", delay).groupBy("mmsi", F.session_window("timestamp", gap))
    return grouped.agg(F.count("*").alias("n_fixes"), F.max("timestamp").alias("t_end")).select("mmsi", F.col("session_window.start").alias("t_start"), "t_end", "n_fixes")


def release_counts(stream: DataFrame, width: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Fixes and vessels by tumbling window."""
    grouped = stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width))
    return grouped.agg(F.count("*").alias("n_fixes"), F.approx_count_distinct("mmsi").alias("vessels")).select("window.start", "window.end", "n_fixes", "vessels")


def speed_filter(stream: DataFrame, max_kn: float = 40.0) -> DataFrame:
    """Rows without an implausible jump from the vessel's previous row, which is the state, kept or not."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = "mmsi string, timestamp timestamp, lon double, lat double, implied_kn double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        rows = pd.concat(list(frames)).sort_values("timestamp", kind="stable")
        last = state.get if state.exists else None
        t = rows["timestamp"].astype("int64").to_numpy() / 1e9 if str(rows["timestamp"].dtype).startswith("datetime64[ns") else rows["timestamp"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        lon, lat = rows["lon"].to_numpy(float), rows["lat"].to_numpy(float)
        before = (t[:-1], lon[:-1], lat[:-1])
        head = last if last is not None else (t[0], lon[0], lat[0])
        pt, plon, plat = (np.concatenate(([h], b)) for h, b in zip(head, before, strict=True))
        p1, p2 = np.radians(plat), np.radians(lat)
        a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon - plon) / 2) ** 2
        metres = 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
        kn = np.where(t > pt, metres / np.maximum(t - pt, 1e-9) / 0.514444, 0.0)
        state.update((float(t[-1]), float(lon[-1]), float(lat[-1])))
        out = rows.assign(implied_kn=kn)[["mmsi", "timestamp", "lon", "lat", "implied_kn"]]
        yield out[out["implied_kn"] <= max_kn]

    return stream.select("mmsi", "timestamp", "lon", "lat").groupBy("mmsi").applyInPandasWithState(step, schema, "t double, lon double, lat double", "append", GroupStateTimeout.NoTimeout)


def counted(stream: DataFrame, name: str = "positions") -> DataFrame:
    """The stream with counts of rows and of bad positions in each batch's progress."""
    bad = ~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return stream.observe(name, F.count("*").alias("rows"), F.count_if(bad).alias("bad_positions"))


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its rows, from an in-memory sink (for tests and small sources)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
