"""Running a case's stages: selection, freshness that follows dependencies, and a timing log."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """What a stage is called, the stages whose tables it reads, and how its table is made."""

    name: str
    needs: tuple[str, ...]
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass
class Runner:
    """Runs stages in order; a table is made anew when it is missing, or older than one that it reads."""

    spark: SparkSession
    root: str
    stages: tuple[Stage, ...]
    log: list[dict] = field(default_factory=list)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def written_at(self, name: str) -> int | None:
        """When a table was completed, by the file system's clock; null if it was not."""
        jvm = self.spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        system = done.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system.getFileStatus(done).getModificationTime() if system.exists(done) else None

    def fresh(self, stage: Stage) -> bool:
        own = self.written_at(stage.name)
        others = [self.written_at(n) for n in stage.needs]
        return own is not None and all(t is not None and t <= own for t in others)

    def run(self, only: set[str] | None = None) -> dict[str, DataFrame]:
        """Tables of all stages, or of those in `only` with what they need."""
        by_name = {s.name: s for s in self.stages}
        wanted = set(by_name) if only is None else set(only)
        for stage in reversed(self.stages):
            if stage.name in wanted:
                wanted |= set(stage.needs)
        if unknown := wanted - set(by_name):
            raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
        tables: dict[str, DataFrame] = {}
        for stage in self.stages:
            if stage.name not in wanted:
                continue
            began, skipped = time.time(), self.fresh(stage)
            if not skipped:
                stage.make(self.spark, tables).write.mode("overwrite").parquet(self.path(stage.name))
            tables[stage.name] = self.spark.read.parquet(self.path(stage.name))
            self.log.append({"stage": stage.name, "skipped": skipped, "seconds": round(time.time() - began, 3)})
        return tables

    def append_log(self, path: str) -> None:
        self.spark.createDataFrame(self.log, "stage string, skipped boolean, seconds double").write.mode("append").json(path)
