"""The metric log and what is kept of a run: metrics that queries observe on their way, appended to a
table, and the best and last sets of parameters under a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from notewright.sources import store

LOG = "run string, step long, metric string, value double"
MANIFEST = "manifest.json"


class MetricLog:
    """A table of (run, step, metric, value) in a folder, appended to while queries run."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def append(self, run: str, step: int, metrics: dict[str, float | None]) -> None:
        """One small file with a step's metrics; those that are null are left out."""
        rows = [(run, step, name, float(value)) for name, value in metrics.items() if value is not None]
        if rows:
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.folder)

    def observed(self, df: DataFrame, run: str, step: int, **metrics: Column) -> tuple[DataFrame, Callable[[], None]]:
        """df with the aggregates observed as its rows go by, and a function that appends them once an
        action on df is through. Nothing is computed twice: the metrics come with the query's own pass."""
        seen = Observation(f"{run}-{step}-{uuid.uuid4().hex}")
        out = df.observe(seen, *[c.alias(name) for name, c in metrics.items()])
        return out, lambda: self.append(run, step, seen.get)

    def read(self) -> DataFrame:
        """The log; a metric appended twice for a step (a batch that ran again) counts once, as last."""
        return self.spark.read.schema(LOG).parquet(self.folder).groupBy("run", "step", "metric").agg({"value": "max"}).withColumnRenamed("max(value)", "value")

    def wide(self, *metrics: str) -> DataFrame:
        """(run, step, a column a metric)."""
        return self.read().groupBy("run", "step").pivot("metric", list(metrics)).agg({"value": "max"})


class StreamMetrics(StreamingQueryListener):
    """Appends what a streaming query observes under a name, batch by batch: the batch is the step."""

    def __init__(self, log: MetricLog, name: str) -> None:
        self.log, self.name = log, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.log.append(event.progress.name or str(event.progress.id), event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@dataclass(frozen=True, order=True)
class Kept:
    """A set of parameters in the order that retention goes by: the loss, then the earlier step."""

    loss: float
    step: int
    folder: str


class Retention:
    """The n sets of least loss and the last one, in folders below a root, under a manifest.

    A set is written in full under a name of its own, then the manifest that names it replaces the old
    one, and only then are sets that no manifest names dropped: whatever is lost in between, the
    manifest names whole sets only. One writer at a time."""

    def __init__(self, root: str, n: int = 10) -> None:
        self.root, self.n = root, n

    def manifest(self) -> tuple[list[Kept], Kept | None]:
        """(the best by loss, the last)."""
        held = store.read_json(self.root, MANIFEST, {"best": [], "last": None})
        return [Kept(*x) for x in held["best"]], Kept(*held["last"]) if held["last"] else None

    def offer(self, step: int, loss: float, write: Callable[[str], None]) -> bool:
        """Writes a set by write(folder), makes it the last, and keeps it among the best if it is one;
        returns whether it is. A loss that is no number is never among the best. A step offered again
        replaces its earlier set."""
        best, _ = self.manifest()
        new = Kept(float(loss), step, f"set-{step}-{uuid.uuid4().hex}")
        write(f"{self.root}/{new.folder}")
        others = [k for k in best if k.step != step]
        ranked = sorted([*others, new])[: self.n] if loss == loss else sorted(others)
        store.swap_json(self.root, MANIFEST, {"best": [[k.loss, k.step, k.folder] for k in ranked], "last": [new.loss if loss == loss else None, step, new.folder]})
        self.sweep()
        return new in ranked

    def sweep(self) -> int:
        """Drops the sets that the manifest does not name; returns how many."""
        best, last = self.manifest()
        named = {k.folder for k in best} | ({last.folder} if last else set())
        stray = [f for f in store.folders(self.root) if f.startswith("set-") and f not in named]
        for folder in stray:
            store.drop_folder(f"{self.root}/{folder}")
        return len(stray)
