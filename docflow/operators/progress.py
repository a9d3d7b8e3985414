"""Progress of runs: counters that ride along with a stage's rows, in batch and in streams, and the time it took."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


def counters(status: str = "status") -> list[Column]:
    """completed, succeeded and failed rows, by a column that is null where nothing went wrong."""
    good = F.col(status).isNull()
    return [F.count(F.lit(1)).alias("completed"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed")]


@dataclass
class Stage:
    """A stage's counters, once an action has read its rows, and seconds."""

    name: str
    observation: Observation
    seconds: float = 0.0
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def per_second(self) -> float:
        return self.counts.get("completed", 0) / self.seconds if self.seconds else 0.0

    def line(self) -> str:
        n = self.counts
        return f"{self.name}: {n.get('completed', 0)} done, {n.get('failed', 0)} failed, {self.seconds:.2f} s, {self.per_second:.2f} a second"


class Progress:
    """The stages of a run, in their order."""

    def __init__(self) -> None:
        self.stages: dict[str, Stage] = {}

    def observed(self, df: DataFrame, name: str, status: str = "status") -> DataFrame:
        """The same rows, counted as an action reads them; no pass of its own."""
        self.stages[name] = stage = Stage(name, Observation(f"{name}-{time.time_ns()}"))
        return df.observe(stage.observation, *counters(status))

    @contextmanager
    def timed(self, name: str) -> Iterator[Stage]:
        """Around the action that reads a stage's rows; fills in its counters and seconds."""
        stage, begin = self.stages[name], time.monotonic()
        yield stage
        stage.seconds = time.monotonic() - begin
        stage.counts = dict(stage.observation.get)

    def log(self) -> str:
        return "\n".join(s.line() for s in self.stages.values())


class StreamProgress(StreamingQueryListener):
    """Sums of observed counters over the batches of streams, by the observation's name; and whether a stream has failed."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.rows: dict[str, int] = defaultdict(int)
        self.seconds: dict[str, float] = defaultdict(float)
        self.running: set[str] = set()
        self.failures: dict[str, str] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self.lock:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        with self.lock:
            self.rows[str(p.runId)] += p.numInputRows
            self.seconds[str(p.runId)] += p.batchDuration / 1000
            for name, row in (p.observedMetrics or {}).items():
                for counter, n in row.asDict().items():
                    self.counts[name][counter] += n or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self.lock:
            self.running.discard(str(event.runId))
            if event.exception:
                self.failures[str(event.runId)] = event.exception
