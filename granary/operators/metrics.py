"""Counters of a run, taken by the jobs that do its work: no stage is read a second time."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class RunMetrics(StreamingQueryListener):
    """Observes stages of a run under names; row() has all counters in one row.

    A batch's counters are there when its job has ended. A stream's are added up over micro-batches; add the object to the
    session's listeners for these (`spark.streams.addListener`). Counters named max_... keep the largest value.
    """

    def __init__(self, run_id: str | None = None):
        self.run_id, self.began = run_id or uuid.uuid4().hex[:12], time.time()
        self.batch: list[Observation] = []
        self.streams: dict[str, int | float] = {}
        self.names: list[str] = []

    def observe(self, df: DataFrame, stage: str, **counters: Column) -> DataFrame:
        """df, of which an action also takes counters (aggregates), as <stage>_<name>."""
        named = [c.alias(f"{stage}_{n}") for n, c in counters.items()]
        self.names += [f"{stage}_{n}" for n in counters]
        if df.isStreaming:
            return df.observe(f"run:{self.run_id}:{stage}", *named)
        self.batch.append(Observation(f"{self.run_id}-{stage}-{len(self.batch)}"))
        return df.observe(self.batch[-1], *named)

    def _add(self, name: str, value) -> None:
        if value is not None:
            old = self.streams.get(name)
            self.streams[name] = value if old is None else max(old, value) if "_max_" in name else old + value

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        for key, row in event.progress.observedMetrics.items():
            if key.startswith(f"run:{self.run_id}:"):
                for name, value in row.asDict().items():
                    self._add(name, value)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def values(self, wait: float = 10.0) -> dict[str, int | float | None]:
        """All counters. Those of a stage whose job has not ended within some seconds are null."""
        out: dict[str, int | float | None] = dict.fromkeys(self.names) | self.streams
        until = time.time() + wait
        for o in self.batch:
            got: list[dict] = []
            taking = threading.Thread(target=lambda o=o, got=got: got.append(o.get), daemon=True)  # blocks until the job has ended
            taking.start()
            taking.join(max(0.0, until - time.time()))
            out |= got[0] if got else {}
        return out

    def row(self, spark: SparkSession) -> DataFrame:
        """One row: run_id, total_runtime_seconds and the counters."""
        own = self.values()
        kinds = ", ".join(f"`{k}` {'double' if isinstance(v, float) else 'long'}" for k, v in own.items())
        return spark.createDataFrame([(self.run_id, round(time.time() - self.began, 2), *own.values())], "run_id string, total_runtime_seconds double" + (", " + kinds if kinds else ""))


def reason_counters(reason: Column, reasons: tuple[str, ...]) -> dict[str, Column]:
    """Counters for observe(): how many rows have each of the reasons, and none."""
    return {f"rejected_{r}": F.count_if(reason == r) for r in reasons} | {"passed": F.count_if(reason.isNull())}


def success_rate(attempted: Column, success: Column) -> Column:
    return F.when(attempted > 0, F.round(success / attempted * 100, 1)).otherwise(0.0)
