"""Polling the progress of the session's jobs while a count runs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession


def snapshot(spark: SparkSession) -> dict[str, int]:
    """Tasks of the running stages: how many there are, run and are done."""
    tracker, out = spark.sparkContext.statusTracker(), {"tasks": 0, "active": 0, "done": 0}
    for stage in tracker.getActiveStageIds():
        info = tracker.getStageInfo(stage)
        if info:
            out["tasks"] += info.numTasks
            out["active"] += info.numActiveTasks
            out["done"] += info.numCompletedTasks
    return out


class Progress:
    """Calls ``report`` with a snapshot every ``gap`` seconds, and once at the end."""

    def __init__(self, spark: SparkSession, report: Callable[[dict[str, int]], None], gap: float = 1.0):
        self.spark, self.report, self.gap, self._end = spark, report, gap, threading.Event()

    def __enter__(self):
        def poll():
            while not self._end.wait(self.gap):
                self.report(snapshot(self.spark))

        self.began = time.monotonic()
        self._thread = threading.Thread(target=poll, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_):
        self._end.set()
        self._thread.join()
        self.report(snapshot(self.spark) | {"seconds": round(time.monotonic() - self.began)})
