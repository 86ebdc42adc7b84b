"""Idle sources: one that is silent for some time no longer holds back the watermark of a query over several sources.

Spark's watermark over several sources is the least of theirs, so a silent one would stop it; the ``max`` policy would make
rows of the slower live sources late. Here a listener sees how far the rows of each source have come. Where a source has
brought none for ``idle_ms`` of processing time, it gets a heartbeat row at the least time of the live ones, through a
folder that is part of the source's stream. So the watermark goes on at the pace of the slowest live source. When a silent
source comes back, its rows behind that are late.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from trackstream.operators.manifests import Files

IDLE_MS = 30_000


class IdleSources(StreamingQueryListener):
    """Sources of one query; attach it with ``spark.streams.addListener`` before the query starts."""

    def __init__(self, spark: SparkSession, folder: str, idle_ms: int = IDLE_MS, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.idle, self.clock = spark, folder.rstrip("/"), idle_ms / 1000, clock
        self.files: dict[str, Files] = {}
        self.top: dict[str, int] = {}
        self.seen: dict[str, float] = {}
        self.sent: dict[str, int] = {}

    def source(self, name: str, rows: DataFrame, **marks: object) -> DataFrame:
        """``rows`` (with event_ms) and the source's heartbeats, which have ``marks`` and nulls; put the watermark on this."""
        self.files[name] = Files(self.spark, f"{self.folder}/{name}")
        self.files[name].put("_start", "")  # the folder is there before the stream looks for it
        beats = self.spark.readStream.schema("event_ms long").json(f"{self.folder}/{name}")
        beats = beats.withColumns({c: F.lit(v).cast(rows.schema[c].dataType) for c, v in marks.items()})
        return rows.observe(name, F.max("event_ms").alias("top")).unionByName(beats, allowMissingColumns=True)

    def came(self, tops: dict[str, int | None]) -> None:
        """Takes note of the greatest event time that each source brought in a batch, and sends what heartbeats are due."""
        now = self.clock()
        for name in self.files:
            self.seen.setdefault(name, now)
            if tops.get(name) is not None:
                self.top[name], self.seen[name] = max(tops[name], self.top.get(name, tops[name])), now
        live = [n for n in self.files if now - self.seen[n] <= self.idle]
        if not live or any(n not in self.top for n in live):  # a live source that has brought nothing yet still counts
            return
        bound = min(self.top[n] for n in live)
        for name in self.files:
            if name not in live and bound > self.sent.get(name, self.top.get(name, -1)):
                self.files[name].put(f"beat-{bound}-{uuid.uuid4().hex[:8]}.json", json.dumps({"event_ms": bound}))
                self.sent[name] = bound

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics
        if any(name in told for name in self.files):
            self.came({name: told[name]["top"] for name in self.files if name in told})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
