"""A silent source among live ones."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackstream.streaming import idle, jobs

T0 = 1_704_067_200_000


def test_heartbeats_follow_the_slowest_live_source(spark, tmp_path):
    now = [0.0]
    sources = idle.IdleSources(spark, str(tmp_path), 30_000, lambda: now[0])
    sources.files = {n: idle.Files(spark, f"{tmp_path}/{n}") for n in "abc"}

    def beats(name):
        return sorted(json.loads(f.read_text())["event_ms"] for f in Path(tmp_path, name).glob("beat-*.json"))

    sources.came({"a": 100, "b": 40, "c": 30})
    for now[0], a, b in ((10, 200, 90), (29, 300, 150)):
        sources.came({"a": a, "b": b, "c": None})
    assert beats("c") == []  # not silent for long enough
    now[0] = 31
    sources.came({"a": 400, "b": 210, "c": None})
    sources.came({"a": 410, "b": None, "c": None})
    assert beats("c") == [210] and beats("a") == beats("b") == []
    now[0] = 40
    sources.came({"a": None, "b": 220, "c": 35})  # it comes back
    now[0] = 60
    sources.came({"a": 500, "b": 230, "c": None})
    assert beats("c") == [210]
    now[0] = 200
    sources.came({"a": None, "b": None, "c": None})  # all are silent: nobody to follow
    assert beats("a") == beats("b") == [] and beats("c") == [210]


@pytest.mark.parametrize("watched", [True, False])
def test_a_silent_source_holds_nothing_back_and_nothing_live_is_late(spark, tmp_path, watched):
    """Two live sources, one a minute behind the other, and one that stops after its first rows."""
    sources = idle.IdleSources(spark, f"{tmp_path}/beats", 1_500)
    spark.streams.addListener(sources)
    both, wrote = None, {}
    for name, lag, chunks in (("fast", 0, 10), ("slow", 60_000, 10), ("silent", 30_000, 1)):
        folder = f"{tmp_path}/{name}"
        for k in range(chunks):
            rows = spark.range(20).select(F.lit(name).alias("source"), (F.lit(T0 + k * 20_000 - lag) + F.col("id") * 1_000).alias("event_ms"))
            rows.coalesce(1).write.mode("append").parquet(folder)
            wrote[name] = wrote.get(name, 0) + 20
        stream = spark.readStream.schema("source string, event_ms long").option("maxFilesPerTrigger", 1).parquet(folder)
        stream = jobs.timed(sources.source(name, stream, source="beat") if watched else stream, "5 seconds")
        both = stream if both is None else both.unionByName(stream)
    counts = both.groupBy(F.window("event_time", "10 seconds"), "source").count()
    with jobs.stateful(spark, 1000):
        query = counts.writeStream.format("memory").queryName(f"idle_{watched}").outputMode("append").option("checkpointLocation", f"{tmp_path}/progress").trigger(processingTime="1 second").start()
        try:
            until = time.time() + 120
            last = T0 + 9 * 20_000 + 19_000 - 60_000 - 5_000  # of the slow source, less the delay
            while watched and time.time() < until and query.isActive:
                reached = (query.lastProgress or {}).get("eventTime", {}).get("watermark")
                if reached and spark.sql(f"select unix_millis(timestamp'{reached}')").first()[0] >= last:
                    query.processAllAvailable()
                    break
                time.sleep(0.5)
            if not watched:
                query.processAllAvailable()
            dropped = sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
            told = spark.sql(f"select source, max(unix_millis(window.end)) as upto, sum(count) as n from idle_{watched} group by source").collect()
        finally:
            query.stop()
            spark.streams.removeListener(sources)
    upto = {r.source: r.upto for r in told}
    assert dropped == 0
    if watched:  # all closed windows of the live sources are whole, up to the slow one's bound
        assert upto["slow"] >= last - 10_000 and upto["fast"] >= last - 10_000
    else:  # the silent source stops the watermark at its own last row
        assert all(t <= T0 - 30_000 + 19_000 for t in upto.values())
