from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkpulse.operators import registry, select, series
from linkpulse.streaming import live
from tests.helpers import telemetry

T0 = datetime(2026, 10, 8, 10, 0, 0)


class Feed:
    """A folder of Parquet parts read as a stream, one part per batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.parts, self.schema = spark, folder, 0, None

    def add(self, df):
        self.parts += 1
        self.schema = df.schema
        df.coalesce(1).write.parquet(str(self.folder / "in" / f"part={self.parts}"))

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(str(self.folder / "in" / "*"))

    def run(self, df, mode, name):
        query = (
            df.writeStream.outputMode(mode).format("memory").queryName(name)
            .option("checkpointLocation", str(self.folder / name)).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return self.spark.table(name).collect()


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def rows(spark, *specs):
    return telemetry(
        spark,
        [(i, r, (T0 + timedelta(minutes=m)).isoformat() + "Z", lat, f) for i, r, m, lat, f in specs],
    )


def test_states_match_batch(spark, feed):
    a = rows(spark, (1, "R1", 0, 1, None), (2, "R2", 1, 2, None))
    b = rows(spark, (3, "R1", 5, 3, "High Jitter"), (4, "R1", 3, 4, None))
    feed.add(a)
    feed.add(b)
    got = feed.run(live.stream_router_states(feed.stream()), "update", "states")
    final = {}
    for r in got:  # later rows replace earlier ones
        if r.router_id not in final or r.total_samples > final[r.router_id].total_samples:
            final[r.router_id] = r
    want = {r.router_id: r for r in registry.router_states(a.unionByName(b)).collect()}
    assert final == want
    assert len(got) == 3  # the second batch says nothing about R2


def test_series_and_sessions(spark, feed):
    core = F.lit("CORE").alias("role")
    data = rows(
        spark, (1, "R1", 0, 10, "High Jitter"), (2, "R1", 20, 20, "High Jitter"),
        (3, "R2", 70, 30, "High Jitter"), (4, "R1", 200, 5, "High Jitter"),
    ).select("*", core)
    feed.add(data)
    # A later row moves the watermark past everything before it.
    feed.add(rows(spark, (9, "R1", 1000, 1, None)).select("*", core))
    feed.add(rows(spark, (10, "R1", 1001, 1, None)).select("*", core))
    got = feed.run(live.stream_perf_series(feed.stream(), "latency"), "append", "perf")
    batch = series.perf_series(data, "latency", by="role").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    sliding = feed.run(
        live.stream_perf_series(feed.stream(), "latency", "2 hours", "1 hour"), "append", "perf2"
    )
    batch = series.perf_series(data, "latency", "2 hours", "1 hour").collect()
    assert sorted(map(tuple, sliding)) == sorted(map(tuple, batch))


def test_fault_sessions(spark, feed):
    feed.add(rows(
        spark, (1, "R1", 0, 1, "High Jitter"), (2, "R1", 20, 1, "High Jitter"),
        (3, "R1", 30, 1, "CPU Overload"), (4, "R1", 200, 1, "High Jitter"), (5, "R2", 10, 1, None),
    ))
    feed.add(rows(spark, (9, "R9", 1000, 1, "High Jitter")))
    feed.add(rows(spark, (10, "R9", 2000, 1, "High Jitter")))
    got = feed.run(live.stream_fault_sessions(feed.stream()), "append", "sessions")
    seen = {(r.router_id, r.active_fault, r.samples) for r in got}
    assert {("R1", "High Jitter", 2), ("R1", "CPU Overload", 1), ("R1", "High Jitter", 1)} <= seen
    first = next(r for r in got if r.samples == 2)
    assert (first.started_at, first.ended_at) == (T0, T0 + timedelta(minutes=20))


def test_last_k(spark, feed):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    a = rows(spark, *[(i, "R1", i, i, None) for i in range(8)], (50, "R2", 1, 1, None))
    b = rows(spark, (20, "R1", 30, 20, None), (21, "R1", -5, 21, None))
    feed.add(a)
    feed.add(b)
    got = feed.run(live.stream_last_k(feed.stream(), 3, ("latency",)), "update", "last_k")
    want = select.newest_per_router(a.unionByName(b), 3).filter("router_id = 'R1'")
    last = got[-3:]
    assert [(r.id, r.latency, r.rank) for r in sorted(last, key=lambda r: r.rank)] == [
        (r.id, r.latency, r.rank) for r in want.orderBy("rank").collect()
    ]
    assert {r.id for r in got if r.router_id == "R2"} == {50}


def test_dedup_within_watermark_drops_repeats(spark, feed):
    a = rows(spark, (1, "R1", 0, 1, None))
    feed.add(a.unionByName(a))
    feed.add(a)
    got = feed.run(live.dedup_within_watermark(feed.stream(), "10 minutes"), "append", "dedup")
    assert len(got) == 1
