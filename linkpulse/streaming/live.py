"""Live views on a stream of records."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import round_dp
from ..schema import METRICS

_STATE = ("event_time", *METRICS, "status", "active_fault")


def stream_router_states(records: DataFrame) -> DataFrame:
    """Latest record and sample count of each router; use update or complete mode.

    The same aggregate as in batch, so both give the same result.
    """
    newest = F.max_by(F.struct(*_STATE), F.struct("event_time", "id"))
    return (
        records.groupBy("router_id")
        .agg(newest.alias("s"), F.count("*").alias("total_samples"))
        .select(
            "router_id",
            F.col("s.event_time").alias("last_timestamp"),
            *[F.col(f"s.{c}").alias(c) for c in _STATE[1:]],
            "total_samples",
        )
    )


def stream_perf_series(
    records: DataFrame,
    metric: str,
    width: str = "1 hour",
    slide: str | None = None,
    watermark: str = "10 minutes",
    by: str = "role",
) -> DataFrame:
    """Average and maximum of a metric per window and group; append or update mode."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return (
        records.withWatermark("event_time", watermark)
        .groupBy(window.alias("w"), by)
        .agg(
            F.count(metric).alias("samples"),
            round_dp(F.avg(metric), 2).alias("avg"),
            F.max(metric).alias("max"),
        )
        .select(F.col("w.start").alias("bucket_start"), by, "samples", "avg", "max")
    )


def stream_fault_sessions(
    records: DataFrame, gap: str = "1 hour", watermark: str = "10 minutes"
) -> DataFrame:
    """Faulted records of a router closer together than `gap`, as sessions; append mode."""
    return (
        records.filter(F.col("active_fault").isNotNull())
        .withWatermark("event_time", watermark)
        .groupBy(F.session_window("event_time", gap).alias("w"), "router_id", "active_fault")
        .agg(F.count("*").alias("samples"), F.max("event_time").alias("ended_at"))
        .select(
            "router_id", "active_fault", F.col("w.start").alias("started_at"), "ended_at", "samples"
        )
    )


def dedup_within_watermark(records: DataFrame, watermark: str) -> DataFrame:
    """Drop repeated records with bounded state. Lossy: rows later than the watermark go.

    The stored table needs none of this (`append_new` takes rows of any age).
    """
    marked = records.withWatermark("event_time", watermark)
    return marked.dropDuplicatesWithinWatermark(["router_id", "timestamp"])


# --- Last k records per router ---

_TAIL_ORDER = ["event_time", "id"]


class _LastK(StatefulProcessor):
    """Keeps the newest k rows of a router as state and emits them when they change."""

    def __init__(self, k: int, columns: list[str], schema: T.StructType):
        self.k, self.columns, self.schema = k, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        kept = pd.DataFrame(list(self.rows.get()), columns=self.columns) if self.rows.exists() else None
        for part in rows:
            both = part[self.columns] if kept is None else pd.concat([kept, part[self.columns]])
            kept = both.sort_values(_TAIL_ORDER, ascending=False).head(self.k)
        if kept is None:
            return
        self.rows.put([tuple(r) for r in kept.itertuples(index=False)])
        yield kept.assign(rank=range(1, len(kept) + 1))

    def close(self) -> None:
        pass


def stream_last_k(records: DataFrame, k: int = 20, columns: tuple[str, ...] = ()) -> DataFrame:
    """The newest `k` records of each router that got new ones; update mode.

    Each task first cuts its rows down to k per router, so a busy router sends no more
    than that through the shuffle. Needs the RocksDB state store.
    """
    columns = list(dict.fromkeys(["router_id", *_TAIL_ORDER, *columns]))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ordered = part.sort_values(_TAIL_ORDER, ascending=False)
            yield ordered.groupby("router_id", sort=False).head(k)

    rows = records.select(*columns)
    schema = rows.schema
    out = T.StructType([*schema.fields, T.StructField("rank", T.LongType())])
    return (
        rows.mapInPandas(cut, schema)
        .groupBy("router_id")
        .transformWithStateInPandas(
            statefulProcessor=_LastK(k, columns, schema),
            outputStructType=out,
            outputMode="Update",
            timeMode="None",
        )
    )
