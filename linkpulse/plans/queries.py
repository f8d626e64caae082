"""The registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import faults, health, ingest, ledger, registry, select, series, stats, timeline
from ..schema import METRICS, RECORD_FIELDS
from ..sources.log import log_tail
from . import views
from .views import AS_OF

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query under its function's name."""
    _QUERIES[f.__name__] = f
    return f


def all_queries() -> dict[str, Query]:
    """All registered queries."""
    from .stored import STORED

    return _QUERIES | {q.__name__: q for q in STORED}


# --- Scans, filters, newest-N ---


@query
def recent_window(spark, d):
    return select.recent(views.telemetry(spark, d), minutes=1440, n=2000, as_of=AS_OF)


@query
def recent_router_window(spark, d):
    t = views.telemetry(spark, d)
    return select.recent(t, minutes=1440, router_id=" R7 ", n=2000, as_of=AS_OF)


@query
def recent_all(spark, d):
    return select.recent(views.telemetry(spark, d))


@query
def router_history(spark, d):
    return select.router_history(views.telemetry(spark, d), "R7")


@query
def latest_n(spark, d):
    return select.latest(views.telemetry(spark, d))


@query
def live_tail(spark, d):
    return select.live_tail(views.telemetry(spark, d))


@query
def history_per_router(spark, d):
    return select.history_per_router(views.telemetry(spark, d), 5)


@query
def fault_records_any(spark, d):
    return views.telemetry(spark, d).filter(select.is_fault()).select(
        "id", "router_id", "status", "active_fault"
    )


@query
def event_lines(spark, d):
    return select.event_lines(views.telemetry(spark, d))


# --- Latest state, registry, joins ---


@query
def router_states(spark, d):
    return registry.router_states(views.telemetry(spark, d))


@query
def latest_per_router(spark, d):
    return registry.latest_per_router(views.telemetry(spark, d))


@query
def registry_view(spark, d):
    active = registry.active_faults(views.schedule(spark, d), AS_OF)
    states = registry.router_states(views.telemetry(spark, d))
    return registry.registry_view(views.registry(spark, d), active, states)


@query
def known_routers(spark, d):
    ids = views.registry(spark, d).select("router_id")
    return registry.known_routers(ids, views.telemetry(spark, d))


@query
def unknown_routers(spark, d):
    ids = views.registry(spark, d).select("router_id")
    return registry.unknown_routers(ids, views.telemetry(spark, d))


@query
def natural_rank(spark, d):
    return registry.natural_rank(views.telemetry(spark, d))


@query
def fault_badges(spark, d):
    return registry.fault_badges(registry.router_states(views.telemetry(spark, d)))


@query
def fault_schedule_clean(spark, d):
    return views.schedule(spark, d)


@query
def link_status(spark, d):
    states = registry.router_states(views.telemetry(spark, d))
    return registry.link_status(views.edges(spark, d), health.router_health(states))


# --- Statistics ---


@query
def summary(spark, d):
    return stats.summary(views.telemetry(spark, d))


@query
def metric_stats(spark, d):
    return stats.metric_stats(views.telemetry(spark, d))


@query
def status_distribution(spark, d):
    return stats.status_distribution(views.telemetry(spark, d))


@query
def fault_distribution(spark, d):
    return stats.fault_distribution(views.telemetry(spark, d))


@query
def sample_counts(spark, d):
    return stats.sample_counts(views.telemetry(spark, d))


@query
def distinct_routers(spark, d):
    return stats.routers(views.telemetry(spark, d))


@query
def router_stats_rollup(spark, d):
    return stats.router_stats(views.telemetry(spark, d))


@query
def stats_table(spark, d):
    return stats.stats_table(views.telemetry(spark, d))


def _flat(document: DataFrame) -> DataFrame:
    """The statistics document with its maps and lists as text."""

    def text(c: str):
        pairs = F.array_sort(F.map_entries(c))
        return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")

    return document.select(
        "total_records",
        "router_count",
        F.array_join("routers", ",").alias("routers"),
        "earliest",
        "latest",
        "time_window_minutes",
        *[
            F.col("metrics")[m][k].alias(f"{k}_{m}") for m in METRICS for k in ("min", "max", "avg")
        ],
        text("status_distribution").alias("status_distribution"),
        text("fault_distribution").alias("fault_distribution"),
    )


@query
def stats_document(spark, d):
    return _flat(stats.stats(views.telemetry(spark, d)))


@query
def stats_window(spark, d):
    return _flat(stats.stats(views.telemetry(spark, d), 1440, AS_OF))


@query
def stats_empty_window(spark, d):
    return _flat(stats.stats(views.telemetry(spark, d), 60, "2030-01-01 00:00:00"))


# --- Ingestion ---


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return ingest.label(ingest.parse_lines(views.raw_lines(spark, d)))


@query
def ingest_valid(spark, d):
    return ingest.accepted(_labelled(spark, d)).select(
        F.col("src_pos.block").alias("line"), *RECORD_FIELDS
    )


@query
def ingest_rejects(spark, d):
    return ingest.rejected(_labelled(spark, d)).select(
        F.col("src_pos.block").alias("line"), "reject_reason"
    )


@query
def reject_reason_counts(spark, d):
    return ingest.reject_reason_counts(ingest.rejected(_labelled(spark, d)))


@query
def canonical_record(spark, d):
    return ingest.canonicalize(views.telemetry(spark, d))


@query
def log_tail_lines(spark, d):
    return log_tail(views.raw_lines(spark, d)).select(F.col("src_pos.block").alias("line"))


_ARRIVED = ("arrival", "id", "router_id", "timestamp", "latency", "active_fault")


@query
def dedup_first_arrival(spark, d):
    return ingest.first_arrival(views.arrivals(spark, d).select(*_ARRIVED), order=["arrival"])


@query
def insert_or_ignore(spark, d):
    stored = views.telemetry(spark, d).filter(F.col("event_time") < "2024-01-16 00:00:00")
    batch = views.arrivals(spark, d).select(*_ARRIVED)
    return ingest.insert_or_ignore(batch, stored, order=["arrival"])


@query
def upsert_last_write(spark, d):
    writes = views.table(spark, d, "events").select(
        F.concat_ws("/", "event_type", "props").alias("key"),
        F.col("user_id").alias("value"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("write_no"),
    )
    return ingest.latest_by_key(writes, ["key"], ["updated_at", "write_no"])


@query
def ingest_status(spark, d):
    return ledger.ingest_status(views.ledger(spark, d))


# --- Faults ---


@query
def fault_asof(spark, d):
    t = views.telemetry(spark, d).select("id", "router_id", "event_time")
    return timeline.active_fault_asof(t, views.schedule(spark, d))


@query
def fault_overlay(spark, d):
    t = views.telemetry(spark, d).drop("timestamp")
    return faults.apply_faults(t, views.schedule(spark, d)).select(
        "id", "router_id", *_rounded(METRICS), "status", "active_fault"
    )


def _rounded(names):
    from ..functions import round_dp

    return [round_dp(n, 4).alias(n) for n in names]


@query
def fault_episodes(spark, d):
    return timeline.fault_episodes(views.telemetry(spark, d))


@query
def baseline_profile(spark, d):
    return faults.baseline(views.telemetry(spark, d)).select(
        "router_id", *_rounded([f"{kind}_{m}" for kind in ("base", "spread") for m in METRICS])
    )


@query
def baseline_deviation(spark, d):
    return faults.deviation(views.telemetry(spark, d)).select(
        "id", "router_id", *_rounded([f"dev_{m}" for m in METRICS])
    )


@query
def congestion_terms(spark, d):
    return faults.load_profile(views.telemetry(spark, d)).select(
        "band", "records", *_rounded(["latency", "jitter", "packet_loss"])
    )


@query
def fault_effects(spark, d):
    return faults.fault_effects(views.telemetry(spark, d)).select(
        "fault_type", "records", *_rounded([f"effect_{m}" for m in METRICS])
    )


@query
def classify_fault(spark, d):
    return faults.classify_fault(views.telemetry(spark, d)).select(
        "id", "router_id", "active_fault", "predicted_fault"
    )


@query
def fault_confusion(spark, d):
    return faults.confusion(faults.classify_fault(views.telemetry(spark, d)))


# --- Health ---


@query
def alerts(spark, d):
    return health.alerts(views.telemetry(spark, d))


@query
def router_health(spark, d):
    return health.router_health(registry.router_states(views.telemetry(spark, d)))


@query
def event_feed(spark, d):
    return health.event_feed(views.telemetry(spark, d))


@query
def kpis(spark, d):
    return health.kpis(views.telemetry(spark, d), views.registry(spark, d))


@query
def risk(spark, d):
    return health.risk(views.telemetry(spark, d)).withColumn(
        "metrics", F.array_join("metrics", ",")
    )


# --- Series ---


@query
def perf_series_hourly(spark, d):
    return series.perf_series(
        views.telemetry(spark, d), "cpu_usage", registry=views.registry(spark, d)
    )


@query
def perf_series_sliding(spark, d):
    return series.perf_series(
        views.telemetry(spark, d), "latency", "6 hours", "1 hour", registry=views.registry(spark, d)
    )


@query
def network_series_daily(spark, d):
    return series.network_series(views.telemetry(spark, d), "latency", "1 day")
