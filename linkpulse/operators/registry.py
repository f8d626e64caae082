"""Latest state per router, and joins with the registry, schedules and topology.

No side is forced to be broadcast: the router-level results have one row per router,
and Spark picks a broadcast only under its own size threshold.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canon_router_id, strip, time_literal
from ..schema import (
    DEFAULT_FAULT_TYPE,
    DEFAULT_INTENSITY,
    FAULT_TYPES,
    FAULTED,
    INTENSITIES,
    METRICS,
)

# Ranges that natural ranks are counted in.
RANGES = 256

_STATE = ("event_time", *METRICS, "status", "active_fault")


def router_states(df: DataFrame) -> DataFrame:
    """The newest record of every router and its number of samples.

    One aggregate gives both, reduced on the map side.
    """
    newest = F.max_by(F.struct(*_STATE), F.struct("event_time", "id"))
    return (
        df.groupBy("router_id")
        .agg(newest.alias("s"), F.count("*").alias("total_samples"))
        .select(
            "router_id",
            F.col("s.event_time").alias("last_timestamp"),
            *[F.col(f"s.{c}").alias(c) for c in _STATE[1:]],
            "total_samples",
        )
        .orderBy("router_id")
    )


def latest_per_router(df: DataFrame) -> DataFrame:
    """The newest full record of every router, by rank."""
    order = [F.col("event_time").desc(), F.col("id").desc()]
    rank = F.row_number().over(Window.partitionBy("router_id").orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") == 1).drop("rank")


def fault_badges(states: DataFrame) -> DataFrame:
    """How many routers there are and how many of them are faulted."""
    return states.agg(
        F.count("*").alias("routers"),
        F.count_if(F.col("status") == FAULTED).alias("faulted"),
    )


def clean_registry(registry: DataFrame) -> DataFrame:
    """One registry row per canonical id, with a name in every row.

    Of several rows whose ids become equal the last one counts: by `seq` where there is such a
    column, else the largest by its values, so that reruns agree.
    """
    rid = canon_router_id("router_id")
    named = F.coalesce(F.nullif(strip("name"), F.lit("")), F.concat(F.lit("Router "), rid))
    clean = registry.withColumns({"name": named, "router_id": rid})
    rest = [c for c in clean.columns if c != "router_id"]
    order = F.struct(*(["seq"] if "seq" in rest else []), *[c for c in rest if c != "seq"])
    last = clean.groupBy("router_id").agg(F.max(order).alias("r"))
    return last.select(*["router_id" if c == "router_id" else F.col(f"r.{c}").alias(c) for c in clean.columns])


def clean_schedule(schedule: DataFrame) -> DataFrame:
    """Fault schedule with canonical ids and known fault and intensity names."""
    return schedule.withColumns(
        {
            "router_id": canon_router_id("router_id"),
            "fault_type": F.when(
                F.col("fault_type").isin(*FAULT_TYPES), F.col("fault_type")
            ).otherwise(F.lit(DEFAULT_FAULT_TYPE)),
            "intensity": F.when(
                F.col("intensity").isin(*INTENSITIES), F.col("intensity")
            ).otherwise(F.lit(DEFAULT_INTENSITY)),
        }
    )


def fault_end(started: Column | str = "started_at", seconds: Column | str = "duration_s") -> Column:
    """The moment a scheduled fault runs out."""
    start = F.col(started) if isinstance(started, str) else started
    length = F.col(seconds) if isinstance(seconds, str) else seconds
    return start + F.make_dt_interval(secs=length.cast("decimal(18,6)"))


def active_faults(schedule: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """The fault in force per router at `as_of`: the newest one started, if not over.

    `schedule` needs `seq` to order faults of one router that start together.
    """
    now = time_literal(schedule, "started_at", as_of)
    fields = [c for c in schedule.columns if c != "router_id"]
    newest = F.max_by(F.struct(*fields), F.struct("started_at", "seq"))
    return (
        schedule.filter(F.col("started_at") <= now)
        .groupBy("router_id")
        .agg(newest.alias("f"))
        .select("router_id", "f.*")
        .filter(now < fault_end())
    )


def registry_view(registry: DataFrame, faults: DataFrame, states: DataFrame) -> DataFrame:
    """Every registered router with its active fault and its newest record, if any.

    The router counts as faulted exactly while a fault is in force.
    """
    fault = faults.select("router_id", "fault_type", "intensity", "started_at")
    telemetry = states.select("router_id", "last_timestamp", *METRICS)
    joined = registry.join(fault, "router_id", "left").join(telemetry, "router_id", "left")
    has_fault = F.col("fault_type").isNotNull()
    return joined.withColumns(
        {
            "has_fault": has_fault,
            "status": F.when(has_fault, F.lit(FAULTED)).otherwise(F.lit("ACTIVE")),
        }
    )


def known_routers(ids: DataFrame, df: DataFrame) -> DataFrame:
    """The requested ids that have telemetry."""
    return ids.join(df.select("router_id").distinct(), "router_id", "left_semi")


def unknown_routers(ids: DataFrame, df: DataFrame) -> DataFrame:
    """The requested ids without telemetry."""
    return ids.join(df.select("router_id").distinct(), "router_id", "left_anti")


def natural_order(df: DataFrame) -> DataFrame:
    """Order by length, then text, so that R2 comes before R10."""
    return df.orderBy(F.length("router_id"), "router_id")


def natural_rank(df: DataFrame) -> DataFrame:
    """`natural_order` as a dense number per router id, from 1.

    A fixed number of ids, drawn by hash, splits the order into ranges of about equal size, whatever the ids begin
    with. Ids are numbered inside their range, then the sizes of all earlier ranges are added.
    """
    key = F.struct(F.length("router_id").alias("len"), F.col("router_id").alias("id"))
    ids = df.select("router_id").distinct().withColumn("key", key)
    drawn = ids.filter("router_id IS NOT NULL").orderBy(F.xxhash64("router_id"), "router_id").limit(RANGES - 1)
    borders = drawn.agg(F.collect_list("key")).scalar()
    block = F.size(F.filter("borders", lambda b: b <= F.col("key")))
    ids = ids.withColumn("borders", borders)
    ids = ids.withColumn("block", F.when(F.col("router_id").isNull(), F.lit(-1)).otherwise(block)).drop("borders")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy("block").agg(F.count("*").alias("size"))
    offsets = sizes.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("key"))
    return (
        ids.withColumn("within", within)
        .join(offsets, "block")
        .select("router_id", (F.col("offset") + F.col("within")).cast("bigint").alias("natural_rank"))
    )


def link_status(edges: DataFrame, health: DataFrame) -> DataFrame:
    """Status of each link: the worse one of its two ends.

    A router without known health counts as healthy.
    """
    src = health.select(F.col("router_id").alias("src_router"), F.col("health").alias("src_health"))
    dst = health.select(F.col("router_id").alias("dst_router"), F.col("health").alias("dst_health"))
    joined = edges.join(src, "src_router", "left").join(dst, "dst_router", "left")
    either = lambda level: F.coalesce(
        (F.col("src_health") == level), F.lit(False)
    ) | F.coalesce(F.col("dst_health") == level, F.lit(False))
    worst = (
        F.when(either("CRITICAL"), F.lit("CRITICAL"))
        .when(either("WARNING"), F.lit("WARNING"))
        .otherwise(F.lit("HEALTHY"))
    )
    return joined.select("src_router", "dst_router", worst.alias("status"))
