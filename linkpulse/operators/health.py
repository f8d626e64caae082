"""Threshold breaches and what follows from them: health, risk, events, key figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_dp
from ..schema import (
    CRITICAL_LIMITS,
    METRIC_FAULT,
    METRICS,
    NO_BREACH_EVENT,
    PRIMARY_EVENTS,
    WARNING_LIMITS,
)
from .select import newest_per_router

HIGH_RISK = 0.75
MEDIUM_RISK = 0.5


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def any_breach() -> Column:
    """True where any metric is above its warning limit."""
    return _any([F.col(m) > limit for m, limit in WARNING_LIMITS.items()])


def any_critical() -> Column:
    """True where any metric is above its critical limit."""
    return _any([F.col(m) > limit for m, limit in CRITICAL_LIMITS.items()])


def severity(metric: str) -> Column:
    """CRITICAL, WARNING or NULL for one metric."""
    level = F.when(F.col(metric) > WARNING_LIMITS[metric], F.lit("WARNING"))
    if metric in CRITICAL_LIMITS:
        critical = F.col(metric) > CRITICAL_LIMITS[metric]
        level = F.when(critical, F.lit("CRITICAL")).otherwise(level)
    return level


def primary_metric() -> Column:
    """The breached metric with the largest value relative to its critical limit."""
    ratio = {
        m: F.when(F.col(m) > WARNING_LIMITS[m], F.col(m) / F.lit(CRITICAL_LIMITS[m])).otherwise(
            F.lit(0.0)
        )
        for m, _ in PRIMARY_EVENTS
    }
    top = F.greatest(*ratio.values())
    choice = F.lit(None).cast("string")
    for m in reversed(list(ratio)):
        choice = F.when(ratio[m] == top, F.lit(m)).otherwise(choice)
    return F.when(top > 0, choice)


def alerts(df: DataFrame) -> DataFrame:
    """One row per record and breached metric.

    The filter ahead of the split uses plain comparisons, which reach the scan.
    """
    each = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).alias("value"),
                severity(m).alias("severity"),
                F.lit(METRIC_FAULT[m]).alias("fault_name"),
            )
            for m in METRICS
        ]
    )
    return (
        df.filter(any_breach())
        .select("id", "router_id", "event_time", primary_metric().alias("main"), F.explode(each).alias("a"))
        .filter(F.col("a.severity").isNotNull())
        .select(
            "id",
            "router_id",
            "event_time",
            "a.*",
            F.coalesce(F.col("a.metric") == F.col("main"), F.lit(False)).alias("primary"),
        )
    )


def health_level() -> Column:
    """CRITICAL, WARNING or HEALTHY from the metric columns of a row."""
    return (
        F.when(any_critical(), F.lit("CRITICAL"))
        .when(any_breach(), F.lit("WARNING"))
        .otherwise(F.lit("HEALTHY"))
    )


def router_health(states: DataFrame) -> DataFrame:
    """Health of each router from its newest record."""
    return states.select("router_id", health_level().alias("health"))


def event_feed(df: DataFrame) -> DataFrame:
    """One event per record, named after its primary breach."""
    kind = F.lit(NO_BREACH_EVENT)
    for metric, name in PRIMARY_EVENTS:
        kind = F.when(F.col("main") == metric, F.lit(name)).otherwise(kind)
    value = F.lit(None).cast("double")
    for metric, _ in PRIMARY_EVENTS:
        value = F.when(F.col("main") == metric, F.col(metric)).otherwise(value)
    return df.withColumn("main", primary_metric()).select(
        "id", "router_id", "event_time", kind.alias("event"), value.alias("value")
    )


def kpis(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Key figures of the network: one row.

    Health share, availability (samples that are no link failure), reporting and
    registered routers, and open alerts (breaches in the newest records).
    """
    per_router = (
        df.groupBy("router_id")
        .agg(
            F.max_by(F.struct(*METRICS), F.struct("event_time", "id")).alias("s"),
            F.count("*").alias("samples"),
            F.count_if(F.col("active_fault") == "Link Failure").alias("down"),
        )
        .select("samples", "down", "s.*")
    )
    breaches = reduce(
        lambda a, b: a + b,
        [(F.col(m) > limit).cast("int") for m, limit in WARNING_LIMITS.items()],
    )
    registered = registry.agg(F.count_distinct("router_id").alias("n")).scalar()
    healthy = F.count_if(health_level() == "HEALTHY")
    return per_router.agg(
        round_dp(healthy * 100 / F.nullif(F.count("*"), F.lit(0)), 2).alias("health_pct"),
        round_dp(F.lit(100) - F.sum("down") * 100 / F.sum("samples"), 2).alias(
            "availability_pct"
        ),
        F.count("*").alias("routers_reporting"),
        F.coalesce(F.sum(breaches), F.lit(0)).alias("open_alerts"),
    ).withColumn("routers_registered", registered)


def risk(df: DataFrame, n: int = 20) -> DataFrame:
    """Share of each router's last `n` records with any breach, and its level."""
    lasts = newest_per_router(df, n)
    score = round_dp(F.count_if(any_breach()) / F.count("*"), 4)
    breached = F.array_compact(
        F.array(
            *[
                F.when(F.max(F.col(m) > limit), F.lit(m))
                for m, limit in WARNING_LIMITS.items()
            ]
        )
    )
    return (
        lasts.groupBy("router_id")
        .agg(
            F.count("*").alias("samples"),
            score.alias("score"),
            F.array_sort(breached).alias("metrics"),
        )
        .withColumn(
            "level",
            F.when(F.col("score") >= HIGH_RISK, F.lit("HIGH"))
            .when(F.col("score") >= MEDIUM_RISK, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")),
        )
    )
