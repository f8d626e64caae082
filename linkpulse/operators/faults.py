"""Router baselines taken from the records, what-if overlays and fault classification.

A router's normal level is the mean of its records without a fault; what a fault does is the mean distance of records
with that fault from their routers' levels. Both are aggregates that are reduced before the shuffle; the table
that is joined back has one row per router, or one per fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FAULTED, METRICS, PERCENT_METRICS
from .timeline import active_fault_asof

#: Width of a load band, in percent of bandwidth.
BAND = 10


def baseline(df: DataFrame) -> DataFrame:
    """Mean `base_<metric>` and standard deviation `spread_<metric>` of each router's fault-free records."""
    parts = [F.avg(m).alias(f"base_{m}") for m in METRICS] + [F.stddev_pop(m).alias(f"spread_{m}") for m in METRICS]
    return df.filter(F.col("active_fault").isNull()).groupBy("router_id").agg(*parts)


def with_baseline(df: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Add `base_<metric>`; NULL for a router that has no fault-free record."""
    level = baseline(df).select("router_id", *[f"base_{m}" for m in metrics])
    return df.join(level, "router_id", "left")


def deviation(df: DataFrame) -> DataFrame:
    """Each record's distance from its router's normal level, as `dev_<metric>`."""
    return with_baseline(df).select(
        "id", "router_id", "event_time", "active_fault",
        *[(F.col(m) - F.col(f"base_{m}")).alias(f"dev_{m}") for m in METRICS],
    )


def fault_effects(df: DataFrame) -> DataFrame:
    """Mean distance from the normal level, `effect_<metric>`, of the records with each fault."""
    return (
        deviation(df).filter(F.col("active_fault").isNotNull())
        .groupBy(F.col("active_fault").alias("fault_type"))
        .agg(*[F.avg(f"dev_{m}").alias(f"effect_{m}") for m in METRICS], F.count("*").alias("records"))
    )


def load_profile(df: DataFrame) -> DataFrame:
    """Mean latency, jitter and loss of the records in each band of bandwidth use."""
    band = (F.floor(F.col("bandwidth_usage") / BAND) * BAND).cast("int").alias("band")
    return df.groupBy(band).agg(
        F.count("*").alias("records"), *[F.avg(m).alias(m) for m in ("latency", "jitter", "packet_loss")]
    )


def apply_faults(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """Records as if the scheduled faults had happened: each metric is moved by what that fault does on average.

    Percentages stay within 0 to 100, other metrics at or above 0. Faults never recorded move nothing; records with no fault
    in force stay as they are.
    """
    effects = fault_effects(df).drop("records").withColumnRenamed("fault_type", "__fault")
    marked = active_fault_asof(df, schedule)
    moved = marked.join(effects, F.col("fault_type") == F.col("__fault"), "left")
    hit = F.col("fault_type").isNotNull()

    def rewritten(metric: str) -> Column:
        value = F.greatest(F.lit(0.0), F.col(metric) + F.coalesce(f"effect_{metric}", F.lit(0.0)))
        value = F.least(F.lit(100.0), value) if metric in PERCENT_METRICS else value
        return F.when(hit, value).otherwise(F.col(metric)).alias(metric)

    changed = {
        **{m: rewritten(m) for m in METRICS},
        "status": F.when(hit, F.lit(FAULTED)).otherwise(F.col("status")).alias("status"),
        "active_fault": F.coalesce("fault_type", "active_fault").alias("active_fault"),
    }
    return moved.select(*[changed.get(c, F.col(c)) for c in df.columns])


def classify_fault(df: DataFrame) -> DataFrame:
    """Name the fault a record's metrics point to, as `predicted_fault`; jitter and latency against the router's level.

    Without a level (no fault-free record of the router) these two count from 0.
    """
    based = with_baseline(df, ("latency", "jitter"))
    dl = F.col("latency") - F.coalesce("base_latency", F.lit(0.0))
    dj = F.col("jitter") - F.coalesce("base_jitter", F.lit(0.0))
    predicted = (
        F.when((F.col("packet_loss") >= 100) & (F.col("latency") >= 999), F.lit("Link Failure"))
        .when(F.col("bandwidth_usage") >= 88, F.lit("Bandwidth Congestion"))
        .when(F.col("memory_usage") >= 88, F.lit("Memory Overload"))
        .when(F.col("cpu_usage") >= 91, F.lit("CPU Overload"))
        .when(F.col("packet_loss") >= 4, F.lit("Packet Loss Spike"))
        .when((dj >= 10) & (dj > dl * F.lit(0.3)), F.lit("High Jitter"))
        .when(dl >= 49, F.lit("Latency Spike"))
    )
    return based.withColumn("predicted_fault", predicted).select(*df.columns, "predicted_fault")


def confusion(classified: DataFrame) -> DataFrame:
    """Records per recorded and predicted fault."""
    return classified.groupBy("active_fault", "predicted_fault").agg(
        F.count("*").alias("records")
    )
