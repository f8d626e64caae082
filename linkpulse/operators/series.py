"""Metric series over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_dp


def _seconds(text: str) -> int:
    number, unit = text.split()
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(number) * scale[unit.rstrip("s")]


def perf_series(
    df: DataFrame,
    metric: str,
    width: str = "1 hour",
    slide: str | None = None,
    by: str = "role",
    registry: DataFrame | None = None,
) -> DataFrame:
    """Average and maximum of a metric per time window and group.

    With a `registry`, the group column comes from there; records of routers that it does not
    name form the group NULL. Ids must have one form on both sides: registry ids as `clean_registry` gives
    them (upper case), one row each. Records are first reduced
    to one row per router and pane (the slide, or the width for tumbling windows);
    the join and the spreading over overlapping windows work on that result only.
    Rows are `(bucket_start, <by>, samples, avg, max)`.
    """
    step = slide or width
    panes = _seconds(width) // _seconds(step)
    if panes * _seconds(step) != _seconds(width):
        raise ValueError("the width must be a multiple of the slide")
    unit = "router_id" if registry is not None else by
    kind = df.schema["event_time"].dataType
    reduced = (
        df.filter(F.col("event_time").isNotNull())
        .groupBy(F.window("event_time", step).alias("pane"), unit)
        .agg(F.count(metric).alias("n"), F.sum(metric).alias("s"), F.max(metric).alias("top"))
        .withColumn("start", F.col("pane.start").cast(kind))
        .drop("pane")
    )
    if registry is not None:
        reduced = reduced.join(registry.select("router_id", by), "router_id", "left")
    if panes > 1:
        # A pane belongs to the window that starts with it and to earlier ones.
        back = F.explode(F.sequence(F.lit(0), F.lit(panes - 1)))
        reduced = reduced.withColumn("back", back).withColumn(
            "start",
            F.col("start") - F.make_dt_interval(secs=F.col("back") * F.lit(_seconds(step))),
        )
    return reduced.groupBy(F.col("start").alias("bucket_start"), by).agg(
        F.sum("n").alias("samples"),
        round_dp(F.sum("s") / F.sum("n"), 2).alias("avg"),
        F.max("top").alias("max"),
    )


def network_series(df: DataFrame, metric: str, width: str = "1 hour") -> DataFrame:
    """Average and maximum of a metric per tumbling window over all routers."""
    return perf_series(df.withColumn("scope", F.lit("network")), metric, width, by="scope")


def role_of(number: Column) -> Column:
    """Role by router number: odd ones are core, even ones edge."""
    return F.when(number % 2 == 1, F.lit("CORE")).otherwise(F.lit("EDGE"))
