"""Operators that follow the time line of each router.

A router may hold a large share of all rows, so no task gets a router's whole
history. Rows are grouped by (router, time bucket): because a router has one record
per instant, such a group is bounded by the bucket width, whatever the table size.
What must cross bucket borders is carried in a table with a few rows per bucket.
Rows without a time have no place on the line and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import fault_end

HOUR = 3600


def _bucket(time: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(seconds * 1_000_000))


def active_fault_asof(df: DataFrame, schedule: DataFrame, bucket_s: int = HOUR) -> DataFrame:
    """Give each record the scheduled fault of its router that is in force.

    That is the newest fault with `started_at <= event_time`, if it has not run out;
    a newer fault replaces an older one even when it is shorter. Adds the columns
    `fault_type`, `intensity` and `started_at` (NULL where no fault is in force).
    `schedule` needs `seq` to order faults of one router that start together.
    """
    fault = F.struct("fault_type", "intensity", "started_at", "duration_s", "seq")
    faults = schedule.select(
        "router_id",
        F.col("started_at").alias("event_time"),
        F.col("seq").alias("turn"),
        fault.alias("fault"),
    ).withColumn("bucket", _bucket("event_time", bucket_s))
    records = df.filter(F.col("event_time").isNotNull()).withColumn(
        "bucket", _bucket("event_time", bucket_s)
    )

    # The last fault of each bucket, handed on to every later bucket of the router
    # that holds records: at most one row per router and bucket.
    per_bucket = (
        faults.select("router_id", "bucket", "fault", "event_time", "turn")
        .unionByName(
            records.select("router_id", "bucket").distinct(), allowMissingColumns=True
        )
        .groupBy("router_id", "bucket")
        .agg(F.max_by("fault", F.when(F.col("fault").isNotNull(), F.struct("event_time", "turn"))).alias("fault"))
    )
    earlier = (
        Window.partitionBy("router_id")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_bucket.select(
        "router_id", "bucket", F.last("fault", ignorenulls=True).over(earlier).alias("fault")
    ).filter(F.col("fault").isNotNull())

    # kind orders what happens at one instant: carried-in fault, new faults, records.
    rows = (
        records.select(
            "router_id", "bucket", "event_time", F.lit(2).alias("kind"),
            F.struct(*df.columns).alias("record"),
        )
        .unionByName(
            faults.withColumn("kind", F.lit(1)), allowMissingColumns=True
        )
        .unionByName(
            carried.select(
                "router_id", "bucket", "fault",
                F.col("fault.started_at").alias("event_time"),
                F.col("fault.seq").alias("turn"),
                F.lit(0).alias("kind"),
            ),
            allowMissingColumns=True,
        )
    )
    line = (
        Window.partitionBy("router_id", "bucket")
        .orderBy("event_time", "kind", "turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = rows.withColumn("f", F.last("fault", ignorenulls=True).over(line)).filter(
        F.col("kind") == 2
    )
    in_force = F.col("event_time") < fault_end(F.col("f.started_at"), F.col("f.duration_s"))
    return seen.withColumn("f", F.when(in_force, F.col("f"))).select(
        "record.*", "f.fault_type", "f.intensity", "f.started_at"
    )


def fault_episodes(df: DataFrame, bucket_s: int = HOUR) -> DataFrame:
    """Maximal runs of consecutive records of a router with the same fault.

    One row per run: first and last record time, number of records and the time of
    the next record without a fault (`recovered_at`, NULL if there is none yet).
    """
    key = ("router_id", "bucket")
    records = (
        df.filter(F.col("event_time").isNotNull())
        .select("router_id", "event_time", "id", "active_fault")
        .withColumn("bucket", _bucket("event_time", bucket_s))
    )

    # Runs inside each bucket.
    in_time = Window.partitionBy(*key).orderBy("event_time", "id")
    up_to_here = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = ~F.col("active_fault").eqNullSafe(F.lag("active_fault").over(in_time)) | (
        F.row_number().over(in_time) == 1
    )
    pieces = (
        records.withColumn("changed", changed)
        .withColumn("piece", F.sum(F.col("changed").cast("int")).over(up_to_here))
        .groupBy(*key, "piece")
        .agg(
            F.first("active_fault").alias("active_fault"),
            F.min("event_time").alias("started_at"),
            F.max("event_time").alias("ended_at"),
            F.count("*").alias("samples"),
        )
    )
    in_order = Window.partitionBy(*key).orderBy("piece")
    # Looking ahead runs over the reversed order: a growing frame costs the same for every row.
    ahead = Window.partitionBy(*key).orderBy(F.col("piece").desc())
    clear = F.when(F.col("active_fault").isNull(), F.col("started_at"))
    pieces = pieces.withColumns(
        {
            "is_first": F.col("piece") == 1,
            "is_last": F.lead("piece").over(in_order).isNull(),
            "next_clear": F.last(clear, ignorenulls=True).over(
                ahead.rowsBetween(Window.unboundedPreceding, -1)
            ),
            "first_clear": F.min(clear).over(Window.partitionBy(*key)),
        }
    )

    # Only the first and last run of a bucket can go on beyond it: two rows per bucket.
    whole_line = Window.partitionBy("router_id").orderBy("bucket", "piece")
    same = F.col("active_fault").eqNullSafe(F.lag("active_fault").over(whole_line))
    # First and last run of one bucket are never one run unless they are the same row.
    goes_on = F.coalesce(same & F.col("is_first"), F.lit(False)) & (
        F.row_number().over(whole_line) > 1
    )
    stitched = (
        pieces.filter(F.col("is_first") | F.col("is_last"))
        .withColumn("origin", F.when(~goes_on, F.col("started_at")))
        .withColumn(
            "origin",
            F.last("origin", ignorenulls=True).over(
                whole_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn(
            "later_clear",
            F.last(F.when(F.col("is_first"), F.col("first_clear")), ignorenulls=True).over(
                Window.partitionBy("router_id").orderBy(F.col("bucket").desc(), F.col("piece").desc())
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .groupBy(*key)
        .agg(
            F.max(F.when(F.col("is_first"), F.col("origin"))).alias("first_origin"),
            F.max(F.when(F.col("is_last"), F.col("later_clear"))).alias("later_clear"),
        )
    )
    return (
        pieces.filter(F.col("active_fault").isNotNull())
        .join(stitched, list(key))
        .withColumn(
            "started_at",
            F.when(F.col("is_first"), F.col("first_origin")).otherwise(F.col("started_at")),
        )
        .groupBy("router_id", "active_fault", "started_at")
        .agg(
            F.max("ended_at").alias("ended_at"),
            F.sum("samples").alias("samples"),
            F.max(F.coalesce("next_clear", "later_clear")).alias("recovered_at"),
        )
    )
