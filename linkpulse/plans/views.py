"""Telemetry, registry, schedule and log views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iso_text
from ..operators.registry import clean_registry, clean_schedule
from ..operators.series import role_of
from ..schema import FAULT_TYPES, RECORD_FIELDS

AS_OF = "2024-01-31 00:00:00"
# Moves arrival numbers of copied records before or after all originals.
FAR = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry records read off the events table, one per event."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", _k().alias("k")
    )
    k, error = F.col("k"), F.col("event_type") == "error"
    fault = F.lit(FAULT_TYPES[-1])
    for i, name in enumerate(FAULT_TYPES[:-1]):
        fault = F.when(k % 7 == i, F.lit(name)).otherwise(fault)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("event_time"),
        iso_text("ts").alias("timestamp"),
        F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("router_id"),
        F.col("value").alias("latency"),
        (k * F.lit(0.25)).alias("packet_loss"),
        (F.col("value") * F.lit(0.125)).alias("jitter"),
        k.cast("double").alias("bandwidth_usage"),
        ((k * 7 + 13) % 100).cast("double").alias("cpu_usage"),
        ((k * 3 + 29) % 100).cast("double").alias("memory_usage"),
        F.when(error, F.lit("FAULTED")).otherwise(F.lit("ACTIVE")).alias("status"),
        F.when(error, fault).alias("active_fault"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router registry, read off the customer table."""
    c = table(spark, sf_dir, "customer")
    return clean_registry(
        c.select(
            F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("router_id"),
            F.col("c_name").alias("name"),
            role_of(F.col("c_custkey")).alias("role"),
        )
    )


def raw_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fault schedule with untidy ids and some unknown names: one row per error."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.col("k")
    fault = F.lit(FAULT_TYPES[-1])
    for i, name in enumerate(FAULT_TYPES[:-1]):
        fault = F.when(k % 7 == i, F.lit(name)).otherwise(fault)
    return e.withColumn("k", _k()).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit(" r"), F.col("user_id").cast("string"), F.lit("\t")).alias("router_id"),
        F.col("ts").alias("started_at"),
        F.lit(7200.0).alias("duration_s"),
        F.when(k % 10 == 0, F.lit("Fan Failure")).otherwise(fault).alias("fault_type"),
        F.when(k % 3 == 0, F.lit("Low"))
        .when(k % 3 == 1, F.lit("Medium"))
        .otherwise(F.lit("Extreme"))
        .alias("intensity"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule with canonical ids and names."""
    return clean_schedule(raw_schedule(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of links: each router to the next number."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select(
        F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("src_router"),
        F.concat(F.lit("R"), (F.col("user_id") + 1).cast("string")).alias("dst_router"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of all records; eight in fifty are dirty, each in its own way."""
    t = telemetry(spark, sf_dir)
    m = F.col("id") % 50
    dirty = t.withColumns(
        {
            "latency": F.when(m == 2, -(F.col("latency") + 1)).otherwise(F.col("latency")),
            "packet_loss": F.when(m == 3, F.lit(105.0)).otherwise(F.col("packet_loss")),
            "router_id": F.when(m == 4, F.lit("   ")).otherwise(F.col("router_id")),
        }
    )
    json = F.to_json(F.struct(*RECORD_FIELDS), {"ignoreNullFields": "false"})
    good = F.col("good")
    line = (
        F.when(m == 0, F.substring(good, 1, 40))
        .when(m == 1, F.lit("  \t "))
        .when(m == 5, F.regexp_replace(good, '"cpu_usage":[^,]*,', ""))
        .when(m == 6, F.regexp_replace(good, '"latency":([^,]*),', '"latency":"$1",'))
        .when(m == 7, F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(good)
    )
    t = dirty.withColumn("good", json)
    return t.select(
        line.alias("value"),
        F.lit("events").alias("src_file"),
        F.struct(F.col("id").alias("block"), F.lit(0).cast("bigint").alias("row")).alias("src_pos"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records plus changed copies of some: half arrive first, half last."""
    t = telemetry(spark, sf_dir)
    originals = t.withColumn("arrival", F.col("id"))
    copies = t.filter(F.col("id") % 10 == 0).withColumns(
        {
            "latency": F.col("latency") + 1,
            "arrival": F.when(F.col("id") % 20 == 0, F.col("id") + FAR).otherwise(F.col("id") - FAR),
        }
    )
    return originals.unionByName(copies)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingestion ledger: one row for each 500 events, in their order."""
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    return (
        e.groupBy(F.floor(F.col("event_id") / 500).cast("bigint").alias("batch_id"))
        .agg(
            F.count("*").alias("lines_read"),
            F.count_if(~error).alias("inserted"),
            F.count_if(error).alias("errors"),
            F.max("ts").alias("polled_at"),
            F.max(F.when(error, F.col("props"))).alias("last_error"),
            F.max(F.when(~error, iso_text("ts"))).alias("last_imported_timestamp"),
        )
        .withColumn("ingest_id", F.concat(F.lit("q/"), F.col("batch_id").cast("string")))
    )
