"""Column layouts and the fixed values that decide results."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: names, factors and limits that results must agree on. ---

METRICS = (
    "latency",
    "packet_loss",
    "jitter",
    "bandwidth_usage",
    "cpu_usage",
    "memory_usage",
)

# Metrics bounded to 0..100; the others only have a lower bound of 0.
PERCENT_METRICS = ("packet_loss", "bandwidth_usage", "cpu_usage", "memory_usage")

# Decimal places of a canonical record.
CANONICAL_DIGITS = {
    "latency": 2,
    "packet_loss": 2,
    "jitter": 2,
    "bandwidth_usage": 1,
    "cpu_usage": 1,
    "memory_usage": 1,
}

FAULT_TYPES = (
    "Latency Spike",
    "Packet Loss Spike",
    "High Jitter",
    "Bandwidth Congestion",
    "CPU Overload",
    "Memory Overload",
    "Link Failure",
)
DEFAULT_FAULT_TYPE = "CPU Overload"

INTENSITIES = ("Low", "Medium", "High")
DEFAULT_INTENSITY = "High"

# What an ingestion cycle comes to.
WAITING, UP_TO_DATE, SUCCESS, ERROR = "waiting_for_file", "up_to_date", "success", "error"

DEFAULT_STATUS = "ACTIVE"
FAULTED = "FAULTED"

ROUTER_ID_MAX_LENGTH = 64

# The fault each metric's breach is reported as.
METRIC_FAULT = {
    "latency": "Latency Spike",
    "packet_loss": "Packet Loss Spike",
    "jitter": "High Jitter",
    "bandwidth_usage": "Bandwidth Congestion",
    "cpu_usage": "CPU Overload",
    "memory_usage": "Memory Overload",
}

# A value strictly above the limit is a breach.
WARNING_LIMITS = {
    "latency": 50.0,
    "packet_loss": 1.0,
    "jitter": 10.0,
    "bandwidth_usage": 80.0,
    "cpu_usage": 85.0,
    "memory_usage": 85.0,
}
CRITICAL_LIMITS = {"latency": 100.0, "packet_loss": 5.0, "cpu_usage": 90.0}

# Candidates for the primary breach; on equal ratios the earlier one wins.
PRIMARY_EVENTS = (
    ("packet_loss", "PACKET_LOSS"),
    ("latency", "LATENCY_SPIKE"),
    ("cpu_usage", "CPU_WARNING"),
)
NO_BREACH_EVENT = "TELEMETRY_UPDATE"

# Rows returned where none are asked for.
LATEST_ROWS = 50
RECENT_ROWS = 200
ROUTER_ROWS = 50

# --- Layouts ---

RECORD_FIELDS = ("timestamp", "router_id", *METRICS, "status", "active_fault")

RECORD_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.StringType()), T.StructField("router_id", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
    + [T.StructField("status", T.StringType()), T.StructField("active_fault", T.StringType())]
)

# Where a line stood in the log; orders lines inside one file.
SRC_POS = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("row", T.LongType())]
)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("src_file", T.StringType()),
        T.StructField("src_pos", SRC_POS),
    ]
)

# The stored table; partitioned by event_date.
TELEMETRY_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())]
    + list(RECORD_SCHEMA.fields)
    + [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("imported_at", T.TimestampType()),
        T.StructField("ingest_id", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)

REJECT_SCHEMA = T.StructType(
    list(RAW_SCHEMA.fields)
    + [T.StructField("reject_reason", T.StringType()), T.StructField("ingest_id", T.StringType())]
)

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("ingest_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("lines_read", T.LongType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("polled_at", T.TimestampType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("last_imported_timestamp", T.StringType()),
    ]
)

# As stored: also the last id given out, so that a start need not look for it in the table.
STORED_LEDGER_SCHEMA = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("last_id", T.LongType())])
