"""Queries on a stored copy of the telemetry view: the table, its partials and snapshot, and its log, as ingestion leaves them.

The copy is written once for each session and table folder, below `spark.checkpoint.dir`; a local session without that setting
gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import log_tail_file
from ..sources.partials import DailyPartials
from ..sources.table import append_new, newest_stored, read_telemetry, table_metadata
from ..streaming.states import LatestStates
from . import views
from .views import AS_OF

_COPIES: dict[tuple[str, str], str] = {}


def _scratch(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/stored-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="linkpulse-stored-")


def _once(spark: SparkSession, d: str, name: str, make) -> str:
    """The folder `name` of the copy; `make(folder)` fills it the first time."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _COPIES:
        _COPIES[key] = _scratch(spark)
    folder = f"{_COPIES[key]}/{name}"
    if (*key, name) not in _COPIES:
        make(folder)
        _COPIES[(*key, name)] = folder
    return folder


def _table(spark: SparkSession, d: str) -> str:
    def fill(folder: str) -> None:
        rows = views.telemetry(spark, d)
        append_new(rows.withColumn("event_time", F.col("event_time").cast("timestamp")), folder, "events")

    return _once(spark, d, "table", fill)


def _as_view(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Stored records in the columns and types of the view."""
    at = F.col("event_time").cast("timestamp_ntz")
    return rows.withColumn("event_time", at).select(*views.telemetry(spark, d).columns)


def telemetry_scan(spark: SparkSession, d: str) -> DataFrame:
    return _as_view(spark, d, read_telemetry(spark, _table(spark, d)))


def stored_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return _as_view(spark, d, newest_stored(spark, _table(spark, d), 50))


def stored_recent_window(spark: SparkSession, d: str) -> DataFrame:
    return _as_view(spark, d, newest_stored(spark, _table(spark, d), 2000, minutes=1440, as_of=AS_OF))


def stored_router_history(spark: SparkSession, d: str) -> DataFrame:
    return _as_view(spark, d, newest_stored(spark, _table(spark, d), 50, router_id="R7"))


def _partials(spark: SparkSession, d: str) -> DailyPartials:
    table = _table(spark, d)
    return DailyPartials(spark, table, _once(spark, d, "partials", lambda folder: DailyPartials(spark, table, folder).refresh()))


def stored_stats_week(spark: SparkSession, d: str) -> DataFrame:
    from .queries import _flat

    document = _partials(spark, d).stats(7 * 1440, AS_OF)
    return _flat(document.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("earliest", "latest")}))


def stored_router_stats(spark: SparkSession, d: str) -> DataFrame:
    return _partials(spark, d).router_stats()


def stored_router_states(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d)
    states = _once(spark, d, "states", lambda folder: LatestStates(spark, folder).apply(read_telemetry(spark, table), "events", 0))
    return LatestStates(spark, states).states().withColumn("last_timestamp", F.col("last_timestamp").cast("timestamp_ntz"))


def stored_metadata(spark: SparkSession, d: str) -> DataFrame:
    facts = table_metadata(spark, _table(spark, d))
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("earliest", "latest")]
    return facts.select("total_records", "router_count", *times, (F.col("size_bytes") > 0).alias("has_files"))


def log_tail_times(spark: SparkSession, d: str) -> DataFrame:
    """Time text of the last 50 lines of the log that hold JSON, read from its end."""
    lines = views.raw_lines(spark, d)
    log = _once(spark, d, "log", lambda folder: lines.orderBy("src_pos").select("value").write.text(folder))
    tail = log_tail_file(spark, log, 50)
    return tail.select(F.regexp_extract("value", '"timestamp":"([^"]*)"', 1).alias("timestamp"))


STORED = (
    telemetry_scan, stored_latest_n, stored_recent_window, stored_router_history, stored_stats_week, stored_router_stats,
    stored_router_states, stored_metadata, log_tail_times,
)
