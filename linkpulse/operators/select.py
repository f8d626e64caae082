"""Filters, newest-N results and per-router ranks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import at_or_after, plain_number, row_count
from ..schema import FAULTED, LATEST_ROWS, METRICS, RECENT_ROWS, ROUTER_ROWS

NEWEST_FIRST = ("event_time", "id")
DAY_MINUTES = 1440


def _newest_first() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST_FIRST]


def in_window(
    df: DataFrame, minutes: int | None = None, as_of: datetime | str | None = None
) -> DataFrame:
    """Rows of the last `minutes` before `as_of`; all rows for None or 0."""
    if not minutes:
        return df
    if minutes < 0:
        raise ValueError("minutes must not be negative")
    return df.filter(at_or_after(df, minutes, as_of))


def for_router(df: DataFrame, router_id: str) -> DataFrame:
    """Rows of one router."""
    return df.filter(F.col("router_id") == router_id.strip())


def faulted_records(df: DataFrame) -> DataFrame:
    """Rows that name a fault."""
    return df.filter(F.col("active_fault").isNotNull())


def is_fault(status: Column | str = "status", active_fault: Column | str = "active_fault") -> Column:
    """True for a faulted status or a named, non-empty fault."""
    s = F.col(status) if isinstance(status, str) else status
    f = F.col(active_fault) if isinstance(active_fault, str) else active_fault
    return F.coalesce(s == FAULTED, F.lit(False)) | F.coalesce(f != "", F.lit(False))


def top(df: DataFrame, n: int) -> DataFrame:
    """The newest `n` rows of a small input, ties by `id`: every input partition sends its own `n` to one task."""
    return df.orderBy(*_newest_first()).limit(n)


def newest(df: DataFrame, n: int) -> DataFrame:
    """The newest `n` rows, ties by `id`.

    A plain top-n sends n rows of every input partition to one task. So a histogram of the time column by minutes (one
    narrow column, reduced on the map side) first gives the minute below which no row can be among the newest n. Only
    later rows are ranked. On a stored table, `newest_stored` takes that cutoff from the footers.
    """
    kind = df.schema["event_time"].dataType
    minute = F.date_trunc("minute", "event_time").cast(kind)
    per_minute = df.filter(F.col("event_time").isNotNull()).groupBy(minute.alias("slot")).agg(F.count("*").alias("rows"))
    downwards = Window.orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    enough = per_minute.withColumn("so_far", F.sum("rows").over(downwards)).filter(F.col("so_far") >= n)
    oldest = F.lit("0001-01-01 00:00:00").cast(kind)
    cutoff = enough.agg(F.coalesce(F.max("slot"), oldest)).scalar()
    # Rows without a time sort last, so they only show where timed rows run out.
    later, untimed = F.col("event_time") >= cutoff, F.col("event_time").isNull()
    if "event_date" in df.columns:  # with stored dates, said so that other dates are not read
        later, untimed = later & (F.col("event_date") >= F.to_date(cutoff)), untimed & F.col("event_date").isNull()
    return top(df.filter(later | untimed), n)


def latest(df: DataFrame, n: int | None = None) -> DataFrame:
    """The newest records of all routers."""
    return newest(df, row_count(n, LATEST_ROWS))


def recent(
    df: DataFrame,
    minutes: int | None = None,
    router_id: str | None = None,
    n: int | None = None,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """The newest records within a rolling window and, if given, of one router."""
    rows, n = in_window(df, minutes, as_of), row_count(n, RECENT_ROWS)
    if router_id:
        return top(for_router(rows, router_id), n)
    # a day at most is ranked at once, which takes one pass
    return top(rows, n) if minutes and minutes <= DAY_MINUTES else newest(rows, n)


def router_history(df: DataFrame, router_id: str, n: int | None = None) -> DataFrame:
    """The newest records of one router."""
    return top(for_router(df, router_id), row_count(n, ROUTER_ROWS))


def live_tail(df: DataFrame, buffer: int = 100, shown: int = 20) -> DataFrame:
    """The last `shown` of the last `buffer` records, oldest first."""
    return newest(df, min(buffer, shown)).orderBy("event_time", "id")


def newest_per_router(df: DataFrame, n: int, shards: int = 64) -> DataFrame:
    """The newest `n` rows of every router, with `rank` 1 for the newest.

    Ranks twice: first among the rows of a group of map tasks, then among the
    survivors. A router holding a large share of all rows is thereby reduced by
    `shards` tasks to `n * shards` rows before one task sees it whole. The shard
    only steers the work; the result does not depend on it.
    """
    order = _newest_first()
    part = Window.partitionBy("router_id", "shard").orderBy(*order)
    whole = Window.partitionBy("router_id").orderBy(*order)
    survivors = (
        df.withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(shards)))
        .withColumn("rank", F.row_number().over(part))
        .filter(F.col("rank") <= n)
        .drop("rank", "shard")
    )
    return survivors.withColumn("rank", F.row_number().over(whole).cast("bigint")).filter(F.col("rank") <= n)


def history_per_router(df: DataFrame, n: int | None = None) -> DataFrame:
    """The newest records of every router in one job."""
    return newest_per_router(df, row_count(n, ROUTER_ROWS))


def event_lines(df: DataFrame) -> DataFrame:
    """One text line per record, as an operator's console shows it."""
    # Whole numbers are written without a decimal point.
    number = {m: plain_number(m) for m in METRICS}
    tag = F.when(
        is_fault(),
        F.concat(
            F.lit("[FAULT: "),
            F.coalesce(F.nullif("active_fault", F.lit("")), F.lit("PERTURB")),
            F.lit("]"),
        ),
    ).otherwise(F.lit("[NOMINAL]"))
    metrics = F.concat_ws(
        " | ",
        F.concat(number["latency"], F.lit("ms")),
        F.concat(number["packet_loss"], F.lit("%")),
        F.concat(number["jitter"], F.lit("ms")),
        F.concat(F.lit("BW:"), number["bandwidth_usage"], F.lit("%")),
        F.concat(F.lit("CPU:"), number["cpu_usage"], F.lit("%")),
        F.concat(F.lit("MEM:"), number["memory_usage"], F.lit("%")),
    )
    clock = F.substring("timestamp", 12, 12)
    line = F.concat(
        F.lit("["), clock, F.lit("] "), F.col("router_id"), F.lit(" "), metrics, F.lit(" "), tag
    )
    return df.select("id", "router_id", line.alias("line"))
