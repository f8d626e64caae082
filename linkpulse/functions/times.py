"""Time expressions. They work on TIMESTAMP and on TIMESTAMP_NTZ columns alike."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c: Column | str) -> Column:
    """ISO text to a timestamp; NULL where the text is no time."""
    return F.try_to_timestamp(_col(c))


def iso_text(c: Column | str) -> Column:
    """Millisecond UTC text with a trailing Z."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def time_literal(df: DataFrame, name: str, value: datetime | str | None) -> Column:
    """`value` (default: now) as a literal of the same type as column `name`."""
    kind = df.schema[name].dataType.simpleString()
    moment = F.current_timestamp() if value is None else F.lit(str(value))
    return moment.cast(kind)


def at_or_after(
    df: DataFrame, minutes: int, as_of: datetime | str | None, name: str = "event_time"
) -> Column:
    """True for rows no older than `minutes` before `as_of`."""
    start = time_literal(df, name, as_of) - F.make_dt_interval(mins=F.lit(minutes))
    later = F.col(name) >= start
    # The stored table is partitioned by date: say so, and other dates are not read.
    if name == "event_time" and "event_date" in df.columns:
        return later & (F.col("event_date") >= F.to_date(start))
    return later
