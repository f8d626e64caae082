"""The stored telemetry table: Parquet, partitioned by `event_date`.

Inside a date, files are sorted by time and carry a Bloom filter of the routers, so row groups without a router, or
outside a span of time, are not read. Footers answer what needs no rows (`footers.py`).
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import at_or_after, round_dp, row_count
from ..operators.ingest import insert_or_ignore
from ..operators.select import for_router, top
from ..operators.stats import summary
from ..schema import LATEST_ROWS, RECENT_ROWS, ROUTER_ROWS, TELEMETRY_SCHEMA
from ..session import exact_timestamps, require_utc
from .footers import date_folders, files, footers, read_folders
from .paths import exists

HOUR_MICROS = 3_600_000_000
#: Spans of time that a batch's keys are looked up in, at most; with more gaps the smallest are closed.
MOST_SPANS = 64
#: Routers that the Bloom filter of a row group is sized for.
BLOOM_ROUTERS = 100_000
WRITE_OPTIONS = {
    "parquet.bloom.filter.enabled#router_id": "true",
    "parquet.bloom.filter.expected.ndv#router_id": str(BLOOM_ROUTERS),
}


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; empty if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], TELEMETRY_SCHEMA)
    return spark.read.schema(TELEMETRY_SCHEMA).parquet(path)


def time_spans(batch: DataFrame, most: int = MOST_SPANS) -> tuple[list[tuple[int, int]], bool]:
    """Disjoint spans (first, last), in microseconds, that hold every time of the batch; whether records without a time are in it.

    Taken from the hours that the batch touches, one row each. The `most - 1` widest gaps between them part the spans, so
    a record a month late adds a span of its own, and not the month.
    """
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    timed = batch.filter(F.col("event_time").isNotNull()).select(micros.alias("t"))
    hours = timed.groupBy(F.floor(F.col("t") / HOUR_MICROS).alias("hour")).agg(F.min("t").alias("low"), F.max("t").alias("high"))
    before = F.lag("high").over(Window.orderBy("hour"))
    gaps = hours.withColumn("before", before).filter(F.col("low") - F.col("before") > HOUR_MICROS)
    ends = batch.agg(F.min(micros), F.max(micros), F.count_if(F.col("event_time").isNull())).first()
    if ends[0] is None:
        return [], bool(ends[2])
    widest = gaps.orderBy((F.col("before") - F.col("low")), "low").limit(most - 1).select("before", "low").collect()
    cuts = sorted((r.before, r.low) for r in widest)
    starts, stops = [ends[0], *(low for _, low in cuts)], [*(high for high, _ in cuts), ends[1]]
    return list(zip(starts, stops, strict=True)), bool(ends[2])


def _day(micros: int) -> date:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)).date()


class _Touched:
    """The part of a table that can hold keys of a batch: its date folders and, inside them, spans of time."""

    def __init__(self, batch: DataFrame, path: str):
        self.spark, self.path = batch.sparkSession, path
        self.spans, self.untimed = time_spans(batch)

    def folders(self) -> list[str]:
        days = [(_day(low), _day(high)) for low, high in self.spans]
        inside = lambda d: self.untimed if d is None else any(a <= d <= b for a, b in days)
        return [folder for d, folder in date_folders(self.spark, self.path) if inside(d)]

    def records(self) -> DataFrame:
        at = lambda micros: F.timestamp_micros(F.lit(micros))
        inside = F.col("event_time").isNull() if self.untimed else F.lit(False)
        for low, high in self.spans:
            inside = inside | F.col("event_time").between(at(low), at(high))
        return read_folders(self.spark, self.path, self.folders()).filter(inside)


def _dedup_key(key: str) -> Column:
    if key == "timestamp":
        return F.col("timestamp")
    if key == "event_time":
        # The instant, whatever its spelling; the text where it is no time.
        return F.coalesce(F.col("event_time").cast("string"), F.col("timestamp"))
    raise ValueError("key must be timestamp or event_time")


def append_new(
    batch: DataFrame, path: str, ingest_id: str | None = None, key: str = "timestamp"
) -> int:
    """Append the records of `batch` not stored yet; returns how many those were.

    A record is known by its router and its time text (or its instant, with
    `key="event_time"`); of several in one batch the first arrival is kept. A record
    of any age is accepted. Appending the same batch again adds nothing, so a job
    that failed half way can simply be run again; under the same `ingest_id` it then
    counts what both tries stored.

    `batch` needs the record columns, `event_time` and `id` (arrival order).
    One writer per table at a time.
    """
    require_utc(batch.sparkSession)
    ingest_id = ingest_id or str(uuid.uuid4())
    dated = batch.withColumns(
        {"event_date": F.to_date("event_time"), "dedup_key": _dedup_key(key)}
    )
    touched = _Touched(dated, path)
    stored = touched.records().withColumn("dedup_key", _dedup_key(key))
    fresh = insert_or_ignore(dated, stored, ("router_id", "dedup_key"), ("id",))
    rows = fresh.withColumns(
        {"imported_at": F.current_timestamp(), "ingest_id": F.lit(ingest_id)}
    ).select(*TELEMETRY_SCHEMA.names)
    with exact_timestamps(batch.sparkSession):
        (
            # Adaptive execution splits a crowded date over several files.
            rows.hint("rebalance", "event_date")
            .sortWithinPartitions("event_date", "event_time", "router_id")
            .write.mode("append")
            .options(**WRITE_OPTIONS)
            .partitionBy("event_date")
            .parquet(path)
        )
    # Counted in the footers: counters kept while writing can count a repeated task twice.
    return written(batch.sparkSession, path, ingest_id, touched.folders())


def written(spark: SparkSession, path: str, ingest_id: str, folders: list[str] | None = None) -> int:
    """How many stored records have this `ingest_id`, from the footers of the given date folders, or of all.

    Row groups that hold other records too, or say nothing, are read; an append writes none such.
    """
    folders = [f for _, f in date_folders(spark, path)] if folders is None else folders
    groups = footers(spark, path, folders)
    own = (F.col("first_ingest") == ingest_id) & (F.col("last_ingest") == ingest_id)
    unclear = F.col("first_ingest").isNull() | (F.col("first_ingest") <= ingest_id) & (F.col("last_ingest") >= ingest_id) & ~own
    row = groups.agg(F.sum(F.when(own, F.col("rows"))), F.count_if(unclear)).first()
    mixed = 0
    if row[1]:
        within = groups.filter(unclear).select("file").distinct()
        rows = read_folders(spark, path, folders).filter(F.col("ingest_id") == ingest_id).select(F.col("_metadata.file_path").alias("at"))
        place = lambda c: F.regexp_replace(F.col(c), "^file:/+", "file:/")
        clear = groups.filter(own).select(place("file").alias("at")).distinct()
        mixed = rows.select(place("at").alias("at")).join(within.select(place("file").alias("at")), "at", "left_semi").join(clear, "at", "left_anti").count()
    return (row[0] or 0) + mixed


def ingested(spark: SparkSession, path: str, ingest_id: str, batch: DataFrame) -> DataFrame:
    """The stored records of one ingestion; `batch` holds their times. Other ingestions' files are skipped by their statistics."""
    return read_folders(spark, path, _Touched(batch, path).folders()).filter(F.col("ingest_id") == ingest_id)


def largest_id(spark: SparkSession, path: str, but: str) -> int:
    """The largest stored id, from the footers; row groups of the ingestion `but` do not count."""
    groups = footers(spark, path, [f for _, f in date_folders(spark, path)])
    others = F.coalesce((F.col("first_ingest") != but) | (F.col("last_ingest") != but), F.lit(True))
    return groups.filter(others).agg(F.max("max_id")).first()[0] or 0


def newest_stored(
    spark: SparkSession,
    path: str,
    n: int | None = None,
    minutes: int | None = None,
    router_id: str | None = None,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """The newest records of the stored table, of a rolling window and of one router if given.

    Dates are taken newest first, in blocks that double, until they hold enough rows. For all routers the row counts and
    time bounds in the footers say so, and give the time below which no row can be among the newest; no row is touched before the
    last read. For one router its rows are counted, which reads only row groups whose Bloom filter may hold it.
    """
    n = row_count(n, ROUTER_ROWS if router_id else RECENT_ROWS if minutes else LATEST_ROWS)
    folders = date_folders(spark, path)
    dated, undated = [f for f in folders if f[0]], [f for d, f in folders if not d]

    def chosen(df: DataFrame) -> DataFrame:
        df = df.filter(at_or_after(df, minutes, as_of)) if minutes else df
        return for_router(df, router_id) if router_id else df

    if minutes:
        if minutes < 0:
            raise ValueError("minutes must not be negative")
        start = first_day(spark, minutes, as_of)
        dated, undated = [f for f in dated if f[0] >= start], []
    taken, found, size = [], 0, 1
    while dated and found < n:
        block, dated = [f for _, f in dated[:size]], dated[size:]
        size *= 2
        taken += block
        if router_id:
            found += chosen(read_folders(spark, path, block)).limit(n - found).count()
        else:
            groups = footers(spark, path, block)
            whole = groups.filter(_low() >= _start(minutes, as_of)) if minutes else groups
            found += whole.agg(F.sum("rows")).first()[0] or 0
    rows = chosen(read_folders(spark, path, taken if found >= n else taken + undated))
    if not router_id and found >= n:
        groups = footers(spark, path, taken)
        so_far = F.sum("rows").over(Window.orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, 0))
        later = groups.select(_low().alias("low"), "rows").withColumn("so_far", so_far).filter(F.col("so_far") >= n)
        cutoff = later.agg(F.unix_micros(F.max("low"))).first()[0]
        rows = rows.filter(F.col("event_time") >= F.timestamp_micros(F.lit(cutoff)))
    return top(rows, n)


def first_day(spark: SparkSession, minutes: int, as_of: datetime | str | None) -> date:
    """The date that a window begins in."""
    return spark.range(1).select(F.to_date(_start(minutes, as_of)).alias("d")).first().d


def _low() -> Column:
    """The time that no record of a row group is below."""
    return F.coalesce("low", F.col("event_date").cast("timestamp"))


def _start(minutes: int, as_of: datetime | str | None) -> Column:
    end = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    return end - F.make_dt_interval(mins=F.lit(minutes))


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Store rejected lines with their reason."""
    rejects.write.mode("append").parquet(path)


def table_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows, routers, time span, files and bytes of the stored table: one row. Files are listed, not opened, for their sizes."""
    folders = [f for _, f in date_folders(spark, path)]
    zero = F.lit(0).cast("bigint")
    if folders:
        sizes = F.struct(F.count("*").alias("files"), F.coalesce(F.sum("length"), zero).alias("bytes"))
        listed = files(spark, folders).agg(sizes.alias("f")).scalar()
    else:
        listed = F.struct(zero.alias("files"), zero.alias("bytes"))
    counted = summary(read_telemetry(spark, path)).withColumn("listed", listed)
    return counted.select(
        "total_records", "router_count", "earliest", "latest", F.lit(path).alias("location"), F.col("listed.files").alias("files"),
        F.col("listed.bytes").alias("size_bytes"), round_dp(F.col("listed.bytes") / 1024, 2).alias("size_kb"),
    )
