"""What Parquet footers say of the stored table: row counts and bounds of its row groups, without a row read.

The driver lists date folders only; files are listed by Spark and their footers read by tasks. On a file system that
pyarrow does not know, the same facts come from one scan of the narrow columns, with a whole file in place of a row group.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from datetime import date, datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TELEMETRY_SCHEMA
from .paths import exists

UNDATED = "__HIVE_DEFAULT_PARTITION__"
#: `low` and `high` bound the event time; NULL where a file was written without statistics.
FACTS = (
    "file string, bytes long, event_date date, row_group int, rows long, low timestamp, high timestamp, "
    "first_ingest string, last_ingest string, max_id long"
)


def date_folders(spark: SparkSession, path: str) -> list[tuple[date | None, str]]:
    """The table's date folders, newest first, records without a time last; one listing of one folder."""
    if not exists(spark, path):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in system.listStatus(root):
        name = entry.getPath().getName()
        if entry.isDirectory() and name.startswith("event_date="):
            value = name.removeprefix("event_date=")
            found.append((None if value == UNDATED else date.fromisoformat(value), entry.getPath().toString()))
    return sorted(found, key=lambda x: (x[0] is not None, x[0] or date.min), reverse=True)


def read_folders(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """The records of some date folders; nothing else is listed or opened."""
    if not folders:
        return spark.createDataFrame([], TELEMETRY_SCHEMA)
    return spark.read.option("basePath", path).schema(TELEMETRY_SCHEMA).parquet(*folders)


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def _known(path: str) -> bool:
    """Whether pyarrow can open files below `path`."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq

    def bounds(group, at: dict, name: str, kind: type):
        """Least and greatest value of a column as a file's statistics have them, if they do."""
        stats = group.column(at[name]).statistics if name in at else None
        if stats is None or not stats.has_min_max or not isinstance(stats.min, kind):
            return None, None
        return stats.min, stats.max

    def instant(t: datetime | None):
        return t if t is None or t.tzinfo else t.replace(tzinfo=timezone.utc)

    for batch in batches:
        rows = []
        for path, size, day in zip(*(batch[c].to_pylist() for c in ("path", "length", "event_date")), strict=True):
            with _open(path) as f:
                footer = pq.read_metadata(f)
            for i in range(footer.num_row_groups):
                group = footer.row_group(i)
                at = {group.column(c).path_in_schema: c for c in range(group.num_columns)}
                low, high = map(instant, bounds(group, at, "event_time", datetime))
                first, last = bounds(group, at, "ingest_id", str)
                rows.append((path, size, day, i, group.num_rows, low, high, first, last, bounds(group, at, "id", int)[1]))
        names = ("file", "bytes", "event_date", "row_group", "rows", "low", "high", "first_ingest", "last_ingest", "max_id")
        kinds = (pa.string(), pa.int64(), pa.date32(), pa.int32(), pa.int64(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The files below some folders, `(path, length, event_date)`; listed, not opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folders)
    day = F.try_to_date(F.regexp_extract("path", "event_date=([^/]+)", 1))
    return listed.select("path", "length", day.alias("event_date"))


def footers(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """One row per row group of the files in some date folders, columns as in FACTS."""
    if not folders:
        return spark.createDataFrame([], FACTS)
    if not _known(folders[0]):
        return _scanned(spark, path, folders)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # dealt by name, so that each task opens a few files however Spark has packed the listing
    return files(spark, folders).repartition("path").mapInArrow(_read, FACTS)


def _scanned(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    rows = read_folders(spark, path, folders).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    facts = rows.groupBy("file", "bytes", "event_date").agg(
        F.count("*").alias("rows"), F.min("event_time").alias("low"), F.max("event_time").alias("high"),
        F.min("ingest_id").alias("first_ingest"), F.max("ingest_id").alias("last_ingest"), F.max("id").alias("max_id"),
    )
    return facts.select("file", "bytes", "event_date", F.lit(0).alias("row_group"), "rows", "low", "high", "first_ingest", "last_ingest", "max_id")
