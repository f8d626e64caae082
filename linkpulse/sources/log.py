"""JSON-lines logs: scan, tail, statistics, append and reset."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_blank, round_dp
from ..operators.ingest import BAD_JSON, BLANK, parse_lines
from ..schema import RAW_SCHEMA, RECORD_FIELDS, RECORD_SCHEMA
from .jsonl_tail import BLOCK_BYTES, register_jsonl_tail
from .paths import exists, list_files


def _with_position(lines: DataFrame, row: Column) -> DataFrame:
    """Name each line's file and place: start of its block of the file, and row."""
    block = F.col("_metadata.file_block_start").alias("block")
    return lines.select(
        F.col("value"),
        F.col("_metadata.file_path").alias("src_file"),
        F.struct(block, row.alias("row")).alias("src_pos"),
    )


def number_rows(lines: DataFrame) -> DataFrame:
    """Fill in the row numbers that a stream of part files cannot give itself."""
    row = F.coalesce("src_pos.row", F.monotonically_increasing_id())
    return lines.withColumn("src_pos", F.struct(F.col("src_pos.block"), row.alias("row")))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a log: `(value, src_file, src_pos)`. Large files are split."""
    return _with_position(spark.read.text(path), F.monotonically_increasing_id())


def stream_log(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame | None:
    """New part files of a log folder as a stream; None while there is no such folder.

    For finished part files only: a file that still grows is read once and never
    again. Use `tail_log` for those.
    """
    if not exists(spark, path):
        return None
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_position(reader.text(path), F.lit(None).cast("bigint"))


def tail_log(
    spark: SparkSession,
    path: str,
    split_bytes: int | None = None,
    max_bytes_per_batch: int | None = None,
    marks: str | None = None,
) -> DataFrame | None:
    """One growing log file as a stream; None while there is no such file.

    With `marks`, a folder of its own on shared storage, a log that was replaced is noticed wherever it differs.
    """
    if not exists(spark, path):
        return None
    register_jsonl_tail(spark)
    reader = spark.readStream.format("jsonl_tail").option("path", path)
    if split_bytes:
        reader = reader.option("splitBytes", split_bytes)
    if max_bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_batch)
    if marks:
        reader = reader.option("marks", marks)
    return reader.load()


def log_tail(raw: DataFrame, n: int = 50) -> DataFrame:
    """The last `n` lines that hold JSON, in file order."""
    parsable = parse_lines(raw).filter(
        F.col("parse_reason").isNull() | ~F.col("parse_reason").isin(BAD_JSON, BLANK)
    )
    last = parsable.select("value", "src_file", "src_pos").orderBy(
        F.col("src_file").desc(), F.col("src_pos").desc()
    )
    return last.limit(n).orderBy("src_file", "src_pos")


def log_tail_file(spark: SparkSession, path: str, n: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The last `n` lines that hold JSON of a log file, or of a folder of part files, in file order.

    Reads blocks from the end, twice as many bytes each time, until they hold `n` such lines or all is read.
    """
    register_jsonl_tail(spark)
    parts, want = list_files(spark, path), block_bytes
    while True:
        ranges, left = [], want
        for file, size in reversed(parts):  # the newest part by name first
            if left > 0 and size:
                ranges.append((file, max(0, size - left), size))
                left -= size
        if not ranges:
            return spark.createDataFrame([], RAW_SCHEMA)
        lines = spark.read.format("jsonl_tail").option("ranges", json.dumps(ranges)).load()
        found = log_tail(lines, n)
        if left >= 0 or found.count() >= n:
            return found
        want *= 2


def log_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files, non-blank lines and size of a log: one row."""
    per_file = (
        spark.read.text(path)
        .select("value", "_metadata.file_path", "_metadata.file_size")
        .groupBy("file_path")
        .agg(
            F.count_if(~is_blank(F.make_valid_utf8("value"))).alias("records"),
            F.max("file_size").alias("bytes"),
        )
    )
    size = F.coalesce(F.sum("bytes"), F.lit(0))
    return per_file.agg(
        F.lit(path).alias("log_path"),
        F.count("*").alias("files"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        size.alias("size_bytes"),
        round_dp(size / 1024, 2).alias("size_kb"),
    )


def write_log(df: DataFrame, path: str) -> None:
    """Append records as JSON lines; a missing fault is written as null."""
    records = df.select(*RECORD_FIELDS)
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def reset_log(spark: SparkSession, path: str) -> None:
    """Empty a log."""
    spark.createDataFrame([], RECORD_SCHEMA).write.mode("overwrite").json(path)
