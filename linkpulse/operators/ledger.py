"""Running totals of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_status(ledger: DataFrame) -> DataFrame:
    """Totals and last events over all batches: one row.

    A batch that was recorded twice (replayed after a failure) counts once. Batch ids
    start again when a stream gets a new checkpoint, so time orders the batches.
    """
    once = ledger.groupBy("ingest_id").agg(
        F.max("batch_id").alias("batch_id"),
        F.max("lines_read").alias("lines_read"),
        F.max("inserted").alias("inserted"),
        F.max("errors").alias("errors"),
        F.max("polled_at").alias("polled_at"),
        F.max("last_error").alias("last_error"),
        F.max("last_imported_timestamp").alias("last_imported_timestamp"),
    )

    def last(name: str):
        order = F.struct("polled_at", "batch_id")
        return F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)

    return once.agg(
        F.count("*").alias("batches"),
        F.coalesce(F.sum("lines_read"), F.lit(0)).alias("total_lines_read"),
        F.coalesce(F.sum("inserted"), F.lit(0)).alias("total_records_inserted"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors_encountered"),
        F.max("polled_at").alias("last_poll_time"),
        last("last_error"),
        last("last_imported_timestamp"),
    )
