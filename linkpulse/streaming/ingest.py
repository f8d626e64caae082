"""Continuous ingestion: log lines -> stored table, rejects and ledger.

Every batch is written so that running it again, after a lost executor or a restart,
changes nothing: records are looked up by key before they are appended, and rejects
and the ledger row go to a folder of their own per batch, which is overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from datetime import date

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import iso_text
from ..operators.ingest import (
    accepted,
    is_rejected,
    label,
    parse_lines,
    rejected,
    strict_times,
)
from ..operators.ledger import ingest_status
from ..schema import ERROR, REJECT_SCHEMA, STORED_LEDGER_SCHEMA, SUCCESS, UP_TO_DATE, WAITING
from ..session import require_utc
from ..sources.log import number_rows
from ..sources.paths import file_size
from ..sources.table import append_new, ingested, largest_id, table_metadata
from .rollup import closed_batches, read_batches, roll_up
from .states import LatestStates


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All ledger rows, of rolled-up and of open batches; none if nothing was ingested yet."""
    return read_batches(spark, path, STORED_LEDGER_SCHEMA)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """All rejected lines stored by the stream; none if there was none yet."""
    return read_batches(spark, path, REJECT_SCHEMA)


def roll_up_closed_days(spark: SparkSession, sink: IngestSink, before: date | None = None) -> int:
    """Gather ledger and rejects of days before `before` (today); returns how many batch folders went.

    The rejects go first: the ledger says which batches are closed.
    """
    closed = closed_batches(read_ledger(spark, sink.ledger), before)
    gone = roll_up(spark, sink.rejects, REJECT_SCHEMA, closed) if sink.rejects else 0
    return gone + roll_up(spark, sink.ledger, STORED_LEDGER_SCHEMA, closed)


def with_arrival_id(lines: DataFrame, first_id: int) -> DataFrame:
    """Number lines in arrival order, from `first_id`, as column `id`.

    Positions count up inside each block of a file. A table with one row per block
    holds how many numbers all earlier blocks take; lines only add their own place.
    """
    block = ("src_file", "block")
    placed = lines.withColumn("block", F.col("src_pos.block"))
    spans = placed.groupBy(*block).agg(
        F.min("src_pos.row").alias("low"), F.max("src_pos.row").alias("high")
    )
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(F.col("high") - F.col("low") + 1).over(earlier)
    starts = spans.select(*block, "low", F.coalesce(size, F.lit(0)).alias("before"))
    return (
        placed.join(starts, list(block))
        .withColumn(
            "id", F.lit(first_id) + F.col("before") + F.col("src_pos.row") - F.col("low")
        )
        .drop("block", "low", "before")
    )


class IngestSink:
    """The work done with each batch of lines."""

    def __init__(
        self,
        table: str,
        rejects: str | None = None,
        ledger: str | None = None,
        key: str = "timestamp",
        strict: bool = False,
        states: str | None = None,
    ):
        self.states = states
        self.table, self.rejects, self.ledger = table, rejects, ledger
        self.key, self.strict = key, strict
        self.next_id: int | None = None  # read from the table when a run starts
        self.run: str | None = None  # name of a run without a stream
        self.tally = Counter()  # of the batches since a cycle began

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        run = self.run or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise ValueError("use ingest_batch for lines that are no stream")
        ingest_id = f"{run}/{batch_id}"
        if self.next_id is None:
            self.next_id = self._first_free_id(spark, ingest_id)

        labelled = label(parse_lines(number_rows(lines)))
        if self.strict:
            labelled = strict_times(labelled)
        labelled = labelled.persist()
        try:
            facts = self._facts(labelled)
            inserted = 0
            if facts["valid"]:
                valid = with_arrival_id(accepted(labelled), self.next_id).persist()
                try:
                    last_id = valid.agg(F.max("id")).first()[0]
                    inserted = append_new(valid, self.table, ingest_id, self.key)
                    if self.states:
                        own = ingested(spark, self.table, ingest_id, valid)
                        LatestStates(spark, self.states).apply(own, run, batch_id)
                    self.next_id = last_id + 1
                finally:
                    valid.unpersist()
            if self.rejects and facts["errors"]:
                out = rejected(labelled).withColumn("ingest_id", F.lit(ingest_id))
                out.write.mode("overwrite").parquet(f"{self.rejects}/run={run}/batch={batch_id}")
            if self.ledger:
                self._record(spark, run, batch_id, ingest_id, inserted, facts)
            self.tally.update(batches=1, lines_read=facts["lines_read"], records_inserted=inserted, errors=facts["errors"])
        finally:
            labelled.unpersist()

    @staticmethod
    def _facts(labelled: DataFrame) -> dict:
        place = F.struct("src_file", "src_pos")
        valid = F.col("reject_reason").isNull()
        row = labelled.agg(
            F.count("*").alias("lines_read"),
            F.count_if(valid).alias("valid"),
            F.count_if(is_rejected()).alias("errors"),
            F.max_by("reject_reason", F.when(is_rejected(), place)).alias("last_error"),
            F.max_by("timestamp", F.when(valid, place)).alias("last_imported_timestamp"),
        ).first()
        return row.asDict()

    def _first_free_id(self, spark: SparkSession, ingest_id: str) -> int:
        """One past the largest stored id, leaving out a half-done try of this batch.

        The ledger knows it; without a ledger, or with rows that do not say, the table's footers do. No record is read.
        """
        if self.ledger:
            others = read_ledger(spark, self.ledger).filter(F.col("ingest_id") != ingest_id)
            silent = F.count_if(F.col("last_id").isNull() & (F.col("inserted") > 0))
            row = others.agg(F.count("last_id").alias("known"), silent.alias("silent"), F.max("last_id").alias("last")).first()
            if row.known and not row.silent:
                return row.last + 1
        return largest_id(spark, self.table, ingest_id) + 1

    def _record(self, spark, run, batch_id, ingest_id, inserted, facts) -> None:
        values = [
            (ingest_id, batch_id, facts["lines_read"], inserted, facts["errors"], None,
             facts["last_error"], facts["last_imported_timestamp"], self.next_id - 1)
        ]
        row = spark.createDataFrame(values, STORED_LEDGER_SCHEMA)
        row.withColumn("polled_at", F.current_timestamp()).coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.ledger}/run={run}/batch={batch_id}")


def ingest_writer(lines: DataFrame, sink: IngestSink, checkpoint: str):
    """The stream writer that feeds `sink`."""
    require_utc(lines.sparkSession)
    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def start_ingest(
    lines: DataFrame, sink: IngestSink, checkpoint: str, poll: str = "1 second"
) -> StreamingQuery:
    """Ingest continuously, looking for new lines every `poll`."""
    return ingest_writer(lines, sink, checkpoint).trigger(processingTime=poll).start()


def ingest_once(
    lines: DataFrame | None, sink: IngestSink, checkpoint: str, repeat: bool = True
) -> dict:
    """One cycle: take in what is there, then report on it.

    `lines` None stands for a log that does not exist yet. A tail with bounded batches
    takes one batch per run, so it runs again until nothing is left; `repeat=False` takes one.
    A cycle that fails leaves a row with its error in the ledger.
    """
    if lines is None:
        return cycle_status(None)
    sink.tally.clear()
    last = None
    while True:
        query = ingest_writer(lines, sink, checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException as e:  # an outcome of a cycle like any other
            if sink.ledger:
                record_failure(lines.sparkSession, sink, f"{query.id}", str(e))
            return {**cycle_status(sink.tally), "status": ERROR, "error": str(e)}
        # the stream keeps its last few reports only: enough for the position, not for the totals
        steps = [p for p in query.recentProgress if p["numInputRows"] > 0]
        last = steps[-1] if steps else last
        if not (repeat and steps):
            break
    report = cycle_status(sink.tally)
    if last:
        report["new_offset"] = _position(last)
    return report


def _position(step) -> int | None:
    """The log position that a batch of a tailed file ended at; None for other sources."""
    try:
        offset = step["sources"][0]["endOffset"]
        offset = json.loads(offset) if isinstance(offset, str) else offset
        return int(offset["position"])
    except (KeyError, IndexError, TypeError, ValueError):
        return None


def cycle_status(tally: Counter | None) -> dict:
    """What a cycle came to, `waiting_for_file`, `up_to_date` or `success`, and its totals over all batches."""
    report = {"status": WAITING, "file_exists": False}
    if tally is not None:
        report = {"status": SUCCESS if tally["lines_read"] else UP_TO_DATE, "file_exists": True}
    totals = tally or Counter()
    return {**{k: totals[k] for k in ("lines_read", "records_inserted", "errors")}, **report}


def ingest_report(
    spark: SparkSession, sink: IngestSink, query: StreamingQuery | None = None, log: str | None = None
) -> DataFrame:
    """Table facts, ledger totals and, if named, facts of the log side by side: one row.

    Without any ingestion on record, the last imported time is the table's newest.
    """
    size = file_size(spark, log) if log else None
    totals = ingest_status(read_ledger(spark, sink.ledger))
    known = ("total_records", "router_count", "latest", "size_bytes")
    facts = table_metadata(spark, sink.table).select(F.struct(*known).alias("f")).scalar()
    running = F.lit(bool(query is not None and query.isActive))
    return totals.withColumn("facts", facts).withColumns(
        {
            "running": running,
            "log_location": F.lit(log).cast("string"),
            "log_exists": F.lit(size is not None),
            "log_size_bytes": F.lit(size).cast("bigint"),
            "last_imported_timestamp": F.coalesce(
                "last_imported_timestamp", iso_text(F.col("facts.latest"))
            ),
            "table_location": F.lit(sink.table),
            **{c: F.col(f"facts.{c}") for c in known},
        }
    ).drop("facts")


def record_failure(spark: SparkSession, sink: IngestSink, run: str, error: str) -> None:
    """A ledger row for a cycle that failed: one error and its text."""
    name = f"failed-{uuid.uuid4().hex}"
    values = [(f"{run}/{name}", None, 0, 0, 1, None, error, None, None)]
    row = spark.createDataFrame(values, STORED_LEDGER_SCHEMA).withColumn("polled_at", F.current_timestamp())
    row.coalesce(1).write.mode("overwrite").parquet(f"{sink.ledger}/run={run}/batch={name}")


def ingest_batch(lines: DataFrame, sink: IngestSink, run: str | None = None, batch_id: int = 0) -> str:
    """The same work for lines read in batch; returns the name of the run.

    Every call is a run of its own. Give the name of an earlier run to repeat that one after a failure.
    """
    sink.run = run or f"batch-{uuid.uuid4().hex}"
    try:
        sink(lines, batch_id)
        return sink.run
    finally:
        sink.run = None


__all__ = [
    "IngestSink",
    "cycle_status",
    "ingest_batch",
    "ingest_once",
    "ingest_report",
    "read_ledger",
    "record_failure",
    "read_rejects",
    "roll_up_closed_days",
    "start_ingest",
    "with_arrival_id",
]
