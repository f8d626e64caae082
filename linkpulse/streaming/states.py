"""Latest states of all routers, kept as a stored snapshot that each batch is merged into.

A snapshot holds one row per router, its newest record and its number of samples, and one row per run that says up to which
batch it goes. Merging reads the snapshot and the records of one batch, never the table. A batch that comes again, after a
failure or a restart, is known by its number and changes nothing. Snapshots are numbered folders, complete once
their success mark is there; the newest complete one counts, and the one before it stays for readers that began with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import METRICS
from ..sources.paths import folders, remove

_NEWEST = ("event_time", "id", *METRICS, "status", "active_fault")
SNAPSHOT = (
    "router_id string, event_time timestamp, id long, " + ", ".join(f"{m} double" for m in METRICS)
    + ", status string, active_fault string, total_samples long, run string, batch long"
)
#: Routers of one file of a snapshot, about.
FILE_ROUTERS = 500_000


class LatestStates:
    """The snapshots below one folder. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _complete(self) -> list[int]:
        marks = folders(self.spark, f"{self.path}/snapshot=*/_SUCCESS")
        return sorted(int(f.removesuffix("/_SUCCESS").rpartition("snapshot=")[2]) for f in marks)

    def _read(self) -> DataFrame:
        done = self._complete()
        if not done:
            return self.spark.createDataFrame([], SNAPSHOT)
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.path}/snapshot={done[-1]}")

    def applied(self, run: str) -> int:
        """The number of the last batch of a run that is in the snapshot; -1 if none is."""
        row = self._read().filter((F.col("run") == run) & F.col("router_id").isNull()).agg(F.max("batch")).first()
        return -1 if row[0] is None else row[0]

    def apply(self, records: DataFrame, run: str, batch: int) -> bool:
        """Merge the newly stored records of a batch; False if it was merged before."""
        if batch <= self.applied(run):
            return False
        old, done = self._read(), self._complete()
        number = (done[-1] if done else 0) + 1
        newest = F.max_by(F.struct(*_NEWEST), F.struct("event_time", "id")).alias("s")
        part = records.groupBy("router_id").agg(newest, F.count("*").alias("total_samples"))
        flat = part.select("router_id", "s.*", "total_samples")
        before = old.filter(F.col("router_id").isNotNull()).select("router_id", *_NEWEST, "total_samples")
        merged = before.unionByName(flat).groupBy("router_id").agg(newest, F.sum("total_samples").alias("total_samples"))
        rows = merged.select("router_id", "s.*", "total_samples", F.lit(None).cast("string").alias("run"), F.lit(None).cast("long").alias("batch"))
        others = old.filter(F.col("router_id").isNull() & (F.col("run") != run))
        mark = self.spark.createDataFrame([(run, batch)], "run string, batch long")
        out = rows.unionByName(others).unionByName(mark, allowMissingColumns=True)
        # as many files as the last snapshot's size asks for
        files = 1 + (before.count() // FILE_ROUTERS if done else 0)
        out.repartition(files, "router_id").write.mode("overwrite").parquet(f"{self.path}/snapshot={number}")
        for gone in done[:-1]:
            remove(self.spark, f"{self.path}/snapshot={gone}")
        return True

    def states(self) -> DataFrame:
        """As `router_states` gives them for the whole table, sorted by router."""
        rows = self._read().filter(F.col("router_id").isNotNull())
        columns = ["router_id", F.col("event_time").alias("last_timestamp"), *_NEWEST[2:], "total_samples"]
        return rows.select(*columns).orderBy("router_id")
