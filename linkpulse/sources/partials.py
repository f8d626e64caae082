"""Statistics of the stored table from daily partial aggregates.

For each date a few rows hold counts, sums and bounds by router, status and fault. A window needs the partials of the whole days in
it and the records of the day that it begins in. A date whose partials do not hold as many records as the footers of its
files say, because records have come since, is read from the records; so results are right whether or not the partials
are up to date, and `refresh` only makes them cheaper.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.select import in_window
from .footers import date_folders, footers, read_folders
from .table import first_day


class DailyPartials:
    """Partial aggregates of the table at `table`, stored below `path` by date. One writer at a time."""

    def __init__(self, spark: SparkSession, table: str, path: str):
        self.spark, self.table, self.path = spark, table, path

    def _stored(self) -> DataFrame | None:
        """All partials; None if there are none yet."""
        return self.spark.read.parquet(self.path) if date_folders(self.spark, self.path) else None

    def stale(self) -> list[tuple[date | None, str]]:
        """Date folders whose partials are missing or older than their files."""
        folders = date_folders(self.spark, self.table)
        if not folders:
            return []
        rows = footers(self.spark, self.table, [f for _, f in folders]).groupBy("event_date").agg(F.sum("rows").alias("rows"))
        partials = self._stored()
        if partials is None:
            return folders
        known = partials.groupBy(F.to_date("event_date").alias("d")).agg(F.sum("records").alias("known"))
        differ = rows.join(known, F.col("event_date").eqNullSafe(F.col("d")), "left").filter(F.coalesce("known", F.lit(-1)) != F.col("rows"))
        days = {r.event_date for r in differ.select("event_date").collect()}
        return [(d, f) for d, f in folders if d in days]

    def refresh(self) -> int:
        """Compute the partials of stale dates anew; returns how many dates that were. Running it again changes nothing."""
        stale = self.stale()
        if stale:
            fine = stats.fine_parts(read_folders(self.spark, self.table, [f for _, f in stale]), "event_date")
            out = fine.hint("rebalance", "event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("event_date").parquet(self.path)
        return len(stale)

    def fine(self, minutes: int | None = None, as_of: datetime | str | None = None) -> DataFrame:
        """Rows of `fine_parts` that add up to a window of the table, or to all of it."""
        folders, stale = date_folders(self.spark, self.table), {d for d, _ in self.stale()}
        start = first_day(self.spark, minutes, as_of) if minutes else None
        if start:
            folders = [(d, f) for d, f in folders if d and d >= start]
        from_rows = [(d, f) for d, f in folders if d in stale or start and d == start]
        records = in_window(read_folders(self.spark, self.table, [f for _, f in from_rows]), minutes, as_of)
        fine = stats.fine_parts(records)
        partials = self._stored()
        if partials is None or len(from_rows) == len(folders):
            return fine
        days = [d for d, _ in folders if d not in {x for x, _ in from_rows}]
        day = F.to_date("event_date")
        whole = day.isin([d for d in days if d]) | (day.isNull() if None in days else F.lit(False))
        return partials.filter(whole).select(*fine.columns).unionByName(fine)

    def stats(self, minutes: int | None = None, as_of: datetime | str | None = None, list_routers: bool = True) -> DataFrame:
        """The statistics document."""
        return stats.document(stats.parts_of(self.fine(minutes, as_of)), minutes, list_routers)

    def router_stats(self, minutes: int | None = None, as_of: datetime | str | None = None) -> DataFrame:
        """Per-router statistics and one row for the network."""
        return stats.router_stats_of(self.fine(minutes, as_of))
