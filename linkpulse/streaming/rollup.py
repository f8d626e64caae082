"""Rolled-up batches: the ledger and the rejects of closed days in a few folders instead of one for each batch.

A stream writes each batch to `run=.../batch=...`. `roll_up` gathers the batches of closed days in a generation,
`rolled/gen=<first>-<last>`, and only then removes their folders. A generation counts once its success mark is there, so
an interrupted roll-up changes nothing: without the mark it is ignored and written anew, with it the batches that are in it
count once, whether their folders are still there or not. From MERGE generations on, all are merged into one that names the
range it replaces; a reader leaves out generations that lie within another's range.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.paths import folders, remove

#: Generations side by side, at most; and rows of one file of a generation, about.
MERGE, FILE_ROWS = 8, 1_000_000


def generations(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """The generations that count, `(first, last, folder)`, in order."""
    marked = [f.removesuffix("/_SUCCESS") for f in folders(spark, f"{path}/rolled/gen=*/_SUCCESS")]
    found = sorted((*map(int, f.rpartition("gen=")[2].split("-")), f) for f in marked)
    inside = lambda x, y: x is not y and y[0] <= x[0] and x[1] <= y[1]
    return [x for x in found if not any(inside(x, y) for y in found)]


def open_batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of batches that are not rolled up, or not removed yet."""
    return folders(spark, f"{path}/run=*/batch=*")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows, of rolled-up and of open batches; none if there is nothing yet."""
    empty = spark.createDataFrame([], schema)
    rolled = _rolled(spark, path, schema)
    opened = open_batches(spark, path)
    # one glob, not one path for each of many batches
    rest = spark.read.schema(schema).parquet(f"{path}/run=*/batch=*") if opened else empty
    if rolled is None:
        return rest
    return rolled.unionByName(rest.join(rolled.select("ingest_id").distinct(), "ingest_id", "left_anti").select(*schema.names) if opened else empty)


def _rolled(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    live = [f for _, _, f in generations(spark, path)]
    return spark.read.schema(schema).parquet(*live) if live else None


def roll_up(spark: SparkSession, path: str, schema: T.StructType, closed: DataFrame) -> int:
    """Gather the open batches whose `ingest_id` is in `closed`; returns how many folders went."""
    made = [f.rpartition("gen=")[2] for f in folders(spark, f"{path}/rolled/gen=*")]
    live = generations(spark, path)
    counting = {f"{a}-{b}" for a, b, _ in live}
    for name in made:  # left by an interrupted roll-up, or replaced by a merged one
        if name not in counting:
            remove(spark, f"{path}/rolled/gen={name}")
    opened = open_batches(spark, path)
    if not opened:
        return 0
    rows = spark.read.schema(schema).parquet(f"{path}/run=*/batch=*").join(closed.select("ingest_id").distinct(), "ingest_id", "left_semi")
    rolled = _rolled(spark, path, schema)
    new = rows.select(*schema.names) if rolled is None else rows.join(rolled.select("ingest_id").distinct(), "ingest_id", "left_anti").select(*schema.names)
    n = new.count()
    if n:
        last = max((b for _, b, _ in live), default=0) + 1
        first = last
        if len(live) + 1 >= MERGE:
            new, n, first = rolled.unionByName(new), n + rolled.count(), min(a for a, _, _ in live)
        new.repartition(-(-n // FILE_ROWS), "ingest_id").write.mode("overwrite").parquet(f"{path}/rolled/gen={first}-{last}")
    # what counts as rolled up now, from the stored generations, before its folders go
    done = {r.ingest_id for r in _done(spark, path, schema, rows)}
    gone = [f for f in opened if _ingest_id(f) in done]
    for folder in gone:
        remove(spark, folder)
    return len(gone)


def _done(spark: SparkSession, path: str, schema: T.StructType, rows: DataFrame) -> list:
    """Ids of open batches that a generation holds: as many as there are folders to remove."""
    rolled = _rolled(spark, path, schema)
    if rolled is None:
        return []
    return rows.select("ingest_id").distinct().join(rolled.select("ingest_id").distinct(), "ingest_id", "left_semi").collect()


def _ingest_id(folder: str) -> str:
    run, batch = folder.rstrip("/").split("/")[-2:]
    return f"{run.removeprefix('run=')}/{batch.removeprefix('batch=')}"


def closed_batches(ledger: DataFrame, before: date | None = None) -> DataFrame:
    """Ids of batches whose day has ended: recorded before `before`, by default today (UTC)."""
    before = before or datetime.now(timezone.utc).date()
    return ledger.filter(F.to_date("polled_at") < F.lit(before)).select("ingest_id").distinct()
