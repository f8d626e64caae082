"""Scratch tables in the cluster's shared folder, and small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Scratch folders made so far, by application.
_MADE: dict[str, list[str]] = {}
#: Texts that a Python worker is handed at a time, and bytes of them, about: what ends a batch first.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names; one of its own only in a local session without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="linkpulse-llm-")
    return _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch(spark: SparkSession) -> list[str]:
    """The folders that `new_folder` has named so far and `drop_scratch` has not removed."""
    return list(_MADE.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, folders: list[str]) -> None:
    """Removes scratch folders that nothing reads any more."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in made:
            made.remove(folder)


def _batch_limits(spark: SparkSession) -> dict[str, str]:
    """Settings for small batches; what the session has set lower stays."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    most = int(spark.conf.get(rows))
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))
    return {rows: str(min(BATCH_ROWS, most) if most > 0 else BATCH_ROWS), size: f"{min(BATCH_BYTES, held)}b"}


def stored(df: DataFrame, name: str, codec: str = "zstd", small_batches: bool = False) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back.

    Cuts the lineage: what follows reads the files, so a lost executor costs no recomputation of `df`. With `small_batches`,
    Python functions get BATCH_ROWS rows and about BATCH_BYTES at most, so that a worker and the buffers that feed it hold
    fewer texts at a time. A batch ends after the row that reaches the bytes: a longer text comes whole.
    """
    path = new_folder(df.sparkSession, name)
    conf, limits = df.sparkSession.conf, _batch_limits(df.sparkSession) if small_batches else {}
    before = {key: conf.get(key) for key in limits}
    for key, value in limits.items():
        conf.set(key, value)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column, null as the empty string."""
    return F.coalesce(docs[column], F.lit(""))


def without(df: DataFrame, names) -> DataFrame:
    """`df` less the columns whose names clash (in any case) with `names`."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the map by which rows are thinned out before a join, a fixed 2 MB.
MAP_BITS = 1 << 24
_PART_BITS = 8 * 4096  # of one `bitmap_construct_agg`


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """`rows` less most of those whose `key` is not in `keys`; the join that follows decides.

    A map of hashed keys, of a fixed size whatever their number, is broadcast, so that rows that
    cannot join are not shuffled. With very many keys it fills up and lets all rows pass.
    """
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(MAP_BITS))
    parts = keys.select(place(key).alias("p")).groupBy(F.floor(F.col("p") / _PART_BITS).alias("__part")).agg(
        F.bitmap_construct_agg(F.col("p") % _PART_BITS).alias("__map")
    )
    at = rows.withColumn("__part", F.floor(place(key) / _PART_BITS)).withColumn("__at", place(key) % _PART_BITS)
    byte = "cast(conv(hex(substring(__map, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)"
    near = at.join(F.broadcast(parts), "__part").filter(f"(shiftright({byte}, cast(__at % 8 as int)) & 1) = 1")
    return near.drop("__part", "__at", "__map")
