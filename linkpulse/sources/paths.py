"""File-system questions, asked through the file systems Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def exists(spark: SparkSession, pattern: str) -> bool:
    """True if any path matches (`pattern` may hold globs)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(path)
    return found is not None and len(found) > 0


def file_size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file, or of all files below a folder; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and bytes of a file, or of the visible files in a folder, by name; none if there is no such path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [(s.getPath(), s.getLen()) for s in fs.listStatus(p) if not s.isDirectory()]
    plain = lambda x: x.toUri().getPath() if x.toUri().getScheme() in (None, "file") else x.toString()
    return sorted((plain(x), size) for x, size in found if not x.getName().startswith(("_", ".")))


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with globs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found or [])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
