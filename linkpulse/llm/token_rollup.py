"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A rollup lives in a folder. A batch of changes (new documents, revised ones, deletions) is committed under an id:

1. Of several changes of one document in the batch the last counts.
2. New and revised texts are tokenized, once for each tokenizer version.
3. What the ledger holds of the touched documents is looked up and written again with the sign turned; new counts are
   written with a plus. So an insert adds, a deletion takes away, a revision does both, also from one source or
   language to another.
4. The batch's ledger rows are summed by source, language and tokenizer, and the sums written. Their success mark is the commit.

Totals are the sums over committed batches: additive, in any order. A batch that is committed is skipped when it comes again; one
that broke off has no mark, is read by nobody, and is overwritten when it comes again. Sums are formed before
the shuffle, so a hot source costs a row per task.

Defined results: a null or empty text has no tokens but counts as a document. Rows without an id are documents of their own that no
later change can touch. A deletion of an unknown id does nothing. Repeated rows of an id are one document. Null sources and
languages are groups. An empty batch commits and changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .mixing import size_of
from .tokens import byte_bpe, default_path

UPSERT, DELETE = "upsert", "delete"
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def bpe_count(path: str | None = None):
    """A function from a text column to its number of ids."""
    file = path or default_path()

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        bpe = byte_bpe(file)
        return pa.array([len(bpe.encode(t.as_py())) // 4 for t in texts], pa.int64())

    return count


def default_counters() -> dict[str, object]:
    """Tokenizer versions and what counts for each."""
    return {"byte_bpe_50k": bpe_count(), "space_words_1": size_of}


class Rollup:
    """The ledger and totals below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, counters: Mapping[str, object] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.counters = dict(counters or default_counters())

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self) -> list[str]:
        """Ids of all committed batches."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in names if self._exists(f"{self.folder}/totals/{n}/_SUCCESS"))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{part}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer, as of the committed batches."""
        sums = self._read("totals", TOTALS).groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies `changes` (doc_id, op, source, lang, text, seq) as one batch; False if it was applied before."""
        if self._exists(f"{self.folder}/totals/{batch}/_SUCCESS"):
            return False
        own = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "op", "source", "lang", F.coalesce("text", F.lit("")).alias("text"), "seq")
        counted = own.select(
            "doc_id", "op", "source", "lang", "seq", *[self._count(c).alias(f"n{i}") for i, c in enumerate(self.counters.values())]
        )
        counted = stored(counted, "counted")
        names = [c for c in counted.columns if c not in ("doc_id", "seq")]
        last = (
            counted.filter("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.max(F.struct("seq", *names)).alias("x")).select("doc_id", *[F.col(f"x.{c}") for c in names])
        )
        before = self.ledger().join(last.select("doc_id"), "doc_id").groupBy("doc_id", "source", "lang", "tokenizer").agg(
            (-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens")
        )
        now = last.unionByName(counted.filter("doc_id IS NULL").select("doc_id", *names)).filter(F.col("op") == UPSERT)
        each = F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(f"n{i}").alias("tokens")) for i, t in enumerate(self.counters)])
        after = now.select("doc_id", "source", "lang", F.explode(each).alias("t")).select(
            "doc_id", "source", "lang", "t.tokenizer", F.lit(1).cast("long").alias("docs"), "t.tokens"
        )
        signed = before.filter("docs <> 0 OR tokens <> 0").unionByName(after)
        signed.write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch}")
        written = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/{batch}")
        sums = written.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/totals/{batch}")
        return True

    @staticmethod
    def _count(counter) -> Column:
        return F.when(F.col("op") == UPSERT, counter(F.col("text"))).otherwise(F.lit(0)).cast("long")


def upserts(docs: DataFrame, seq: int = 0) -> DataFrame:
    return docs.select("doc_id", F.lit(UPSERT).alias("op"), "source", "lang", "text", F.lit(seq).cast("long").alias("seq"))


def deletions(docs: DataFrame, seq: int = 0) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id", F.lit(DELETE).alias("op"), none.alias("source"), none.alias("lang"), none.alias("text"), F.lit(seq).cast("long").alias("seq")
    )


def exact_copies(docs: DataFrame) -> DataFrame:
    """Ids of documents whose text an earlier id has too."""
    keyed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last")
    return keyed.join(first, "h").filter("doc_id <> first").select("doc_id").distinct()


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents that have a line twice, with every line once."""
    lines = F.split("text", "\n")
    cut = docs.withColumns({"text": F.array_join(F.array_distinct(lines), "\n"), "__was": F.size(lines)})
    return cut.filter(F.size(F.split("text", "\n")) < F.col("__was")).drop("__was")
