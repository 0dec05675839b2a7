"""Tables on disk: the index of chunks, with re-indexing by document, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reindexed(existing: DataFrame, new: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The index after documents were indexed again: all rows of docs' ids go, also of documents that have no chunks
    now, and the new rows come. Repeating it changes nothing."""
    return existing.join(docs.select(doc_id).distinct(), doc_id, "left_anti").unionByName(new)


class ChunkStore:
    """A folder of chunks in buckets of documents; indexing a document again rewrites its bucket only.

    A bucket is written whole from what stays and what is new, so a document that has become empty is deleted too.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def index(self, chunks: DataFrame, docs: DataFrame) -> None:
        """Replace the chunks of docs(doc_id) by chunks, which has a doc_id."""
        bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int")
        new = chunks.withColumn("bucket", bucket)
        if not self.exists():
            new.write.partitionBy("bucket").parquet(self.path)
            return
        from marlstone.session import cut

        touched = [r["bucket"] for r in docs.select(bucket.alias("bucket")).distinct().collect()]  # at most the number of buckets
        made = cut(reindexed(self.read().filter(F.col("bucket").isin(touched)), new, docs), "reindex")
        # buckets that end up empty need a row to be overwritten with nothing: they are dropped
        full = {r["bucket"] for r in made.select("bucket").distinct().collect()}
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in set(touched) - full:
            self._drop(f"{self.path}/bucket={b}")

    def _drop(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def count(self) -> int:
        return self.read().count() if self.exists() else 0

    def metadata_fields(self) -> list[str]:
        """Names of the columns beside the text, from the schema, without a scan."""
        return [c for c in self.read().columns if c not in ("id", "text", "embedding", "bucket")]


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, in place of what was there; parents are made."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as text."""
    df.select("report").coalesce(1).write.mode("overwrite").text(path)


def since(df: DataFrame, session_start: str, at: str = "timestamp") -> DataFrame:
    """A log after a reset: rows from the session's start on."""
    return df.filter(F.col(at) >= session_start)
