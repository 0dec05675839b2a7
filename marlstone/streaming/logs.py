"""The metrics of logs as streams: complete aggregates, windows with late rows, and a report after every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from marlstone.operators.metrics import report_of, summarised, type_histogram, usage, validation_parts
from marlstone.sources.store import write_report


def stage_usage(calls: DataFrame) -> DataFrame:
    """Sums by stage, with the total, as a stream: for output mode complete."""
    return usage(calls)


def histogram(validations: DataFrame) -> DataFrame:
    return type_histogram(validations)


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; rows later than late are left out. Times without a zone are taken as the
    session's."""
    t = events.withColumn("_at", F.col(at).cast("timestamp"))
    out = t.withWatermark("_at", late).groupBy(F.window("_at", width).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def report_each_batch(validations: DataFrame, log: str, report: str, checkpoint: str) -> StreamingQuery:
    """Append each batch and its sums to the log and write the report over all batches; a batch that is run again
    replaces itself. The report reads the batches' sums, a row and a few types each, never the log."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for name, rows in (("entries", batch), ("sums", validation_parts(batch)), ("types", type_histogram(batch))):
            rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{log}/{name}")
        types = spark.read.schema("violation_type string, n bigint").parquet(f"{log}/types").groupBy("violation_type").agg(F.sum("n").alias("n"))
        write_report(report_of(summarised(spark.read.parquet(f"{log}/sums")), types), report)

    return validations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
