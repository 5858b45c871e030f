"""Structured Streaming over the ledger."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import confidence
from tessera.operators.index import bucket_of
from tessera.sources.tables import ledger_lines

BUCKETS = 32
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LINES = "page_id string, seq long, ts timestamp_ntz, kind string, actor_id string, verifier_type string, severity string, source_id string, source_weight double, new_base double"
STATE = (
    "page_id string, score double, source_strength double, contradiction_penalty double, time_decay double, verification_boost double, source_count long, contradiction_count long,"
    " last_verified_at long, anchor long, superseded boolean"
)


def folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder in the storage that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source(sf_dir: str) -> str:
    """The events as a glob, as a stream reads folders and globs but not a single file."""
    return f"{sf_dir}/events.parque[t]"


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, by a stream that ends when the files are read; each micro-batch replaces the totals."""
    at = folder(spark)
    rows = spark.readStream.schema(EVENTS).parquet(source(sf_dir))
    counts = rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day").groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/totals")

    out = counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/totals")


def read_ledger(spark: SparkSession, output: str) -> DataFrame:
    """The ledger with its buckets; of lines with one page and number the one of the earliest batch counts."""
    lines = spark.read.schema(f"{LINES}, bucket int, batch long").parquet(f"{output}/ledger").where("page_id is not null")
    rest = [c for c in lines.columns if c not in ("page_id", "seq", "bucket", "batch")]
    once = lines.groupBy("bucket", "page_id", "seq").agg(F.min_by(F.struct(*rest), F.struct("batch", F.xxhash64(*rest))).alias("line"))
    return once.select("bucket", "page_id", "seq", "line.*")


def read_state(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(f"{STATE}, bucket int").parquet(f"{output}/confidence").drop("bucket")


def _replace(rows: DataFrame, by: list[str], path: str) -> None:
    rows.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def take(batch: DataFrame, number: int, output: str, now: str, buckets: int, log: logging.Logger) -> None:
    """Adds a batch of events to the ledger and folds the buckets again that it touched.

    The ledger's part of this batch is replaced, and states come from the ledger alone: a batch taken again, whole or
    after half of it was written, ends with the same tables.
    """
    spark = batch.sparkSession
    lines = ledger_lines(batch)
    placed = lines.withColumn("bucket", F.coalesce(bucket_of(F.col("page_id"), buckets), F.lit(-1))).withColumn("batch", F.lit(number).cast("long"))
    _replace(placed, ["bucket", "batch"], f"{output}/ledger")
    written = spark.read.schema(f"{LINES}, bucket int, batch long").parquet(f"{output}/ledger").where(F.col("batch") == number)
    counts = written.groupBy("bucket").count().collect()  # a row for each bucket at most
    touched = [r["bucket"] for r in counts]
    log.info("batch %d: %d events of %d buckets", number, sum(r["count"] for r in counts), len(touched))
    ledger = read_ledger(spark, output).where(F.col("bucket").isin(touched)).drop("bucket")
    state = confidence.state(ledger, F.lit(now).cast("timestamp_ntz"))
    _replace(state.withColumn("bucket", bucket_of(F.col("page_id"), buckets)), ["bucket"], f"{output}/confidence")


def follow(spark: SparkSession, events: str, output: str, checkpoint: str, now: str, buckets: int = BUCKETS, files_per_batch: int = 100, log: logging.Logger | None = None) -> int:
    """Takes the event files that the checkpoint does not know, in batches, and ends; how many batches it took."""
    taken = []

    def each(batch: DataFrame, number: int) -> None:
        take(batch, number, output, now, buckets, log or logging.getLogger(__name__))
        taken.append(number)

    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(files_per_batch)).parquet(events)
    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(taken)
