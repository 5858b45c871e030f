"""The jobs as registered queries: each runs its job twice over the whole tables into a new folder, and reads the output back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import index_pages, ledger_confidence
from tessera.plans.oracles import JOBS
from tessera.streaming.ledger import folder, source


def job1_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "job1")
    for _ in range(2):
        index_pages.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/work")
    return index_pages.output(spark, f"{at}/index")


def job2_ledger_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "job2")
    for _ in range(2):
        ledger_confidence.run(spark, source(sf_dir), f"{at}/output", f"{at}/checkpoint", "2024-02-01 00:00:00")
    return ledger_confidence.output_table(spark, f"{at}/output")


QUERIES = {f.__name__: f for f in (job1_index_pages, job2_ledger_confidence)}
ORACLES = JOBS
