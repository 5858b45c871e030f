"""Cycles of pages that supersede each other: each page names one page at most, so a cycle is found by doubling jumps.

After k rounds a page knows where 2^k steps lead and the least id on the way there. Pages whose way ends drop out. When
2^k is at least the number of pages left, what is reached is what lies on cycles, and a cycle's least id names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import markdown as md


def edges(vault: DataFrame) -> DataFrame:
    """(page_id, to): pages and the page, if there is one, that they say they supersede."""
    named = vault.select("page_id", md.field(F.col("content"), "supersedes").alias("to")).where("to is not null")
    return named.join(vault.select(F.col("page_id").alias("to")).distinct(), "to", "left_semi").select("page_id", "to")


def cycles(links: DataFrame, folder: str) -> DataFrame:
    """(cycle, position, page_id, length): every page on a cycle once, from the cycle's least id on.

    links: (page_id, to), one row per page. A round's table is written to `folder`, as its plan would double, too.
    """
    spark = links.sparkSession
    schema = "page_id string, jump string, least string, steps long"
    first = F.least("page_id", "to")
    # the least of the pages on the way, both ends included, and how many steps away it is
    now = links.select("page_id", F.col("to").alias("jump"), first.alias("least"), F.when(first == F.col("page_id"), 0).otherwise(1).cast("long").alias("steps"))
    length, k = 1, 0
    while True:
        now.write.parquet(f"{folder}/round-{k}")
        now = spark.read.schema(schema).parquet(f"{folder}/round-{k}")
        if length >= now.count():
            break
        then = now.select(F.col("page_id").alias("jump"), F.col("jump").alias("next"), F.col("least").alias("after"), F.col("steps").alias("more"))
        nearer = F.col("after") < F.col("least")
        now = now.join(then, "jump").select(
            "page_id", F.col("next").alias("jump"), F.least("least", "after").alias("least"), F.when(nearer, F.lit(length) + F.col("more")).otherwise(F.col("steps")).alias("steps")
        )
        length, k = 2 * length, k + 1
    on = now.join(now.select(F.col("jump").alias("page_id")).distinct(), "page_id", "left_semi")
    sizes = on.groupBy("least").agg(F.count("*").alias("length"))
    position = F.pmod(F.col("length") - F.col("steps"), F.col("length"))
    return on.join(sizes, "least").select(F.col("least").alias("cycle"), position.alias("position"), "page_id", "length")
