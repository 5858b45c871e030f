"""An index of pages that is kept between runs: chunks and postings in buckets of pages.

A run compares the hash of every page with the one it stored last, and cuts up, counts and writes the pages that are new
or changed only. Buckets without such a page, or one that is gone, are not rewritten. In the others the rows of
unchanged pages are carried over. While buckets are rewritten their pages are stored without a hash, and the hashes
come last: a run that dies in between leaves pages that the next one takes for changed, so it carries nothing over from
a bucket that may be half written, and ends with the same tables.

Texts are shuffled twice: as rows of one page, and as chunks to their buckets. Postings are made where the chunks
of their bucket lie, for some buckets at a time. Besides the index there are at most one copy of the changed pages and one
shuffle of their texts on disk; rows that are carried over are written aside.

Cases: a page without an id is not indexed and counted as `invalid`; of rows that share an id the one with the least
hash counts; null content is empty, and a page without chunks is known all the same; other columns of the pages are not
stored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markdown as md
from tessera.functions.chunking import let
from tessera.functions.text import index_terms, terms, vector_norm
from tessera.operators.chunks import MAX_TOKENS, chunks

BUCKETS = 64
#: The setting of how many files a task may have open at once, and its value while buckets are written; a task with more buckets sorts.
#: Postings are written for as many buckets at a time.
WRITERS, OPEN = "spark.sql.maxConcurrentOutputFileWriters", 16
PAGES = "page_id string, path string, title string, content_hash string, bucket int"
CHUNKS = "page_id string, path string, title string, idx int, chunk_id string, line_start long, line_end long, text string, tokens long, size long, norm double, bucket int"
POSTINGS = "kind string, term string, page_id string, chunk_id string, tf long, bucket int"
TABLES = {"pages": PAGES, "chunks": CHUNKS, "postings": POSTINGS}


def bucket_of(page_id: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(page_id.cast("binary")), 1, 4), 16, 10).cast("int") % buckets).cast("int")


def content_hash(path: Column, content: Column) -> Column:
    """A page is another one when its text, frontmatter included, or its path differs."""
    return F.sha2(F.concat_ws("\n", path, content), 256)


def hashed(pages: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return pages.select("page_id", "path", content.alias("content"), content_hash(F.col("path"), content).alias("content_hash"))


def page_chunks(pages: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Chunks with the path and title of their page, their length in index terms and the norm of their term counts."""
    named = pages.withColumn("title", md.page_title(F.col("content"), F.col("path")))
    rows = chunks(named, max_tokens, keep=("path", "title"))
    text = F.col("text")
    return rows.select("page_id", "path", "title", "idx", "chunk_id", "line_start", "line_end", "text", "tokens", F.size(index_terms(text)).cast("long").alias("size"), vector_norm(terms(text)).alias("norm"))


def _counted(words: Column) -> Column:
    """(term, tf) of each term of a list: equal ones lie together when it is sorted, and each reaches as far as the next begins."""
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    each = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf")))
    return F.when(F.size(words) > 0, let(F.sort_array(words), lambda s: let(first(s), lambda at: each(s, at))))


def postings(chunk_rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(kind, term, page_id, chunk_id, tf): index terms as `fts`, terms of the vectors as `vec`; of `only` (kind, term), if given.

    A chunk's terms are counted where its row is, so nothing is shuffled, and its postings lie together.
    """
    text = F.col("text")
    both = F.array(F.struct(F.lit("fts").alias("kind"), _counted(index_terms(text)).alias("terms")), F.struct(F.lit("vec").alias("kind"), _counted(terms(text)).alias("terms")))
    keep = [c for c in ("bucket",) if c in chunk_rows.columns]
    rows = chunk_rows.select("page_id", "chunk_id", *keep, F.inline(both)).select("page_id", "chunk_id", *keep, "kind", F.inline("terms"))
    if only is not None:
        rows = rows.join(only.select("kind", "term").distinct(), ["kind", "term"], "left_semi")
    return rows.select("kind", "term", "page_id", "chunk_id", *keep, "tf")


def term_counts(postings: DataFrame) -> DataFrame:
    """Per chunk_id: index_terms, how many it has, vector_tokens, its tokens, and last_term, the last of both kinds.

    Tasks fold the postings that lie together before any are sorted or shuffled, so these are about as many rows as chunks.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            chunk = b.column("chunk_id").dictionary_encode()
            code = pc.fill_null(chunk.indices, -1).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            vec = pc.equal(b.column("kind"), "vec").to_numpy(zero_copy_only=False)
            tf = np.where(vec, b.column("tf").to_numpy(zero_copy_only=False), 0)
            term = b.column("term").dictionary_encode()
            order = pc.sort_indices(term.dictionary).to_numpy()
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order))
            last = order[np.maximum.reduceat(nth[term.indices.to_numpy(zero_copy_only=False)], start)]
            values = [b.column("chunk_id").take(pa.array(start)), pa.array(np.add.reduceat((~vec).astype(np.int64), start)), pa.array(np.add.reduceat(tf, start)), pa.array(np.logical_or.reduceat(vec, start)), term.dictionary.take(pa.array(last))]
            yield pa.RecordBatch.from_arrays(values, ["chunk_id", "fts", "tokens", "vec", "last"])

    rows = postings.select("chunk_id", "kind", "term", "tf").mapInArrow(folded, "chunk_id string, fts long, tokens long, vec boolean, last string")
    return rows.groupBy("chunk_id").agg(F.sum("fts").alias("index_terms"), F.sum(F.when(F.col("vec"), F.col("tokens"))).alias("vector_tokens"), F.max("last").alias("last_term"))


def asked(queries: DataFrame) -> DataFrame:
    """(kind, term) of queries' texts."""
    text = F.coalesce("query", F.lit(""))
    both = F.array(F.struct(F.lit("fts").alias("kind"), index_terms(text).alias("terms")), F.struct(F.lit("vec").alias("kind"), terms(text).alias("terms")))
    return queries.select(F.inline(both)).select("kind", F.explode("terms").alias("term")).distinct()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the index; a table not written yet is empty."""
    try:
        rows = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TABLES[name])
    return rows.where("page_id is not null")


def plan(pages: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """(page_id, content_hash, bucket, action): what becomes of each page."""
    now = pages.groupBy("page_id").agg(F.min("content_hash").alias("content_hash"))
    both = now.join(known.select("page_id", F.col("content_hash").alias("was"), F.lit(True).alias("known")), "page_id", "full_outer")
    action = (
        F.when(F.col("page_id").isNull(), "invalid").when(F.col("content_hash").isNull(), "deleted").when(F.col("known").isNull(), "inserted")
        .when(F.col("was").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated")
    )
    return both.select("page_id", "content_hash", F.when(F.col("page_id").isNotNull(), bucket_of(F.col("page_id"), buckets)).alias("bucket"), action.alias("action"))


def _dealt(rows: DataFrame) -> DataFrame:
    """A task has the rows of few buckets."""
    return rows.hint("rebalance", "bucket")


def _write(rows: DataFrame, touched: DataFrame, path: str) -> None:
    """Replaces the touched buckets by rows that lie together by bucket; each gets a row without a page, so that one that is empty now is replaced, too."""
    spark = rows.sparkSession
    empty = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "bucket"], "bucket")
    # a task has few buckets, and writes them side by side: sorted by bucket first, all of its rows would have to be held
    was = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, str(OPEN))
    try:
        rows.unionByName(empty).write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    finally:
        spark.conf.unset(WRITERS) if was is None else spark.conf.set(WRITERS, was)


def _released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffles of what was written: it does so once the driver's collector has met them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def update(pages: DataFrame, folder: str, work: str, buckets: int = BUCKETS, max_tokens: int = MAX_TOKENS) -> dict[str, int]:
    """Brings the index in `folder` up to date with all pages (page_id, path, content); how many pages had which action.

    `work` is a folder of this run alone, in the same storage.
    """
    spark = pages.sparkSession
    rows = hashed(pages)
    plan(rows, read(spark, folder, "pages"), buckets).write.mode("overwrite").parquet(f"{work}/plan")
    planned = spark.read.parquet(f"{work}/plan")
    found = {r["action"]: r["count"] for r in planned.groupBy("action").count().collect()}
    moved = planned.where("action in ('inserted', 'updated', 'deleted')")
    if moved.isEmpty():
        return found
    touched = F.broadcast(moved.select("bucket").distinct())  # at most `buckets` rows
    fresh = planned.where("action in ('inserted', 'updated')").select("page_id", "content_hash", "bucket")
    stay = planned.where("action = 'unchanged'").join(touched, "bucket").select("page_id")
    some_stay = not stay.isEmpty()
    # equal rows of one page are one; where no page is unchanged, all are taken
    taken = rows.join(fresh, ["page_id", "content_hash"], "left_semi") if "unchanged" in found else rows.where("page_id is not null")
    taken = taken.groupBy("page_id").agg(F.min(F.struct("content_hash", "path", "content")).alias("row")).select("page_id", "row.*")
    taken.withColumn("bucket", bucket_of(F.col("page_id"), buckets)).write.mode("overwrite").parquet(f"{work}/changed")
    changed = spark.read.parquet(f"{work}/changed")
    _released(spark)

    def carried(name: str) -> DataFrame:
        """What is carried over lies in the buckets that are about to go: it is written aside first."""
        rows = read(spark, folder, name).join(touched, "bucket").join(stay, "page_id", "left_semi") if some_stay else spark.createDataFrame([], TABLES[name])
        rows.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(TABLES[name]).parquet(f"{work}/{name}")

    titled = changed.select("page_id", "path", md.page_title(F.col("content"), F.col("path")).alias("title"), "content_hash", "bucket")
    old = read(spark, folder, "pages").join(touched, "bucket").join(stay, "page_id", "left_semi")
    titled.unionByName(old.select(*titled.columns)).write.mode("overwrite").parquet(f"{work}/pages")
    current = spark.read.schema(PAGES).parquet(f"{work}/pages")
    _write(_dealt(current.withColumn("content_hash", F.lit(None).cast("string"))), touched, f"{folder}/pages")
    new = page_chunks(changed.select("page_id", "path", "content"), max_tokens).withColumn("bucket", bucket_of(F.col("page_id"), buckets))
    _write(_dealt(new.unionByName(carried("chunks"))), touched, f"{folder}/chunks")
    spark.createDataFrame([], changed.schema).write.mode("overwrite").parquet(f"{work}/changed")  # cut up, and read no more
    _released(spark)
    kept = carried("postings")
    numbers = sorted(r["bucket"] for r in touched.collect())
    for at in range(0, len(numbers), OPEN):
        these = F.col("bucket").isin(numbers[at : at + OPEN])
        lying = read(spark, folder, "chunks").where(these)
        new = postings(lying.join(fresh.select("page_id"), "page_id", "left_semi") if some_stay else lying)
        _write(new.unionByName(_dealt(kept.where(these))), touched.where(these), f"{folder}/postings")
    _released(spark)
    _write(_dealt(current), touched, f"{folder}/pages")
    return found
