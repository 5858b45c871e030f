"""Search over chunks with the lines to cite: BM25 with all terms, and hybrid scores; the best chunk stands for its page.

Takes chunks and postings as `index` makes or stores them, or pages whose chunks are counted as they are cut, and queries
(item_id, query). Queries are answered in groups, in tasks that hold a group and give their first rows a query, see
`scoring`. BM25 counts chunks and index terms; the cosine counts terms of the vectors.
The first max(20 k, 50) chunks of a query are considered before pages are told apart, as the reference's limit has it.
Ties go to the smaller path and the earlier chunk; scores are compared as rounded to six places. A query without a term
finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import markdown as md
from tessera.functions.markdown import snippet
from tessera.functions.text import clamp01, index_terms, js_round, terms
from tessera.operators import scoring
from tessera.operators.chunks import chunks as chunks_of
from tessera.streaming.ledger import folder

SNIPPET = 200
#: What chunks hold of a group's terms: index terms (fts) and terms of the vectors (vec), by number.
HITS = "page_id string, path string, idx int, chunk_id string, size long, norm double, fts array<int>, fts_tf array<int>, vec array<int>, vec_tf array<int>"
Group = tuple[scoring.Asked, scoring.Asked, DataFrame]


def _first(rows: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", at).where(F.col("rank") <= k)


def _groups(queries: DataFrame) -> Iterator[tuple[scoring.Asked, scoring.Asked]]:
    """Queries by number, for index terms and for terms of the vectors."""
    of = lambda words: queries.select("item_id", F.explode(words(F.coalesce("query", F.lit("")))).alias("term"))
    fts, vec = list(scoring.groups(of(index_terms))), list(scoring.groups(of(terms)))
    none = pa.array([], pa.string())
    empty = lambda a: scoring.Asked(a.items.slice(0, 0), none, np.zeros(1, np.int64), *[np.zeros(0)] * 4, a.kind)
    for nth in range(max(len(fts), len(vec))):
        yield fts[nth] if nth < len(fts) else empty(fts[0]), vec[nth] if nth < len(vec) else empty(vec[0])


def from_postings(chunks: DataFrame, postings: DataFrame, queries: DataFrame) -> Iterator[Group]:
    """Groups of queries with the chunks' hits, of stored chunks and postings."""
    spark = chunks.sparkSession
    at = folder(spark, "hits")
    for nth, (fts, vec) in enumerate(_groups(queries)):
        known = pa.table({
            "kind": ["fts"] * len(fts.vocab) + ["vec"] * len(vec.vocab), "term": fts.vocab.to_pylist() + vec.vocab.to_pylist(), "no": pa.array([*range(len(fts.vocab)), *range(len(vec.vocab))], pa.int32()),
        })
        numbered = spark.createDataFrame(known.to_pylist(), "kind string, term string, no int")
        pair = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("no", F.col("tf").cast("int").alias("tf")))).alias(kind)
        held = postings.join(F.broadcast(numbered), ["kind", "term"]).groupBy("chunk_id").agg(pair("fts"), pair("vec"))
        rows = chunks.join(held, "chunk_id", "left").select("page_id", "path", "idx", "chunk_id", "size", "norm", "fts.no", F.col("fts.tf").alias("fts_tf"), F.col("vec.no").alias("vec"), F.col("vec.tf").alias("vec_tf"))
        rows.withColumnRenamed("no", "fts").write.parquet(f"{at}/{nth}")
        yield fts, vec, spark.read.schema(HITS).parquet(f"{at}/{nth}")


def from_pages(pages: DataFrame, queries: DataFrame) -> Iterator[Group]:
    """Groups of queries with the chunks' hits, of pages (page_id, path, content): neither texts nor postings are shuffled or stored."""
    spark = pages.sparkSession
    at = folder(spark, "hits")
    text = F.col("text")
    words = chunks_of(pages, keep=("path",)).select("page_id", "path", "idx", "chunk_id", index_terms(text).alias("fts"), terms(text).alias("vec"))
    for nth, (fts, vec) in enumerate(_groups(queries)):

        def tally(batches: Iterator[pa.RecordBatch], fts: pa.Array = fts.vocab, vec: pa.Array = vec.vocab) -> Iterator[pa.RecordBatch]:
            for b in scoring.slices(batches, scoring.ROWS):
                size, _, *found = scoring.tallied(b.column(4), fts)
                _, norm, *other = scoring.tallied(b.column(5), vec)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(size), pa.array(norm), *found, *other], ["page_id", "path", "idx", "chunk_id", "size", "norm", "fts", "fts_tf", "vec", "vec_tf"])

        words.mapInArrow(tally, HITS).write.parquet(f"{at}/{nth}")
        yield fts, vec, spark.read.schema(HITS).parquet(f"{at}/{nth}")


def _strings(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(object)


def _bm25(group: Group, k: int) -> DataFrame:
    fts, _, hits = group
    idf, mean = scoring.weights(hits, "fts", "size", fts)
    most = max(20 * k, 50)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = scoring.First(len(fts.items), most, ["path", "idx"])
        for b in scoring.slices(batches, max(1, scoring.CELLS // max(1, len(fts.items)))):
            score, _, got = scoring.summed(b.column(6), b.column(7), b.column(4).to_numpy(), fts, idf, mean)
            at, item = np.nonzero(got == fts.wanted)
            page, path, idx, chunk = _strings(b.column(0)), _strings(b.column(1)), b.column(2).to_numpy(), _strings(b.column(3))
            first.add(item, scoring.rounded(score[at, item], 6), page=page[at], path=path[at], idx=idx[at], chunk=chunk[at])
        if first.rows:
            r = first.rows
            text = lambda name: pa.array(r[name], pa.string())
            yield pa.RecordBatch.from_arrays([fts.items.take(pa.array(r["item"])), text("page"), text("chunk"), text("path"), pa.array(r["idx"]), pa.array(r["score"])], ["item_id", "page_id", "chunk_id", "path", "idx", "bm25"])

    found = hits.mapInArrow(score, f"item_id {fts.kind}, page_id string, chunk_id string, path string, idx int, bm25 double")
    return _first(found, ["item_id"], [F.desc("bm25"), "path", "idx"], most).drop("rank")


def bm25(chunks: DataFrame, postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(item_id, page_id, chunk_id, path, idx, bm25) of the first chunks that hold every term, as many as are considered for k pages."""
    return reduce(DataFrame.unionByName, [_bm25(group, k) for group in from_postings(chunks, postings, queries)])


def _cited(found: DataFrame, chunks: DataFrame, queries: DataFrame, scores: list[str]) -> DataFrame:
    """With the page's title, the lines to cite and the words around the query's first term."""
    rows = found.join(chunks.select("chunk_id", "title", "line_start", "line_end", "text"), "chunk_id").join(queries, "item_id")
    return rows.select("item_id", "page_id", "path", "title", "chunk_id", "line_start", "line_end", *scores, snippet(F.col("text"), F.col("query"), SNIPPET).alias("snippet"), "rank")


def _found(groups: Iterator[Group], k: int) -> DataFrame:
    considered = reduce(DataFrame.unionByName, [_bm25(group, k) for group in groups])
    best = _first(considered, ["item_id", "page_id"], [F.desc("bm25"), "path", "idx"], 1)
    return _first(best, ["item_id"], [F.desc("bm25"), "path", "idx"], k).withColumnRenamed("bm25", "score")


def search(chunks: DataFrame, postings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best pages of each query by their best chunk."""
    return _cited(_found(from_postings(chunks, postings, queries), k), chunks, queries, ["score"])


def _cited_pages(found: DataFrame, pages: DataFrame, queries: DataFrame, scores: list[str]) -> DataFrame:
    """Only pages that are found are cut up again for their texts."""
    at = folder(pages.sparkSession, "found")
    found.write.parquet(at)
    found = pages.sparkSession.read.schema(found.schema).parquet(at)
    some = pages.join(found.select("page_id").distinct(), "page_id", "left_semi")
    named = some.withColumn("title", md.page_title(F.col("content"), F.col("path")))
    return _cited(found, chunks_of(named, keep=("title",)), queries, scores)


def search_pages(pages: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """`search` over the chunks of pages (page_id, path, content)."""
    return _cited_pages(_found(from_pages(pages, queries), k), pages, queries, ["score"])


def _mixed(group: Group, queries: DataFrame, k: int, full: DataFrame) -> DataFrame:
    """The k best pages of each query with their best chunk; `full` (item_id, chunk_id, bm25_score) of the chunks considered, at most max(20 k, 50) a query."""
    _, vec, hits = group
    numbers = pa.table({"item_id": vec.items, "item": pa.array(np.arange(len(vec.items)))})
    known = full.toArrow().join(numbers, "item_id", join_type="inner").combine_chunks() if len(vec.items) else None
    some = known.column("chunk_id").combine_chunks() if known is not None and known.num_rows else pa.array([], pa.string())
    some = some.combine_chunks() if isinstance(some, pa.ChunkedArray) else some
    chunk_ids = some.unique()
    code = pc.index_in(some, value_set=chunk_ids).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    start = np.searchsorted(code[order], np.arange(len(chunk_ids) + 1))
    item_of, value_of = (known.column(c).to_numpy()[order] for c in ("item", "bm25_score")) if len(some) else (np.zeros(0, np.int64), np.zeros(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = scoring.First(len(vec.items), k, ["page", "idx"], "page")
        for b in scoring.slices(batches, max(1, scoring.CELLS // max(1, len(vec.items)))):
            _, dot, got = scoring.summed(b.column(8), b.column(9), None, vec, np.zeros(0), 1.0)
            relative = np.zeros(got.shape)
            which = pc.fill_null(pc.index_in(b.column(3), value_set=chunk_ids), -1).to_numpy(zero_copy_only=False)
            for row in np.flatnonzero(which >= 0):
                span = slice(start[which[row]], start[which[row] + 1])
                relative[row, item_of[span]] = value_of[span]
            at, item = np.nonzero(got)
            cosine = scoring.rounded(np.clip(dot[at, item] / (vec.qnorm[item] * b.column(5).to_numpy()[at]), 0.0, 1.0), 3)
            relative = relative[at, item]
            total = scoring.rounded(0.65 * relative + 0.35 * cosine, 3)
            keep = (total > 0) & (total >= first.least[item])
            at, item = at[keep], item[keep]
            page, path, chunk = (_strings(b.column(c)) for c in (0, 1, 3))
            first.add(item, total[keep], page=page[at], idx=b.column(2).to_numpy()[at], path=path[at], chunk=chunk[at], bm25=relative[keep], cosine=cosine[keep])
        if first.rows:
            r = first.rows
            text = lambda name: pa.array(r[name], pa.string())
            columns = [vec.items.take(pa.array(r["item"])), text("page"), text("chunk"), text("path"), pa.array(r["idx"]), pa.array(r["score"]), pa.array(r["bm25"]), pa.array(r["cosine"])]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "page_id", "chunk_id", "path", "idx", "score", "bm25_score", "vector_score"])

    found = hits.mapInArrow(score, f"item_id {vec.kind}, page_id string, chunk_id string, path string, idx int, score double, bm25_score double, vector_score double")
    best = _first(found, ["item_id", "page_id"], [F.desc("score"), "idx"], 1)
    return _first(best, ["item_id"], [F.desc("score"), "page_id"], k)


def _found_hybrid(groups: Iterator[Group], queries: DataFrame, k: int) -> DataFrame:
    """Of all groups; a query's index terms and terms of the vectors may lie in groups of other numbers."""
    groups = list(groups)
    full = reduce(DataFrame.unionByName, [_bm25(group, k) for group in groups])
    full = full.withColumn("best", F.max("bm25").over(Window.partitionBy("item_id")))
    relative = F.when(F.col("best") > 0, js_round(clamp01(F.col("bm25") / F.col("best")), 3)).otherwise(0.0)
    full = full.select("item_id", "chunk_id", relative.alias("bm25_score"))
    at = folder(queries.sparkSession, "considered")
    full.write.parquet(at)
    full = queries.sparkSession.read.schema(full.schema).parquet(at)
    return reduce(DataFrame.unionByName, [_mixed(group, queries, k, full) for group in groups])


def hybrid(chunks: DataFrame, postings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best pages of each query by .65 BM25 relative to the query's best and .35 cosine, of their best chunk."""
    return _cited(_found_hybrid(from_postings(chunks, postings, queries), queries, k), chunks, queries, ["score", "bm25_score", "vector_score"])


def hybrid_pages(pages: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """`hybrid` over the chunks of pages (page_id, path, content)."""
    return _cited_pages(_found_hybrid(from_pages(pages, queries), queries, k), pages, queries, ["score", "bm25_score", "vector_score"])
