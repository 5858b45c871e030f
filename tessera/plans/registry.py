"""Every query of the engine by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import estimated_tokens, js_round
from tessera.functions import markdown as md
from tessera.operators import chunk_search as chunk_queries
from tessera.operators import chunks, code_graph, compiling, confidence, converting, graph, index, lineage, patching, retrieval, supersession, vault
from tessera.sources import raw, tables
from tessera.streaming import ledger as stream

from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES

#: The time that reports are made for, and a later one for lint.
NOW, LATER = "2024-02-01 00:00:00", "2024-07-15 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _register(f):
    QUERIES[f.__name__] = f
    return f


@_register
def bm25_search(spark, d):
    return retrieval.search(tables.pages(spark, d), tables.queries(spark, d))


@_register
def hybrid_search(spark, d):
    return retrieval.hybrid(tables.pages(spark, d), tables.queries(spark, d))


@_register
def hybrid_any_term(spark, d):
    """hybrid_search with the pages that hold only some of the terms."""
    found = retrieval.hybrid_first(tables.pages(spark, d), tables.queries(spark, d))
    return found.select("item_id", "doc_id", "bm25", "cosine", "score", "rank")


@_register
def ranked_search(spark, d):
    """Hybrid scores with the confidence of the page's ledger: .55, .25, .10, .10; unknown pages have .7, .5 and .5.

    As many candidates as the reference takes for ten results: max(10 * 10, 50).
    """
    return _ranked(spark, d, retrieval.hybrid(tables.pages(spark, d), tables.queries(spark, d), 100).drop("rank"))


def _standing(spark, d):
    """What the ledger says of its pages."""
    led = tables.ledger(spark, d)
    known = confidence.state(led, _now()).select("page_id", F.col("score").alias("confidence"), "superseded", "last_verified_at").join(confidence.freshness(led, _now()), "page_id")
    return known.join(confidence.latest_major(led), "page_id", "left")


def _flags():
    return F.array_join(confidence.rank_flags(_now()), ",").alias("flags")


def _ranked(spark, d, found):
    """With flags; superseded pages go."""
    rows = found.withColumn("page_id", tables.page_id(F.col("doc_id"))).join(_standing(spark, d), "page_id", "left").where(~F.coalesce("superseded", F.lit(False)))
    final = 0.55 * F.col("score") + 0.25 * F.coalesce("confidence", F.lit(0.7)) + 0.10 * F.coalesce("freshness", F.lit(0.5)) + 0.10 * F.coalesce("access_recency", F.lit(0.5))
    rows = rows.select("item_id", "doc_id", js_round(final, 4).alias("final_score"), _flags())
    return retrieval.top(rows, 10, "final_score")


@_register
def ranked_whole_text(spark, d):
    """ranked_search with every term of the benchmark text and every page that hybrid scores, not its best 30 alone."""
    at = stream.folder(spark, "standing")
    _standing(spark, d).write.parquet(at)
    known, key = spark.read.parquet(at), tables.page_id(F.col("doc_id"))
    found = retrieval.ranked_first(tables.pages(spark, d), tables.query_texts(spark, d), known, key)
    return found.withColumn("page_id", key).join(known, "page_id", "left").select("item_id", "doc_id", "final_score", _flags(), "rank")


@_register
def retrieval_eval(spark, d):
    """Precision and recall at 10 against the documents that hold the first six distinct terms of the benchmark text."""
    p = tables.pages(spark, d)
    relevant = retrieval.bm25_all(p, tables.queries(spark, d, 6)).select("item_id", "doc_id")
    return retrieval.evaluate(retrieval.search(p, tables.queries(spark, d)), relevant, 10)


@_register
def bm25_whole_text(spark, d):
    """bm25_search with every term of the benchmark text."""
    found = retrieval.bm25_all(tables.pages(spark, d), tables.query_texts(spark, d), 10)
    return retrieval.top(found, 10).select("item_id", "doc_id", "score", "rank")


@_register
def hybrid_whole_text(spark, d):
    """hybrid_any_term with every term of the benchmark text."""
    found = retrieval.hybrid_first(tables.pages(spark, d), tables.query_texts(spark, d))
    return found.select("item_id", "doc_id", "bm25", "cosine", "score", "rank")


@_register
def retrieval_eval_whole_text(spark, d):
    """Precision and recall at 10 of the two-term queries against the documents that hold every term of the benchmark text."""
    p = tables.pages(spark, d)
    relevant = retrieval.bm25_all(p, tables.query_texts(spark, d)).select("item_id", "doc_id")
    return retrieval.evaluate(retrieval.search(p, tables.queries(spark, d)), relevant, 10)


@_register
def term_norms(spark, d):
    return retrieval.norms(tables.pages(spark, d))


@_register
def content_hash(spark, d):
    return tables.pages(spark, d).select("page_id", F.sha2("body", 256).alias("content_hash"), estimated_tokens(F.col("body")).cast("long").alias("tokens"))


@_register
def duplicate_pages(spark, d):
    return graph.duplicates(tables.pages(spark, d))


@_register
def source_rollup(spark, d):
    return graph.by_source(tables.pages(spark, d), tables.table(spark, d, "labels"))


@_register
def confidence_state(spark, d):
    return confidence.state(tables.ledger(spark, d), _now()).drop("superseded")


@_register
def decay_checkpoints(spark, d):
    """The lines that a decay run adds."""
    return confidence.decay_checkpoints(tables.ledger(spark, d), NOW)


@_register
def freshest_confidence(spark, d):
    """States stored on January 15, folded again where the ledger has later events."""
    led = tables.ledger(spark, d)
    old = led.where("ts < '2024-01-15'")
    then = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    stored = confidence.state(old, then).join(old.groupBy("page_id").agg(F.max("ts").alias("last_event_at")), "page_id")
    return confidence.freshest(led.where("seq % 3 <> 0"), stored, _now())


@_register
def united_confidence(spark, d):
    """States of a ledger and a projection of it that overlap."""
    led = tables.ledger(spark, d)
    return confidence.state(confidence.united(led.where("seq % 3 = 0"), led.where("seq % 2 = 0")), _now())


@_register
def confidence_status(spark, d):
    found = vault.flags(confidence.state(tables.ledger(spark, d), _now()), _now())
    return found.select("page_id", "score", F.array_join("flags", ",").alias("flags"), vault.risk(F.col("flags")).alias("risk_level"))


@_register
def ingest_sources(spark, d):
    path = F.col("path")
    return tables.files(spark, d).select("doc_id", "path", md.kind(path).alias("kind"), md.language(path).alias("language"), md.target_path(path).alias("target"))


@_register
def ingest_conversion(spark, d):
    """Files of all kinds as markdown pages, and why those that are none are not."""
    files = raw.discover(tables.raw_files(tables.table(spark, d, "documents")), hidden=True)
    found = converting.converted(files.where("skipped is null"))
    lists = [F.array_join(c, ",").alias(c) for c in ("includes", "imports", "functions")]
    return found.select("path", "target", "error", "title", "source_type", "source_subtype", "line_count", *lists, "export_count", "raw_hash", F.sha2("markdown", 256).alias("digest"))


def _code(spark, d):
    return tables.raw_files(tables.table(spark, d, "documents")).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


@_register
def code_files(spark, d):
    return code_graph.code_files(_code(spark, d))


@_register
def code_imports(spark, d):
    return code_graph.code_imports(_code(spark, d))


@_register
def page_parts(spark, d):
    return vault.parts(tables.vault(spark, d), tables.DOMAINS)


@_register
def chunk_ranges(spark, d):
    return vault.chunk_ranges(tables.vault(spark, d))


@_register
def chunk_pieces(spark, d):
    """chunk_ranges with sections that are too long cut into pieces, and the ids that searches and citations use."""
    return chunks.chunks(tables.vault(spark, d)).withColumn("digest", F.sha2("text", 256)).drop("text")


def _questions(spark, d):
    return tables.table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))


@_register
def chunk_search(spark, d):
    """BM25 over chunks with all terms of the benchmark text; the best chunk of a page, with the lines to cite."""
    return chunk_queries.search_pages(tables.vault(spark, d), _questions(spark, d))


@_register
def chunk_hybrid(spark, d):
    """chunk_search with the cosine of term counts, and of every page that shares a term."""
    return chunk_queries.hybrid_pages(tables.vault(spark, d), _questions(spark, d))


@_register
def markdown_sections(spark, d):
    return vault.sections(tables.vault(spark, d))


@_register
def wiki_degrees(spark, d):
    return vault.wiki_degrees(tables.vault(spark, d))


@_register
def stable_ids(spark, d):
    return tables.files(spark, d).select("doc_id", md.stable_id(F.col("path"), "page").alias("page_id"))


@_register
def snippets(spark, d):
    return tables.pages(spark, d).select("doc_id", md.snippet(F.col("body"), F.coalesce("lang", F.lit("")), 240).alias("snippet"))


@_register
def fallback_queries(spark, d):
    return tables.table(spark, d, "benchmark").select("item_id", F.array_join(md.fallback_queries(F.coalesce("text", F.lit(""))), " ").alias("queries"))


@_register
def file_risk(spark, d):
    found = vault.flags(confidence.state(tables.ledger(spark, d), _now()), _now())
    return vault.by_file(vault.file_pages(tables.vault(spark, d)), found, "file")


@_register
def changed_file_issues(spark, d):
    """The gate's check of pages that refer to changed files; the changed files are those named after three sources and one document in ten."""
    docs = tables.table(spark, d, "documents")
    some = docs.where(F.col("source").isin("src1", "src2", "src3")).select(F.concat(F.lit("./src/"), "source", F.lit(".ts")).alias("file"))
    changed = some.unionByName(docs.where("doc_id % 10 = 3").select(F.concat(F.lit("docs\\d"), "doc_id", F.lit(".md")).alias("file")))
    return vault.changed_file_issues(tables.vault(spark, d), confidence.state(tables.ledger(spark, d), _now()), changed, _now())


@_register
def chunk_lineage(spark, d):
    """Where derived chunks come from, with the lines of the chunks that they name."""
    rows = lineage.derived_chunks(tables.vault(spark, d))
    return lineage.with_source_lines(lineage.lineage(rows), rows)


@_register
def lineage_uses(spark, d):
    """What comes from each page, from each page's first chunk and from its first unit."""
    pages = tables.vault(spark, d)
    rows = lineage.lineage(lineage.derived_chunks(pages))
    ends = F.array(F.lit(""), F.lit(":c0"), F.lit(":su0"))
    return lineage.uses(rows, pages.select(F.explode(F.transform(ends, lambda e: F.concat("page_id", e))).alias("asked")))


@_register
def derived_ratios(spark, d):
    return lineage.derived_ratio(lineage.derived_chunks(tables.vault(spark, d)))


@_register
def compile_relations(spark, d):
    """What becomes of every twentieth page if it is compiled into the vault: target, relation and change."""
    sources = tables.table(spark, d, "documents").where("doc_id % 20 = 0").select(tables.page_id(F.col("doc_id")).alias("page_id"))
    return compiling.relations(tables.vault(spark, d), sources, stream.folder(spark, "compile"))


def _patches(spark, d):
    pages = tables.vault(spark, d)
    changes, units = tables.patches(tables.table(spark, d, "documents"))
    superseded = tables.ledger(spark, d).where("kind = 'superseded_by'").select("page_id")
    named = pages.join(patching.named_pages(changes, units), "page_id", "left_semi")
    return changes, patching.errors(changes, units, pages, chunks.chunks(named), superseded), pages


@_register
def patch_errors(spark, d):
    """Why patches cannot be applied."""
    return _patches(spark, d)[1]


@_register
def patched_pages(spark, d):
    """The pages that the patches without an error change or make."""
    after = patching.applied(*_patches(spark, d)).where("patches is not null")
    return after.select("page_id", "path", F.sha2("content", 256).alias("digest"), F.array_join("patches", ",").alias("patches"))


@_register
def patch_ledger(spark, d):
    """What the patches without an error add to the ledger."""
    return patching.ledger_lines(*_patches(spark, d)[:2])


@_register
def supersession_cycles(spark, d):
    return supersession.cycles(supersession.edges(tables.vault(spark, d)), stream.folder(spark, "cycles"))


@_register
def lint_report(spark, d):
    """All eight checks, at a time when some decisions and some other pages are stale."""
    return vault.lint(tables.vault(spark, d), tables.ledger(spark, d), F.lit(LATER).cast("timestamp_ntz"), stream.folder(spark, "lint"))


@_register
def lint_gate(spark, d):
    return vault.gate(lint_report(spark, d))


@_register
def page_confidence(spark, d):
    return vault.summaries(tables.vault(spark, d), confidence.state(tables.ledger(spark, d), _now()), _now())


@_register
def section_confidence(spark, d):
    return vault.section_confidence(tables.vault(spark, d), confidence.state(tables.ledger(spark, d), _now()), _now())


@_register
def pages_to_verify(spark, d):
    return vault.to_verify(tables.vault(spark, d), confidence.state(tables.ledger(spark, d), _now()))


@_register
def whole_pages(spark, d):
    return vault.whole(tables.vault(spark, d))


@_register
def wiki_links(spark, d):
    return vault.wiki(tables.vault(spark, d))


@_register
def vault_stats(spark, d):
    return vault.stats(tables.vault(spark, d))


@_register
def page_freshness(spark, d):
    return confidence.freshness(tables.ledger(spark, d), _now())


@_register
def active_contradictions(spark, d):
    return confidence.contradictions(tables.ledger(spark, d))


@_register
def conversation_sections(spark, d):
    return graph.section_lines(tables.sections(spark, d))


@_register
def link_degrees(spark, d):
    return graph.degrees(tables.table(spark, d, "pages"))


@_register
def page_titles(spark, d):
    return graph.titles(tables.table(spark, d, "pages"))


@_register
def streamed_daily_counts(spark, d):
    return stream.daily_counts(spark, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_whole_text(spark, sf_dir)
