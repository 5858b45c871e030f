"""Where derived chunks come from: markers in sections, lineage rows, lookups both ways, and what is wrong with them.

A section with a comment `<!-- NAME:derived key=value ... -->` is derived, and so are all its pieces. Its `source` lists
chunk ids, which have `:c` in them, and ids of units, which have not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.chunking import SPACE, pieces, trimmed
from tessera.operators.chunks import MAX_TOKENS, sections_of

#: Methods that a marker may name; another one is the last.
METHODS = ["segment", "merge", "contradict", "supersede", "summary", "extend"]
NO_TIME = "1970-01-01T00:00:00.000Z"
MARKER = rf"<!--{SPACE}*[a-z]+:derived{SPACE}+([^>]+)-->"
ATTRIBUTE = rf"([A-Za-z][A-Za-z0-9_-]*)=(\"[^\"]*\"|[^{SPACE[1:-1]}]+)"


def marked(text: Column) -> Column:
    """What the first marker of a section says, as it stands; empty without one."""
    return F.regexp_extract(text, MARKER, 1)


def _attribute(marker: Column, name: str) -> Column:
    """The last value of an attribute, without quotes; null without it."""
    names, values = (F.regexp_extract_all(marker, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    own = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda a: a["name"] == name)
    return F.regexp_replace(F.try_element_at(own, F.lit(-1))["value"], '^"|"$', "")


def derived_chunks(pages: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(page_id, path, idx, chunk_id, line_start, line_end, marker) of every chunk; an underived one has an empty marker."""
    cut = lambda s: F.transform(pieces(s["text"], max_tokens), lambda p: F.struct(s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), s["marker"].alias("marker"), p.alias("text")))
    sections = F.transform(sections_of(F.col("content")), lambda s: F.struct(s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), marked(s["text"]).alias("marker"), s["text"].alias("text")))
    rows = pages.select("page_id", "path", F.posexplode(F.flatten(F.transform(sections, cut))).alias("idx", "c"))
    chunk_id = F.concat("page_id", F.lit(":c"), F.col("idx").cast("string")).alias("chunk_id")
    return rows.select("page_id", "path", "idx", chunk_id, F.col("c.line_start").cast("long").alias("line_start"), F.col("c.line_end").cast("long").alias("line_end"), F.col("c.marker").alias("marker"))


def lineage(chunks: DataFrame) -> DataFrame:
    """(id, chunk_id, source_unit_id, source_chunk_id, method, patch_id, prompt_hash, model_id, compiled_at): a row per source, units first."""
    m = F.col("marker")
    named = chunks.where("marker <> ''").select(
        "chunk_id", F.coalesce(_attribute(m, "source"), F.lit("")).alias("source"), _attribute(m, "method").alias("method"), F.coalesce(_attribute(m, "patch"), F.lit("")).alias("patch_id"),
        F.coalesce(_attribute(m, "promptHash"), F.lit("")).alias("prompt_hash"), F.coalesce(_attribute(m, "modelId"), F.lit("")).alias("model_id"), F.coalesce(_attribute(m, "compiledAt"), F.lit(NO_TIME)).alias("compiled_at"),
    )
    sources = F.filter(F.transform(F.split("source", ","), lambda s: trimmed(s)), lambda s: s != "")
    rows = named.withColumn("sources", sources)
    units, whole = F.filter("sources", lambda s: ~F.contains(s, F.lit(":c"))), F.filter("sources", lambda s: F.contains(s, F.lit(":c")))
    both = F.concat(F.transform(units, lambda s: F.struct(s.alias("unit"), F.lit(None).cast("string").alias("chunk"))), F.transform(whole, lambda s: F.struct(F.lit(None).cast("string").alias("unit"), s.alias("chunk"))))
    rows = rows.select("*", F.posexplode(both).alias("n", "s"))
    method = F.when(F.col("method").isin(*METHODS), F.col("method")).otherwise(METHODS[-1])
    return rows.select(
        F.concat("chunk_id", F.lit(":l"), F.col("n").cast("string")).alias("id"), "chunk_id", F.col("s.unit").alias("source_unit_id"), F.col("s.chunk").alias("source_chunk_id"), method.alias("method"),
        "patch_id", "prompt_hash", "model_id", "compiled_at",
    )


def with_source_lines(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lineage rows with the page and lines of the chunks that they name; null where there is no such chunk."""
    known = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.col("path").alias("source_path"), F.col("line_start").alias("source_line_start"), F.col("line_end").alias("source_line_end"))
    return rows.join(known, "source_chunk_id", "left")


def uses(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, chunk_id): lineage that comes from what is asked for: a chunk itself, or a page or unit and all that is within it.

    Every id within others begins with theirs and a colon: it is looked up by each of these beginnings, so that the
    lookup is an equal join.
    """
    source = F.coalesce("source_chunk_id", "source_unit_id")
    words = F.split(source, ":")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), ":"))
    keys = F.filter(heads, lambda h: (h == source) | ~F.contains(h, F.lit(":c")))
    return rows.select("id", "chunk_id", F.explode(F.array_distinct(keys)).alias("asked")).join(asked.select("asked").distinct(), "asked").select("asked", "id", "chunk_id")


def derived_ratio(chunks: DataFrame) -> DataFrame:
    """(page_id, derived, total) of pages with chunks."""
    return chunks.groupBy("page_id").agg(F.count_if(F.col("marker") != "").alias("derived"), F.count("*").alias("total"))


def orphaned(rows: DataFrame, chunks: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(page_id, chunk_id, source) of lineage whose source is no chunk, page, unit of a page or one of `units` (unit_id)."""
    pages = chunks.select("page_id").distinct()
    page_of = lambda c: F.split(c, ":")[0]
    lost_chunks = rows.where("source_chunk_id is not null").join(chunks.select(F.col("chunk_id").alias("source_chunk_id")), "source_chunk_id", "left_anti").select("chunk_id", F.col("source_chunk_id").alias("source"))
    of_unit = rows.where("source_unit_id is not null").withColumn("source_page", page_of(F.col("source_unit_id"))).join(pages.withColumnRenamed("page_id", "source_page"), "source_page", "left_anti")
    if units is not None:
        of_unit = of_unit.join(units.select(F.col("unit_id").alias("source_unit_id")), "source_unit_id", "left_anti")
    lost = lost_chunks.unionByName(of_unit.select("chunk_id", F.col("source_unit_id").alias("source")))
    return lost.select(page_of(F.col("chunk_id")).alias("page_id"), "chunk_id", "source")
