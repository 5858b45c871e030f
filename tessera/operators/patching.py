"""Patches: whether they can be applied, and the pages and ledger lines that come of those that can.

changes: a row per change: patch_id, n (its place in the patch), type (modify, create, confidence_only), page_id (of the
page that is changed or made), operation, section, content, relation, path, supersedes, impact, weight, severity, other
(the other page of the impact). units: patch_id, unit_id, source_page_id, source_chunks. pages: page_id, path, content.

A patch is applied whole or not at all: errors are rows found by joins, any of which holds back all changes of its
patch. The changes of one page are made in the order of patch and place. Nothing is written here: apply() gives the
new tables, so the caller replaces all of them or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import markdown as md
from tessera.functions.editing import edited, has_section
from tessera.functions.text import slug
from tessera.operators.lineage import MARKER

CHANGES = (
    "patch_id string, n int, type string, page_id string, operation string, section string, content string, relation string, path string, supersedes string, impact string, weight double, severity string, other string"
)
UNITS = "patch_id string, unit_id string, source_page_id string, source_chunks array<string>"
#: The form of page ids; the weight of a duplicate that names none.
PAGE_ID = "^page_[a-z0-9]{12}$"
DUPLICATE_WEIGHT = 0.7
SECTIONED = ("replace_section", "insert_after_section")


def created_path(changes: DataFrame) -> Column:
    """Where a created page goes: the path given, else one by its id."""
    return F.coalesce(F.nullif(F.col("path"), F.lit("")), F.concat(F.lit("pages/compiled/"), slug(F.col("page_id")), F.lit(".md")))


def _sources(changes: DataFrame) -> DataFrame:
    """(patch_id, n, source): what the markers in new content name."""
    markers = F.regexp_extract_all("content", F.lit(MARKER), F.lit(1))
    named = F.transform(markers, lambda m: F.regexp_replace(F.regexp_extract(m, r"(?:^|\s)source=(\"[^\"]*\"|[^\s]+)", 1), '^"|"$', ""))
    each = F.filter(F.flatten(F.transform(named, lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x)))), lambda s: s != "")
    return changes.where("type in ('create', 'modify')").select("patch_id", "n", F.explode(each).alias("source"))


def _unit_chunks(units: DataFrame) -> DataFrame:
    return units.select("patch_id", F.lit(None).cast("int").alias("n"), F.explode("source_chunks").alias("source"))


def named_pages(changes: DataFrame, units: DataFrame) -> DataFrame:
    """page_id of the pages whose chunks the patches name: no others have to be cut up for errors()."""
    named = _sources(changes).select("source").unionByName(_unit_chunks(units).select("source"))
    return named.where(F.contains("source", F.lit(":c"))).select(F.regexp_replace("source", r"(?s):c[^:]*\z", "").alias("page_id")).distinct()


def errors(changes: DataFrame, units: DataFrame, pages: DataFrame, chunks: DataFrame, superseded: DataFrame) -> DataFrame:
    """(patch_id, n, error); n is null for what concerns the whole patch. superseded: page_id of pages that have been superseded; chunks: at least those of named_pages()."""
    ids, paths, chunk_ids = pages.select("page_id").distinct(), pages.select("path").distinct(), chunks.select(F.col("chunk_id").alias("source")).distinct()
    found = lambda rows, error: rows.select("patch_id", "n", error.alias("error"))
    say = lambda text, column: F.concat(F.lit(text + " "), F.coalesce(F.col(column), F.lit("undefined")))
    made = changes.where("type = 'create'").withColumn("path", created_path(changes))
    again = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("patch_id", "n"))
    edits = changes.where("type <> 'create'")
    sources = _sources(changes)
    old = superseded.select(F.col("page_id").alias("was")).distinct()
    taken = changes.withColumn("was", F.when((F.col("type") == "create") & (F.col("relation") == "supersede"), F.col("supersedes")).when(F.col("impact") == "superseded_by", F.when(F.col("type") == "create", F.col("other")).otherwise(F.col("page_id"))))
    impact = F.col("impact")
    bad_impact = (
        F.when((impact == "source_added") & ~F.coalesce(F.col("weight").between(0, 1), F.lit(False)), "sourceWeight must be 0-1")
        .when((impact == "contradicted_by") & ~F.coalesce(F.col("severity").isin("minor", "major"), F.lit(False)), "contradiction severity must be minor or major")
        .when((impact == "superseded_by") & ~F.coalesce(F.col("other").rlike(PAGE_ID), F.lit(False)), "invalid supersederPageId")
        .when((impact == "supersedes") & ~F.coalesce(F.col("other").rlike(PAGE_ID), F.lit(False)), "invalid supersededPageId")
        .when(~impact.isin("source_added", "contradicted_by", "superseded_by", "supersedes"), "unsupported confidenceImpact kind")
    )
    bad_supersede = (F.col("relation") == "supersede") & ~(F.col("impact").eqNullSafe("supersedes") & F.col("other").eqNullSafe(F.col("supersedes")))
    bad_path = ~F.col("path").rlike(r"^pages/.+\.md$") | F.arrays_overlap(F.split("path", "/"), F.array(F.lit(".."), F.lit(".")))
    own_id = md.field(F.col("content"), "id")
    sections = edits.where((F.col("type") == "modify") & F.col("operation").isin(*SECTIONED)).join(pages.select("page_id", md.body(F.col("content")).alias("body")), "page_id")
    source_pages = units.where(F.col("source_page_id").isNotNull() & ~F.col("source_page_id").rlike(PAGE_ID))
    # both kinds of names meet the chunks at once
    both = sources.where(F.contains("source", F.lit(":c"))).withColumn("what", F.lit("unresolved derived source")).unionByName(_unit_chunks(units).withColumn("what", F.lit("unresolved lineage source")))
    no_chunk = both.join(chunk_ids, "source", "left_anti")
    whole = source_pages.withColumn("n", F.lit(None).cast("int"))
    parts = [
        found(taken.join(old, "was"), F.concat("was", F.lit(" is already superseded"))),
        found(made.withColumn("k", again("page_id")).where("k > 1"), say("duplicate create page id", "page_id")),
        found(made.withColumn("k", again("path")).where("k > 1"), say("duplicate create path", "path")),
        found(made.join(ids, "page_id"), say("page already exists", "page_id")),
        found(made.join(paths, "path"), say("target path exists", "path")),
        found(made.where(bad_path), say("unsafe create path", "path")),
        found(made.where(own_id.isNotNull() & (own_id != F.col("page_id"))), F.lit("create content id mismatch")),
        found(made.where("supersedes is not null").join(ids.withColumnRenamed("page_id", "supersedes"), "supersedes", "left_anti"), say("target page not found", "supersedes")),
        found(made.where("relation = 'new' and supersedes is not null"), F.lit("new create cannot supersede")),
        found(made.where(bad_supersede), F.lit("supersede create requires matching confidenceImpact")),
        found(edits.join(ids, "page_id", "left_anti"), say("target page not found", "page_id")),
        found(changes.where("type = 'modify'").withColumn("bad", bad_impact).where("bad is not null"), F.col("bad")),
        found(sections.where(~has_section(F.col("body"), F.coalesce("section", F.lit("")))), say("target section not found", "section")),
        found(no_chunk, F.concat("what", F.lit(" "), F.coalesce("source", F.lit("undefined")))),
        found(sources.where(~F.contains("source", F.lit(":c"))).join(units.select("patch_id", F.col("unit_id").alias("source")), ["patch_id", "source"], "left_anti"), say("unresolved derived source", "source")),
        found(whole, F.lit("invalid lineage sourcePageId")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def applied(changes: DataFrame, wrong: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages after all patches without an error: (page_id, path, content, patches), patches null for pages that no patch changes."""
    good = changes.join(wrong.select("patch_id").distinct(), "patch_id", "left_anti")
    edits = good.where("type = 'modify'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("patch_id", "n", "operation", "section", "content"))).alias("edits"))
    rows = pages.select("page_id", "path", "content").join(edits, "page_id", "left")
    front, body = md.frontmatter(F.col("content")), md.body(F.col("content"))
    after = F.concat(front, F.aggregate("edits", body, lambda b, e: edited(b, e["operation"], e["section"], e["content"])))
    changed = rows.select("page_id", "path", F.when(F.col("edits").isNotNull(), after).otherwise(F.col("content")).alias("content"), F.transform("edits", lambda e: e["patch_id"]).alias("patches"))
    made = good.where("type = 'create'")
    # a created page without frontmatter gets its id
    content = F.when(md.field(F.col("content"), "id").isNotNull(), F.col("content")).when(md.frontmatter(F.col("content")) != "", F.regexp_replace("content", "^---\n", F.concat(F.lit("---\nid: "), "page_id", F.lit("\n")))).otherwise(F.concat(F.lit("---\nid: "), "page_id", F.lit("\n---\n"), "content"))
    return changed.unionByName(made.select("page_id", created_path(made).alias("path"), content.alias("content"), F.array("patch_id").alias("patches")))


def ledger_lines(changes: DataFrame, wrong: DataFrame) -> DataFrame:
    """(patch_id, n, page_id, kind, source_weight, severity, other): what the applied patches add to the ledger."""
    good = changes.join(wrong.select("patch_id").distinct(), "patch_id", "left_anti")
    kind = F.when((F.col("impact") == "source_added") | (F.col("relation") == "duplicate"), "source_added").otherwise(F.col("impact"))
    of = good.withColumn("kind", kind).where("kind is not null")
    weight, severity = F.when(F.col("kind") == "source_added", F.coalesce("weight", F.lit(DUPLICATE_WEIGHT))), F.when(F.col("kind") == "contradicted_by", F.when(F.col("severity") == "major", "major").otherwise("minor"))
    lines = of.select("patch_id", "n", "page_id", "kind", weight.alias("source_weight"), severity.alias("severity"), F.when(F.col("kind").isin("superseded_by", "supersedes"), F.col("other")).alias("other"))
    none = F.lit(None)
    replaced = good.where("type = 'create' and supersedes is not null").select("patch_id", "n", F.col("supersedes").alias("page_id"), F.lit("superseded_by").alias("kind"), none.cast("double").alias("source_weight"), none.cast("string").alias("severity"), F.col("page_id").alias("other"))
    return lines.unionByName(replaced)
