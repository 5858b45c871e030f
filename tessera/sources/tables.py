"""Readers: the tables as knowledge pages, ledger events, queries and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_id(number: Column) -> Column:
    return F.concat(F.lit("page_"), F.lpad(number.cast("string"), 12, "0"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: page_id, doc_id, body, lang, source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(page_id(F.col("doc_id")).alias("page_id"), "doc_id", F.coalesce("text", F.lit("")).alias("body"), "lang", "source")


def queries(spark: SparkSession, sf_dir: str, words: int = 2) -> DataFrame:
    """Benchmark texts as queries: item_id and the first distinct terms of each."""
    from tessera.functions.text import terms

    found = F.slice(F.array_distinct(terms(F.col("text"))), 1, words)
    return table(spark, sf_dir, "benchmark").select("item_id", found.alias("terms"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts as queries: item_id and all terms, as often as they occur."""
    from tessera.functions.text import terms

    return table(spark, sf_dir, "benchmark").select("item_id", terms(F.col("text")).alias("terms"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_lines(table(spark, sf_dir, "events"))


#: Who verifies the pages of events of two types, in turn.
VIEWERS, BUYERS = ["ci:github-actions", "ci:build", "agent:claude-code", "agent:helper", "test:unit", "bot"], ["human:reader", "human:editor", "runbook-exec", "test:integration"]


def _turn(values: list[str], number: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def ledger_lines(events: DataFrame) -> DataFrame:
    """Events as ledger lines of a page each, of all kinds but those that concern two pages."""
    kind, of_fifty = F.col("event_type"), F.col("event_id") % 50
    click = F.when(of_fifty == 0, "superseded_by").when(of_fifty == 1, "manual_override").when(of_fifty <= 6, "source_removed").otherwise("decay_checkpoint")
    named = F.when(kind == "signup", "source_added").when(kind.isin("view", "purchase"), "verified").when(kind == "error", "contradicted_by").when(kind == "click", click).otherwise("decay_checkpoint")
    unit = lambda most: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / most))
    return events.withColumn("named", named).select(
        page_id(F.col("user_id")).alias("page_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("named").alias("kind"),
        F.when(kind == "view", _turn(VIEWERS, "event_id")).when(kind == "purchase", _turn(BUYERS, "event_id")).alias("actor_id"),
        F.when(F.col("named") == "verified", F.when(F.col("event_id") % 12 == 5, "agent").otherwise("human")).alias("verifier_type"),
        F.when(kind == "error", F.when(F.col("value") > 100, "major").otherwise("minor")).alias("severity"),
        F.when(F.col("named").isin("source_added", "source_removed"), F.concat(F.lit("src_"), (F.col("event_id") % 5).cast("string"))).alias("source_id"),
        F.when(kind == "signup", unit(500)).alias("source_weight"),
        F.when(F.col("named") == "manual_override", unit(100)).alias("new_base"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a page with one headed section per turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


#: Extensions and frontmatter that the vault's pages take in turn.
EXTENSIONS = ["md", "markdown", "txt", "log", "pdf", "ts", "py", "cpp", "bin", "mts", "cc", "text", "odt", "jsx", "H", "rs", "cjs"]
TYPES, SUBTYPES = ["markdown", "pdf", "webpage", "chat", "code", "letter"], ["academic", "vendor", "other", "vendor_whitepaper"]
#: Web addresses that pages come from, and the domains among them that are authorities.
HOSTS, DOMAINS = ["docs.example.org/a", "blog.example.org", "EXAMPLE.com/Manual/x"], ["docs.example.org", "example.com/manual/*"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: doc_id, path."""
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, ".inbox/").otherwise("notes/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), _turn(EXTENSIONS, "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


#: Extensions of the made-up source files, in turn.
CODE = ["ts", "tsx", "js", "mjs", "cpp", "c", "mts", "log", "pdf", "txt", "md"]


def raw_files(documents: DataFrame) -> DataFrame:
    """Documents as files of code and others: doc_id, path, content as bytes, the text in a comment; one in thirteen is no UTF-8."""
    lit, d = F.lit, F.col("doc_id")
    of = lambda k: (d + k).cast("string")
    folder = F.concat(F.when(d % 17 == 0, "node_modules/").when(d % 19 == 0, ".inbox/").otherwise("src/"), F.coalesce("lang", lit("none")), lit("/"))
    path = F.concat(folder, F.when(d % 23 == 0, F.concat(lit("d"), of(0), lit("/index"))).otherwise(F.concat(lit("f"), of(0))), lit("."), _turn(CODE, "doc_id"))
    text = F.coalesce(F.replace(F.replace("text", lit("*/")), lit("'")), lit(""))
    modules = F.concat(
        lit("import { a } from './f"), of(11), lit("';\nexport * from \"../"), F.coalesce("lang", lit("none")), lit("/./f"), of(22), lit(".mjs\"\n  export const x = require( './d"), of(23), lit("' );\nimport type { T } from \"pkg\";\nimport './f"), of(11),
        lit("'\nimport x from '../../../up';\n/* "), text, lit(" */\n"),
    )
    c = F.concat(lit("#include <stdio.h>\n  # include \"f"), of(1), lit('.h"\n#include <stdio.h>\n/* '), text, lit(" */;\nstatic int run_"), of(0), lit("(int a)\n{\n  if (a) {\n  }\n}\nint main() { ```` }\n\n"))
    ext = d % len(CODE)
    whole = F.when(ext.isin(4, 5), c).when(ext.isin(7, 8, 9, 10), F.concat(lit("#  Title "), of(0), lit("  \r\n"), text, lit("  \n"))).otherwise(modules).cast("binary")
    return documents.select("doc_id", path.alias("path"), F.when(d % 13 == 5, F.concat(whole, F.unhex(lit("FFFE")))).otherwise(whole).alias("content"))


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault_pages(table(spark, sf_dir, "documents"))


def vault_pages(documents: DataFrame) -> DataFrame:
    """Documents as markdown pages: page_id, path, content with frontmatter, headings, a fence and wiki links around the text."""
    n = F.col("doc_id").cast("string")
    lit = F.lit
    # rings of three pages, pages that lead to one, and pages that name none
    d = F.col("doc_id")
    ring = d - d % 27 + (d + 9) % 27
    superseded = F.when(d % 9 == 0, ring).when(d % 9 == 1, d - 1).when(d % 9 == 2, lit(999_999_999_999))
    supersedes = F.coalesce(F.concat(lit("\nsupersedes: "), page_id(superseded)), lit(""))
    front = F.concat(
        lit("---\ntitle: 'Page "), n, lit("'\naliases: [Nick "), n, lit(', "Also '), n, lit('"]\nsource_type: '), _turn(TYPES, "doc_id"), lit("\nsource_subtype: "), _turn(SUBTYPES, "doc_id"),
        lit("\nsource_url: https://"), _turn(HOSTS, "doc_id"),
        lit("\ntype: "), _turn(["note", "Decision", "concept"], "doc_id"), supersedes, lit("\nreferences: [src/"), F.coalesce("source", lit("none")), lit(".ts, '.\\docs\\d"), (F.col("doc_id") % 50).cast("string"), lit(".md']"), F.when(F.col("doc_id") % 2 == 0, "\nsource_hash: sha256:00").otherwise(""), lit("\n---\n"),
    )
    of = lambda k: (F.col("doc_id") + k).cast("string")
    links = F.concat(
        lit("[["), (F.col("doc_id") + 1 + F.col("doc_id") % 3).cast("string"), lit("|next]] and [[Nowhere "), (F.col("doc_id") % 7).cast("string"), lit("#part]] [[page "), of(5), lit("]] [[NICK "), of(6),
        lit("#x]] [[Also "), of(7), lit("]] [["), F.coalesce("lang", lit("none")), lit("\\"), of(1), lit(".md]]\n"),
    )
    near = lambda k: page_id(d + k)
    whole = F.concat(lit("<!-- kb:derived  source="), near(1), lit(':su0 method=new patch=patch_7 -->\n'))
    below = F.concat(
        lit('## Derived\n<!-- kb:derived source="'), near(2), lit(":c0, "), near(1), lit(", "), near(2), lit(":c99,lost:su1,"), near(1), lit(':su2" method=merge\n patch=p promptHash=h modelId="m 1" patch=patch_8 compiledAt=2024-01-01T00:00:00Z-->\nsummed up\n'),
    )
    content = F.concat(
        F.when(F.col("doc_id") % 4 != 3, front).otherwise(""), F.when(F.col("doc_id") % 5 != 4, F.concat(lit("# Note "), n, lit("\n\n"))).otherwise(""), F.when(d % 10 == 7, whole).otherwise(""), F.when(d % 60 == 20, "This replaces what was.\n").when(d % 60 == 40, "It conflicts with others: page 3.\n").otherwise(""),
        F.coalesce("text", lit("")), lit("\n\n"), F.when(d % 5 == 2, below).otherwise(""), F.when(F.col("doc_id") % 6 != 5, F.concat(lit("## See also ##\n"), links, lit("```sh\n# not a heading\n```\n### See also\n  \n"))).otherwise(""),
    )
    path = F.concat(lit("pages/"), F.coalesce("lang", lit("none")), lit("/"), n, lit(".md"))
    return documents.select(page_id(F.col("doc_id")).alias("page_id"), path.alias("path"), content.alias("content"), "source")


def patches(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A patch of one change for every tenth document, in turn of each kind: the changes, and the units that they come from."""
    d, lit = F.col("doc_id"), F.lit
    rows = documents.where(d.isNotNull() & (d % 10 == 0)).withColumn("k", (F.floor(d / 10) % 5).cast("int"))
    k, none = F.col("k"), lit(None).cast("string")
    next_page, made, old = page_id(d + 1), page_id(d + 900_000_000_000), page_id(d + 2)
    target = F.when((k == 4) & (d % 4 == 0), page_id(d + 1_000_000)).when(k == 3, made).otherwise(next_page)
    content = (
        F.when(k == 0, F.concat(lit("## Added\n<!-- kb:derived source="), page_id(d), lit(":su0,"), page_id(d), F.when(d % 3 == 0, ":c999").otherwise(":c0"), lit(" -->\nmore\n"))).when(k == 1, "## See also ##\nnone\n\n").when(k == 2, "inserted  ")
        .when(k == 3, F.concat(lit("---\ntitle: Made\n---\nin place of "), old))
    )
    changes = rows.select(
        F.concat(lit("patch_"), F.lpad(d.cast("string"), 12, "0")).alias("patch_id"), lit(0).alias("n"), F.when(k == 4, "confidence_only").when(k == 3, "create").otherwise("modify").alias("type"), target.alias("page_id"),
        F.when(k == 0, "append_section").when(k == 1, "replace_section").when(k == 2, "insert_after_section").alias("operation"), F.when(k == 1, "See also ##").when(k == 2, F.concat(lit("# note "), (d + 1).cast("string"))).alias("section"), content.alias("content"),
        F.when(k == 4, "duplicate").when(k == 3, "supersede").otherwise("extend").alias("relation"), none.alias("path"), F.when(k == 3, old).alias("supersedes"), F.when(k == 0, "source_added").when(k == 3, "supersedes").when(k == 1, "contradicted_by").alias("impact"),
        F.when(k == 0, (d % 700) / 500).alias("weight"), F.when(k == 1, F.when(d % 60 == 10, "huge").otherwise("minor")).alias("severity"), F.when(k == 3, old).alias("other"),
    )
    units = rows.select(F.concat(lit("patch_"), F.lpad(d.cast("string"), 12, "0")).alias("patch_id"), F.concat(page_id(d), lit(":su0")).alias("unit_id"), page_id(d).alias("source_page_id"), F.array(F.concat(page_id(d), lit(":c0"))).alias("source_chunks"))
    return changes, units
