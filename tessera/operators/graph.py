"""Pages' links, duplicates, sections and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimated_tokens, fingerprint, js_round, slug


def links(html: DataFrame) -> DataFrame:
    """(page_id, href) for each distinct link target of a page but itself."""
    found = html.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.where(~F.col("href").eqNullSafe(F.col("url"))).select("page_id", "href").distinct()


def degrees(html: DataFrame) -> DataFrame:
    """Per target: how many pages link to it, and whether a page of the table has that address."""
    known = html.select(F.col("url").alias("href"), F.lit(True).alias("known")).distinct()
    n = links(html).groupBy("href").agg(F.count("*").alias("in_links"))
    return n.join(known, "href", "left").select("href", "in_links", F.coalesce("known", F.lit(False)).alias("resolved"))


def titles(html: DataFrame) -> DataFrame:
    title = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    return html.select("page_id", title.alias("title"), slug(title).alias("slug"))


def duplicates(pages: DataFrame) -> DataFrame:
    """Fingerprints that several pages share: the first page, and how many."""
    f = fingerprint(F.col("body"))
    groups = pages.groupBy(F.sha2(f, 256).alias("fingerprint")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return groups.where("copies > 1")


def section_lines(sections: DataFrame) -> DataFrame:
    """Each section's number in its page and its range of lines: a heading line, then the text's lines."""
    lines = F.length(F.regexp_replace("text", "[^\n]", "")).cast("long") + 2
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    end = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = sections.withColumn("n", lines).withColumn("section", F.row_number().over(order).cast("long")).withColumn("line_end", end)
    return out.select("conv_id", "turn", "role", "section", (F.col("line_end") - F.col("n") + 1).alias("line_start"), "line_end", estimated_tokens(F.col("text")).cast("long").alias("tokens"))


def by_source(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: pages, labelled pages, mean quality, toxic pages."""
    rows = pages.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("pages"), F.count("quality").alias("labelled"), js_round(F.avg("quality"), 4).alias("quality"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))
