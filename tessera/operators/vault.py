"""Markdown pages of a vault: parts, chunks by headings, sections, wiki links, lint, roll-up by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import markdown as md
from tessera.functions.text import estimated_tokens, js_round
from tessera.operators import confidence, lineage, supersession
from tessera.operators.chunks import sections_of


def parts(vault: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Per page: title, where the body starts, its frontmatter's source and that source's weight; `domains` are authorities."""
    c = F.col("content")
    names = ["source_type", "source_subtype", "source_url", "source_hash", "source_path"]
    rows = vault.select("page_id", "path", md.page_title(c, F.col("path")).alias("title"), md.body_line(c).cast("long").alias("body_line"), *[md.field(c, name).alias(name) for name in names])
    traced = F.coalesce("source_hash", "source_path").isNotNull()
    weight = md.source_weight(F.col("source_type"), F.col("source_subtype"), traced, md.authority(F.col("source_url"), domains or []))
    return rows.select("page_id", "path", "title", "body_line", "source_type", weight.alias("weight"))


def _lines(vault: DataFrame) -> DataFrame:
    c = F.col("content")
    return vault.select("page_id", md.body_line(c).alias("first"), F.split(F.regexp_replace(md.body(c), "\r\n", "\n"), "\n").alias("lines"))


def chunk_ranges(vault: DataFrame) -> DataFrame:
    """Chunks by headings of levels 1 to 3, before any is split for its size; what comes first is a chunk of its own.

    Blank lines at a chunk's end belong to none, and a chunk of blank lines is none.
    """
    rows = vault.select("page_id", F.explode(sections_of(F.col("content"))).alias("s"))
    text = F.col("s.text")
    return rows.select("page_id", F.col("s.line_start").cast("long").alias("line_start"), F.col("s.line_end").cast("long").alias("line_end"), estimated_tokens(text).cast("long").alias("tokens"), F.sha2(text, 256).alias("digest"))


def sections(vault: DataFrame) -> DataFrame:
    """Sections by headings of all levels; equal names of a page are numbered from 2; a page without headings is one."""
    rows = _lines(vault).withColumn("heads", md.section_starts("lines")).withColumn("n", F.size("lines"))
    none = rows.where("size(heads) = 0").select("page_id", F.lit("sec_body").alias("section_id"), F.lit("Body").alias("heading"), F.lit(0).cast("long").alias("level"), F.col("first").cast("long").alias("line_start"), (F.col("first") + F.col("n") - 1).cast("long").alias("line_end"))
    some = rows.select("page_id", "first", "n", "heads", F.posexplode("heads").alias("k", "h"))
    heading = F.trim(F.regexp_extract("h.line", r"^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1))
    slug = F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    base = lambda h: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_extract(h["line"], r"^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1))), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit("section"))
    own = F.coalesce(F.nullif(slug, F.lit("")), F.lit("section"))
    some = some.withColumn("own", own).withColumn("nth", F.size(F.filter(F.transform(F.slice("heads", 1, F.col("k") + 1), base), lambda s: s == F.col("own"))))
    end = F.coalesce(F.try_element_at("heads", F.col("k") + 2)["at"], F.col("n")) + F.col("first") - 1
    section = F.concat(F.lit("sec_"), F.col("own"), F.when(F.col("nth") > 1, F.concat(F.lit("_"), F.col("nth").cast("string"))).otherwise(""))
    level = F.length(F.regexp_extract("h.line", r"^(#{1,6})", 1)).cast("long")
    return some.select("page_id", section.alias("section_id"), heading.alias("heading"), level.alias("level"), (F.col("first") + F.col("h.at")).cast("long").alias("line_start"), end.cast("long").alias("line_end")).unionByName(none)


def wiki(vault: DataFrame) -> DataFrame:
    """(page_id, target, to) of each wiki link; `to` is the page that the target names, else null.

    A page is named by its id, title, path, path under pages/ with and without .md, file name and aliases; of pages with
    one name the last by path is meant.
    """
    c, path = F.col("content"), F.col("path")
    under = F.regexp_replace(path, "^pages/", "")
    names = F.concat(F.array(F.col("page_id"), md.page_title(c, path), path, under, F.regexp_replace(under, r"\.md$", ""), F.regexp_extract(path, r"([^/]*?)(?:\.md)?$", 1)), md.list_field(c, "aliases"))
    known = vault.select("page_id", "path", F.explode(F.transform(names, md.wiki_key)).alias("key")).groupBy("key").agg(F.max_by("page_id", F.struct("path", "page_id")).alias("to"))
    targets = vault.select("page_id", F.explode(md.wiki_links(md.body(c))).alias("target")).withColumn("key", md.wiki_key(F.col("target")))
    return targets.join(known, "key", "left").select("page_id", "target", "to")


def wiki_degrees(vault: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Per page: links out and in (repeated ones counted, those to itself not), broken links, and whether it is an orphan. links: wiki()'s rows, if known."""
    found = wiki(vault) if links is None else links
    out = found.groupBy("page_id").agg(F.count_if(F.col("to") != F.col("page_id")).alias("outgoing"), F.count_if(F.col("to").isNull()).alias("broken"))
    into = found.where("to <> page_id").groupBy(F.col("to").alias("page_id")).agg(F.count("*").alias("incoming"))
    rows = vault.select("page_id").join(out, "page_id", "left").join(into, "page_id", "left").fillna(0, ["outgoing", "broken", "incoming"])
    return rows.select("page_id", "outgoing", "incoming", "broken", ((F.col("outgoing") == 0) & (F.col("incoming") == 0)).alias("orphan"))


def flags(state: DataFrame, now: Column) -> DataFrame:
    """Per page of the ledger: score and flags, in their order: below .5, superseded, not verified for 60 days."""
    days = (F.unix_micros(now.cast("timestamp")) / 1e6 - F.col("last_verified_at")) / 86400
    found = F.array(F.when(F.col("score") < 0.5, "NEEDS_REVIEW"), F.when(F.col("superseded"), "SUPERSEDED"), F.when(days > 60, "STALE"))
    return state.select("page_id", "score", F.array_compact(found).alias("flags"))


def risk(of: Column) -> Column:
    has = lambda f: F.array_contains(of, f)
    return F.when(has("MISSING_LEDGER"), "missing_ledger").when(has("NEEDS_REVIEW"), "needs_review").when(has("STALE"), "stale").when(has("SUPERSEDED"), "superseded").otherwise("ok")


def by_file(pages: DataFrame, flagged: DataFrame, file: str) -> DataFrame:
    """Per file that pages refer to: pages, least and mean score, all flags, the risk and its rank. A page without a ledger is flagged so."""
    rows = pages.join(flagged, "page_id", "left").withColumn("flags", F.coalesce("flags", F.array(F.lit("MISSING_LEDGER"))))
    # a file has few flags, however many pages: they are distinct before they are gathered
    names = rows.select(file, F.explode("flags").alias("flag")).groupBy(file).agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    # scores have four places: as whole numbers their sum does not depend on the order of rows
    mean = js_round(F.sum(F.round(F.col("score") * 10_000).cast("long")) / F.count("score") / 10_000, 4)
    sums = rows.groupBy(file).agg(F.count("*").alias("page_count"), F.min("score").alias("min_score"), mean.alias("avg_score"))
    level = risk(F.coalesce("flags", F.array().cast("array<string>")))
    rank = sum((F.when(level == name, k).otherwise(0) for k, name in enumerate(["missing_ledger", "needs_review", "stale", "superseded", "ok"])), F.lit(0))
    return sums.join(names, sums[file].eqNullSafe(names[file]), "left").select(sums[file].alias("file"), "page_count", "min_score", "avg_score", F.coalesce(F.array_join("flags", ","), F.lit("")).alias("flags"), level.alias("risk_level"), rank.cast("long").alias("risk_rank"))


def lint(vault: DataFrame, ledger: DataFrame, now: Column, folder: str, units: DataFrame | None = None) -> DataFrame:
    """(check, page_id, detail) of the eight checks.

    Low confidence; stale: not verified for 180 days, or, with `gate` as detail, a decision not verified (or, never
    verified, not known) for 100 days or more; contradicted, with how often; pages without links; links to no page;
    pages that are derived by more than half, with how many chunks of how many; lineage from nowhere; pages on a cycle
    of supersessions, with its first page. `folder` takes the tables of the cycles' search, and the chunks, links and
    states that several checks read, so that each is made once.
    """
    def once(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    state = confidence.state(ledger, now)
    micros = F.unix_micros(now.cast("timestamp"))
    kinds = vault.select("page_id", (F.lower(md.field(F.col("content"), "type")) == "decision").alias("decision"))
    first = ledger.groupBy("page_id").agg(F.min("ts").alias("first_at"))
    known = once(state.join(kinds, "page_id").join(first, "page_id"), "known")
    days = lambda seconds: (micros / 1e6 - seconds) / 86400
    since = F.coalesce("last_verified_at", F.unix_micros(F.col("first_at").cast("timestamp")) / 1e6)
    gate_days = F.coalesce(F.col("decision") & (days(since) >= 100), F.lit(False))
    stale = known.withColumn("gate", gate_days).where(F.col("gate") | (days(F.col("last_verified_at")) > 180))
    chunk_rows = once(lineage.derived_chunks(vault).select("page_id", "chunk_id", "marker"), "chunks")
    links = once(wiki(vault), "links")
    ratio = lineage.derived_ratio(chunk_rows).where(F.col("derived") / F.col("total") > 0.5)
    cycles = supersession.cycles(supersession.edges(vault), folder)
    found = lambda rows, check, detail: rows.select(F.lit(check).alias("check"), "page_id", detail.cast("string").alias("detail"))
    none = F.lit(None)
    return (
        found(known.where("score < 0.5"), "low_confidence", none)
        .unionByName(found(stale, "stale", F.when(F.col("gate"), "gate")))
        .unionByName(found(confidence.contradictions(ledger).join(vault.select("page_id"), "page_id", "left_semi"), "unresolved_contradiction", F.col("active")))
        .unionByName(found(wiki_degrees(vault, links).where("orphan"), "orphan_page", none))
        .unionByName(found(links.where("to is null"), "broken_link", F.col("target")))
        .unionByName(found(ratio, "high_derived_ratio", F.concat("derived", F.lit("/"), "total")))
        .unionByName(found(lineage.orphaned(lineage.lineage(chunk_rows), chunk_rows, units), "orphaned_lineage", F.col("source")))
        .unionByName(found(cycles, "supersession_cycle", F.col("cycle")))
    )


#: Checks of lint(), and whether a finding fails the gate; a stale page does so only as a decision.
CHECKS = {
    "low_confidence": False, "stale": False, "unresolved_contradiction": True, "orphan_page": False, "broken_link": True, "high_derived_ratio": False, "orphaned_lineage": False, "supersession_cycle": True,
}


def gate(findings: DataFrame) -> DataFrame:
    """(check, found, status) of every check, also of those without findings."""
    names = F.map_from_arrays(F.array(*[F.lit(c) for c in CHECKS]), F.array(*[F.lit(h) for h in CHECKS.values()]))
    checks = findings.sparkSession.range(1).select(F.explode(names).alias("check", "hard"))
    gated = F.count_if((F.col("check") == "stale") & F.col("detail").eqNullSafe("gate"))
    rows = checks.join(findings.groupBy("check").agg(F.count("*").alias("n"), gated.alias("gated")), "check", "left")
    found = F.coalesce("n", F.lit(0))
    status = F.when(found == 0, "pass").when(F.col("hard") | (F.col("gated") > 0), "fail").otherwise("warn")
    return rows.select("check", found.cast("long").alias("found"), status.alias("status"))


def file_pages(vault: DataFrame) -> DataFrame:
    """(page_id, path, file) for every file that a page refers to."""
    return vault.select("page_id", "path", F.explode(md.references(F.col("content"))).alias("file"))


def changed_file_issues(vault: DataFrame, state: DataFrame, changed: DataFrame, now: Column) -> DataFrame:
    """(file, page_id, path, score, flags) of pages that refer to a changed file and have no ledger or a flag."""
    rows = file_pages(vault).join(changed.select(F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), r"^\./", "").alias("file")).distinct(), "file", "left_semi")
    of = rows.join(flags(state, now), "page_id", "left").withColumn("flags", F.coalesce("flags", F.array(F.lit("MISSING_LEDGER"))))
    return of.where("size(flags) > 0").select("file", "page_id", "path", "score", F.array_join("flags", ",").alias("flags"))


def summaries(vault: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Every page with its confidence; a page without a ledger has no score and is flagged so."""
    known = state.join(flags(state, now).select("page_id", "flags"), "page_id").select("page_id", "score", "source_count", "contradiction_count", "flags")
    rows = vault.select("page_id", "path", md.page_title(F.col("content"), F.col("path")).alias("title")).join(known, "page_id", "left")
    missing = F.array(F.lit("MISSING_LEDGER"))
    return rows.withColumn("flags", F.array_join(F.coalesce("flags", missing), ",")).fillna(0, ["source_count", "contradiction_count"])


def section_confidence(vault: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Sections with the score and flags of their page."""
    return sections(vault).join(summaries(vault, state, now).select("page_id", "score", "flags"), "page_id")


def to_verify(vault: DataFrame, state: DataFrame, least: float = 0.7) -> DataFrame:
    """Pages that score below `least` or have no ledger."""
    rows = vault.select("page_id", "path").join(state.select("page_id", "score"), "page_id", "left")
    return rows.where(F.col("score").isNull() | (F.col("score") < least))


def whole(vault: DataFrame) -> DataFrame:
    """Per page: its lines and the digest of its content."""
    c = F.col("content")
    lines = F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1)
    return vault.select("page_id", "path", lines.cast("long").alias("line_count"), F.sha2(c, 256).alias("digest"))


def stats(vault: DataFrame) -> DataFrame:
    """(metric, value): pages, chunks, their tokens, sections, wiki links."""
    chunks = chunk_ranges(vault)
    counted = lambda rows, metric, value=F.count("*"): rows.agg(F.lit(metric).alias("metric"), value.cast("long").alias("value"))
    out = counted(vault, "pages").unionByName(counted(chunks, "chunks")).unionByName(counted(chunks, "tokens", F.coalesce(F.sum("tokens"), F.lit(0))))
    return out.unionByName(counted(sections(vault), "sections")).unionByName(counted(wiki(vault), "links"))
