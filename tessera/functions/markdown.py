"""Expressions over markdown pages, paths and identifiers, all built-in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.chunking import SPACE

#: Extensions by kind of source.
KINDS = {
    "markdown": ("md", "markdown"),
    "text": ("txt", "text", "log"),
    "document": ("pdf", "docx", "doc", "html", "htm", "rtf", "odt"),
    "code": ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "cjs", "cts", "js", "jsx", "mjs", "mts", "ts", "tsx"),
}
#: The language of a code extension.
LANGUAGES = {"c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "hh", "hpp", "hxx"), "ts": ("ts", "mts", "cts"), "tsx": ("tsx",), "js": ("js", "mjs", "cjs"), "jsx": ("jsx",)}
#: Weight of a source by its type, pdf by its subtype; of others with and without a hash or path; what an authority adds to a web page.
WEIGHTS = {"markdown": 1.0, "git_commit": 0.9, "code": 1.0, "github_pr": 0.8, "github_issue": 0.6, "meeting": 0.7, "pdf_academic": 0.8, "pdf_vendor": 0.5, "webpage": 0.3, "chat": 0.4}
TRACED, UNTRACED, AUTHORITY = 0.8, 0.5, 0.3
#: The frontmatter with the lines that enclose it.
FRONTMATTER = r"(?s)^---\n.*?\n(?:---|\.\.\.)(?:\n|$)"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _named(value: Column, names: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for name, of in names.items():
        out = F.when(value.isin(*of), name).otherwise(out)
    return out


def kind(path: Column) -> Column:
    """markdown, text, document, code or none, by the extension."""
    return F.coalesce(_named(extension(path), KINDS), F.lit("none"))


def language(path: Column) -> Column:
    """The language of a code file; null for other files."""
    return _named(extension(path), LANGUAGES)


def target_path(path: Column) -> Column:
    """Where a source's page goes: hidden folders lose their dots, and the name ends with .md."""
    shown = F.transform(F.split(path, "/"), lambda x: F.when(x.rlike(r"^\.+$"), "hidden").otherwise(F.regexp_replace(x, r"^\.+", "")))
    name = F.array_join(shown, "/")
    return F.when(name.rlike(r"(?i)\.markdown$"), F.regexp_replace(name, r"(?i)\.markdown$", ".md")).when(name.rlike(r"(?i)\.md$"), name).otherwise(F.concat(name, F.lit(".md")))


def frontmatter(content: Column) -> Column:
    return F.regexp_extract(content, FRONTMATTER, 0)


def body(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def body_line(content: Column) -> Column:
    """The line that the body starts at, from 1."""
    return F.length(F.regexp_replace(frontmatter(content), r"[^\n]", "")) + 1


def _bare(value: Column) -> Column:
    """Without blanks around it, and without the quotes around these."""
    return F.regexp_replace(F.trim(value), r"^(?:\"(.*)\"|'(.*)')$", "$1$2")


def field(content: Column, name: str) -> Column:
    """A scalar field of the frontmatter; null without it."""
    return F.nullif(_bare(F.regexp_extract(frontmatter(content), rf"\n{name}:[ \t]*([^\n]*)\n", 1)), F.lit(""))


def list_field(content: Column, name: str) -> Column:
    """A list of the frontmatter, in brackets or a line each; empty without it."""
    front = frontmatter(content)
    flow = F.split(F.regexp_extract(front, rf"\n{name}:[ \t]*\[([^\]\n]*)\]", 1), ",")
    lines = F.split(F.regexp_replace(F.regexp_extract(front, rf"\n{name}:[ \t]*((?:\n[ \t]*- [^\n]*)+)", 1), r"\n[ \t]*- ", "\n"), "\n")
    return F.filter(F.transform(F.concat(flow, lines), _bare), lambda x: x != "")


def references(content: Column) -> Column:
    """Paths of the files that a page refers to, each once, with / between folders and no ./ before them."""
    plain = lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.array_distinct(F.transform(list_field(content, "references"), plain))


def title(of: Column, path: Column) -> Column:
    """The first first-level heading of a body, else the path's stem, else Untitled."""
    found = F.trim(F.regexp_extract(of, r"(?m)^# +([^\n]+)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("")), F.lit("Untitled"))


def page_title(content: Column, path: Column) -> Column:
    """A page's title is its frontmatter's; a page without one gets what title() finds."""
    return F.coalesce(field(content, "title"), title(body(content), path))


def authority(url: Column, domains: list[str]) -> Column:
    """Whether the host of a web address, or host and path, is one of the patterns, which may have * for anything."""
    whole = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    place = F.concat(host, F.when(path == "", "/").otherwise(F.lower(path)))
    found = F.lit(False)
    for domain in domains:
        pattern = "^" + ".*".join(re.escape(part) for part in domain.lower().split("*")) + "$"
        found = found | host.rlike(pattern) | place.rlike(pattern)
    return F.coalesce(found & (host != ""), F.lit(False))


def source_weight(kind_of: Column, subtype: Column, traced: Column, of_authority: Column | None = None) -> Column:
    """The weight of a page's source by its type, a PDF's by its subtype; others by whether a hash or path of them is known."""
    web = WEIGHTS["webpage"] if of_authority is None else F.when(of_authority, F.lit(min(1.0, WEIGHTS["webpage"] + AUTHORITY))).otherwise(WEIGHTS["webpage"])
    vendor = subtype.isin("vendor", "vendor_whitepaper")
    out = F.when((kind_of == "pdf") & (subtype == "academic"), WEIGHTS["pdf_academic"]).when((kind_of == "pdf") & vendor, WEIGHTS["pdf_vendor"])
    out = out.when(kind_of == "webpage", web)
    for name, weight in WEIGHTS.items():
        out = out.when(kind_of == name, weight)
    return out.when(traced, TRACED).otherwise(F.when(kind_of == "pdf", WEIGHTS["pdf_vendor"]).otherwise(UNTRACED))


def wiki_links(of: Column) -> Column:
    """Targets of [[target|alias#anchor]], in their order."""
    found = F.regexp_extract_all(of, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.split(F.split(x, r"\|")[0], "#")[0])), lambda x: x != "")


def wiki_key(target: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(target), r"\\", "/"), r"\.md$", ""))


def stable_id(text: Column, prefix: str) -> Column:
    """A 32-bit FNV-1a hash of the characters as a signed number's size, in base 36, twelve places."""
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE").substr(1, 2)), 16, 10).cast("long")
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(code(c)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    size = F.when(h >= 2147483648, 4294967296 - h).otherwise(h)
    return F.concat(F.lit(f"{prefix}_"), F.lpad(F.lower(F.conv(size.cast("string"), 10, 36)), 12, "0"))


def snippet(text: Column, query: Column, most: int) -> Column:
    """The whole text if it is short, else a window that starts a third of it before the query's first term."""
    term = F.lower(F.regexp_extract(query, r"[\p{L}\p{N}_]+", 0))
    at = F.when(term == "", 0).otherwise(F.greatest(F.lit(0), F.instr(F.lower(text), term) - 1 - most // 3))
    return F.when(F.length(text) <= most, text).otherwise(F.trim(F.substring(text, at + 1, F.lit(most))))


def fallback_queries(question: Column) -> Column:
    """Words to ask for one by one: those with capitals first, each once whatever its case, not the question itself."""
    words = F.filter(F.regexp_extract_all(question, F.lit(r"[A-Za-z][A-Za-z0-9_+#-]*"), F.lit(0)), lambda w: (F.length(w) >= 2) & (w != question))
    ordered = F.concat(F.filter(words, lambda w: w.rlike("[A-Z]")), F.filter(words, lambda w: ~w.rlike("[A-Z]")))
    keys = F.transform(ordered, lambda w: F.lower(w))
    return F.transform(F.array_distinct(keys), lambda k: F.element_at(ordered, F.array_position(keys, k).cast("int")))


def chunk_starts(lines: Column) -> Column:
    """Headings of levels 1 to 3 outside fences of either mark, as (at, line); a fence ends with its own mark."""
    mark = lambda x: F.regexp_extract(x, f"^{SPACE}*(```|~~~)", 1)

    def step(a: Column, x: Column) -> Column:
        fence = mark(x)
        head = (a["fence"] == "") & x.rlike(f"^#{{1,3}}{SPACE}")
        return F.struct(
            F.when(fence == "", a["fence"]).when(a["fence"] == "", fence).when(a["fence"] == fence, "").otherwise(a["fence"]).alias("fence"),
            (a["at"] + 1).alias("at"),
            F.when(head, F.concat(a["heads"], F.array(F.struct(a["at"].alias("at"), x.alias("line"))))).otherwise(a["heads"]).alias("heads"),
        )

    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("at"), F.array().cast("array<struct<at:int,line:string>>").alias("heads"))
    return F.aggregate(lines, start, step, lambda a: a["heads"])


def section_starts(lines: str) -> Column:
    """Headings of all levels outside backtick fences that are not indented, as (at, line)."""
    return F.expr(f"""aggregate({lines}, named_struct('fence', false, 'at', 0, 'heads', cast(array() as array<struct<at:int,line:string>>)), (a, x) -> named_struct(
        'fence', if(x like '```%', not a.fence, a.fence), 'at', a.at + 1,
        'heads', if(not a.fence and x rlike '^#{{1,6}}[ \\t]+[^ \\t]', concat(a.heads, array(named_struct('at', a.at, 'line', x))), a.heads)), a -> a.heads)""")
