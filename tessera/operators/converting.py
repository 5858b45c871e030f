"""Files to markdown pages: markdown as it is, texts under a title, code with what can be told of it and its source.

A file that is no UTF-8, or whose kind needs a tool from outside, gives a row with an error and no page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import markdown as md
from tessera.functions.chunking import BLANKS, SPACE, trimmed

#: Patterns of includes and functions of C and C++, of modules and exports of the others; words that are no function.
INCLUDE = rf"(?m)^{SPACE}*#{SPACE}*include{SPACE}+[<\"]([^>\"]+)[>\"]"
FUNCTION = rf"(?m)^{SPACE}*[A-Za-z_][\w:*&<>~{SPACE[1:-1]}]*{SPACE}+([A-Za-z_]\w*){SPACE}*\([^;{{}}]*\){SPACE}*\{{"
IMPORT = rf"\b(?:import|export){SPACE}+(?:type{SPACE}+)?(?:[^'\"]*?{SPACE}+from{SPACE}+)?[\"']([^\"']+)[\"']"
REQUIRE = rf"\brequire\({SPACE}*[\"']([^\"']+)[\"']{SPACE}*\)"
EXPORT = rf"(?m)^{SPACE}*export{SPACE}+"
NO_FUNCTIONS = ["if", "for", "while", "switch"]


def lines_of(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)


def found(code: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), lambda x: trimmed(x)), lambda x: x != "")


def imports(code: Column) -> Column:
    """All modules that a file names, imports first."""
    return F.concat(found(code, IMPORT), found(code, REQUIRE))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _heading(text: Column) -> Column:
    """The first first-level heading."""
    heads = F.transform(F.split(text, "\r?\n"), lambda x: trimmed(F.regexp_extract(x, f"^#{SPACE}+(.+?){SPACE}*$", 1)))
    return F.get(F.filter(heads, lambda x: x != ""), F.lit(0))


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit(f"- {label}:")), F.transform(values, lambda v: F.concat(F.lit("  - "), v))))


def converted(files: DataFrame) -> DataFrame:
    """Per file (path, content as bytes, kind): its page as markdown with title, source type and subtype, lines, modules and functions, or an error."""
    raw = F.col("content").cast("string")
    path = F.col("path")
    plain = F.regexp_replace(raw, "^\\x{FEFF}", "")
    rows = files.select("path", "kind", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("raw_hash"), F.is_valid_utf8(raw).alias("valid"), F.when(F.is_valid_utf8(raw), plain).alias("text"))
    rows = rows.withColumn("body", F.when(F.col("kind") == "markdown", F.col("text")).otherwise(F.rtrim(F.col("text"), F.lit(BLANKS)))).withColumn("language", F.when(F.col("kind") == "code", md.language(path)))
    body, c_like, none = F.col("body"), F.col("valid") & F.col("language").isin("c", "cpp"), F.array().cast("array<string>")
    module = F.col("valid") & F.col("language").isin("ts", "tsx", "js", "jsx")
    functions = F.filter(found(body, FUNCTION), lambda f: ~f.isin(*NO_FUNCTIONS))
    rows = rows.withColumns(
        {
            "includes": F.when(c_like, F.array_distinct(found(body, INCLUDE))).otherwise(none), "functions": F.when(c_like, F.array_distinct(functions)).otherwise(none),
            "imports": F.when(module, F.array_distinct(imports(body))).otherwise(none), "export_count": F.when(module, F.regexp_count(body, F.lit(EXPORT))).otherwise(0), "line_count": lines_of(body),
        }
    )
    error = F.when(F.col("kind") == "document", F.concat(F.lit("No converter available for ."), md.extension(path), F.lit(" in builtin mode"))).when(F.col("kind") == "none", "Unsupported").when(~F.col("valid"), F.concat(F.lit("Unreadable UTF-8 source: "), path))
    ticks = F.transform(F.regexp_extract_all(body, F.lit("`+"), F.lit(0)), lambda t: F.length(t) + 1)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(ticks), F.lit(3))))
    head = F.array(F.concat(F.lit("# "), path), F.lit(""), F.lit("## Code Metadata"), F.lit(""), F.concat(F.lit("- Language: "), "language"), F.concat(F.lit("- Lines: "), F.col("line_count").cast("string")))
    tail = F.array(F.lit(""), F.lit("## Source"), F.lit(""), F.concat(fence, "language"), body, fence, F.lit(""))
    code = F.array_join(F.concat(head, _listed("Includes", F.col("includes")), _listed("Imports", F.col("imports")), _listed("Functions", F.col("functions")), tail), "\n")
    kind = F.col("kind")
    markdown = F.when(kind == "markdown", body).when(kind == "text", F.concat(F.lit("# "), _stem(path), F.lit("\n\n"), body, F.lit("\n"))).when(kind == "code", code)
    title = F.when(kind == "markdown", F.coalesce(_heading(body), _stem(path))).when(kind == "text", _stem(path)).otherwise(path)
    subtype = F.when(kind == "code", F.col("language")).when((kind == "text") & (md.extension(path) == "log"), "log")
    good = error.isNull()
    return rows.select(
        "path", md.target_path(path).alias("target"), error.alias("error"), F.when(good, title).alias("title"), F.when(good, kind).alias("source_type"), F.when(good, subtype).alias("source_subtype"), F.when(good, markdown).alias("markdown"),
        F.when(good & (kind != "markdown"), F.col("line_count")).cast("long").alias("line_count"), "includes", "imports", "functions", F.col("export_count").cast("long").alias("export_count"), "raw_hash",
    )
