"""Code files and their imports: what each file has, and which file of the tree a relative import means.

An import means the first file there is of: the path as it is, with each extension, and an index file with each
extension. All candidates of all imports meet the files in one join, and the first by that order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.converting import EXPORT, IMPORT, REQUIRE, lines_of
from tessera.sources.raw import IGNORED

#: Extensions of code files, in the order in which they are tried.
EXTENSIONS = [".cjs", ".cts", ".js", ".jsx", ".mjs", ".mts", ".ts", ".tsx"]


def scanned(files: DataFrame) -> DataFrame:
    """Files (path, content as text) that are code, outside ignored folders; null content, as of files that are no UTF-8, is left out."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    code = F.col("path").rlike(r"[^/](?:" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$")
    return files.where(code & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED))) & F.col("content").isNotNull())


def specifiers(content: Column) -> Column:
    """All that a file imports, as often as it does: imports and exports, then requires."""
    return F.concat(F.regexp_extract_all(content, F.lit(IMPORT), F.lit(1)), F.regexp_extract_all(content, F.lit(REQUIRE), F.lit(1)))


def code_files(files: DataFrame) -> DataFrame:
    """(path, extension, line_count, import_count, export_count)."""
    content = F.col("content")
    return scanned(files).select(
        "path", F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("extension"), lines_of(content).cast("long").alias("line_count"), F.size(specifiers(content)).cast("long").alias("import_count"),
        F.regexp_count(content, F.lit(EXPORT)).cast("long").alias("export_count"),
    )


def normalized(path: Column) -> Column:
    """Without . and .. segments; one that leaves the tree keeps its .. and so names no file."""
    step = lambda a, p: F.when(p.isin("", "."), a).when((p == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def code_imports(files: DataFrame) -> DataFrame:
    """(from, to, specifier) of relative imports of known files, as often as they are written."""
    code = scanned(files)
    rows = code.select(F.col("path").alias("from"), F.posexplode(specifiers(F.col("content"))).alias("n", "specifier")).where(F.col("specifier").startswith("."))
    folder = F.regexp_extract("from", r"^(.*/)?[^/]*$", 1)
    base = normalized(F.concat(folder, "specifier"))
    inside = F.when(base == "", "").otherwise(F.concat(base, F.lit("/")))
    ways = F.concat(F.array(base), F.array(*[F.concat(base, F.lit(e)) for e in EXTENSIONS]), F.array(*[F.concat(inside, F.lit(f"index{e}")) for e in EXTENSIONS]))
    tried = rows.select("from", "n", "specifier", F.posexplode(ways).alias("nth", "to"))
    met = tried.join(code.select(F.col("path").alias("to")).distinct(), "to")
    return met.groupBy("from", "n", "specifier").agg(F.min_by("to", "nth").alias("to")).select("from", "to", "specifier")
