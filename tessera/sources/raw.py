"""Raw files as Spark's binary file source reads them: which are taken in, and which are left out and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markdown as md

#: Folders that are never looked into.
IGNORED = [".git", "coverage", "dist", "node_modules"]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files below a folder, the path relative to it. Spark reads no file that is empty, or whose name begins with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    whole = F.url_decode(F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    root = "/" + folder.split("://")[-1].split(":")[-1].strip("/") + "/"
    return files.select(F.element_at(F.split(whole, root.replace(".", r"\."), 2), -1).alias("path"), "content")


def _part(path: Column, of) -> Column:
    return F.exists(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), of)


def discover(files: DataFrame, documents: bool = True, code: bool = True, hidden: bool = False) -> DataFrame:
    """Files with their kind and, of those left out, the reason. Files of ignored folders are not listed."""
    path = F.col("path")
    kind = md.kind(path)
    name_hidden = F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))
    reason = (
        F.when(F.lit(not hidden) & name_hidden, "hidden").when(kind == "none", F.concat(F.lit("unsupported extension "), F.coalesce(F.nullif(md.extension(path), F.lit("")), F.lit("none"))))
        .when(F.lit(not documents) & (kind == "document"), "documents are left out").when(F.lit(not code) & (kind == "code"), "code is left out")
    )
    return files.where(~_part(path, lambda p: p.isin(*IGNORED))).withColumns({"kind": kind, "skipped": reason})
