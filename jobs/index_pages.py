"""Keeps the search index of a vault up to date with its pages.

Reads the whole table of documents and makes a markdown page of each. A page whose content and path have the hash that
the index stored for it at the last run is left alone; new and changed pages are cut into chunks and counted, and pages
that are gone leave the index. Written are three tables partitioned by bucket of page, in folders of `index`: `pages`
with the hashes, which are the job's mark, `chunks` and `postings`. Only buckets with a page that changed are written.
A run over the same documents changes nothing; one that failed is made good by the next.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from tessera.operators import index as pages_index
from tessera.sources.tables import vault_pages

LOG = logging.getLogger(__name__)


def run(spark: SparkSession, documents: str, index: str, work: str, buckets: int = pages_index.BUCKETS, max_tokens: int = 800) -> dict[str, int]:
    """Pages by what was done with them. `work` is a folder for tables of this run, free to use again afterwards."""
    found = pages_index.update(vault_pages(spark.read.parquet(documents)), index, work, buckets, max_tokens)
    LOG.info("read %s: %d pages, %d of them without an id", documents, sum(n for action, n in found.items() if action != "deleted"), found.get("invalid", 0))
    LOG.info("wrote %s: %s", index, ", ".join(f"{found.get(a, 0)} {a}" for a in ("inserted", "updated", "deleted", "unchanged")))
    return found


def output(spark: SparkSession, index: str) -> DataFrame:
    """The index as it stands: every page with its chunks, how many terms they have, and a page without chunks once."""
    counts = pages_index.term_counts(pages_index.read(spark, index, "postings"))
    chunks = pages_index.read(spark, index, "chunks").select("page_id", "chunk_id", "idx", "line_start", "line_end", "tokens", "size", F.sha2("text", 256).alias("digest"))
    counted = chunks.join(counts, "chunk_id", "left").fillna(0, ["index_terms", "vector_tokens"])
    return pages_index.read(spark, index, "pages").select("page_id", "path", "title", "content_hash").join(counted, "page_id", "left")


if __name__ == "__main__":
    main("index_pages", __doc__, {"documents": "table of documents", "index": "folder of the index", "work": "folder for tables of the run"}, run)
