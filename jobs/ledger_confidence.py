"""Takes new events into the pages' ledger and keeps the confidence of the pages they touch up to date.

A file stream takes the files of `events` that the checkpoint does not know, some at a time, and ends when there are no
more. A batch is added to the table `ledger`, partitioned by bucket of page and by batch; then the pages that the batch
touched, and their buckets, are folded again from the ledger and replace their buckets of the table `confidence`. Events may come late and in any
order: the fold sorts them by time. One that comes twice counts once. A batch that is run again replaces its own part of
the ledger, so a job that failed goes on where it was. Without new files nothing is written.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from jobs.common import main
from tessera.streaming import ledger

LOG = logging.getLogger(__name__)


def run(spark: SparkSession, events: str, output: str, checkpoint: str, now: str, buckets: int = ledger.BUCKETS, files_per_batch: int = 100) -> int:
    """How many batches were taken. The scores are those of the time `now`."""
    batches = ledger.follow(spark, events, output, checkpoint, now, buckets, files_per_batch, LOG)
    LOG.info("read %s: %d batches; wrote %s", events, batches, output)
    return batches


def output_table(spark: SparkSession, output: str) -> DataFrame:
    return ledger.read_state(spark, output)


if __name__ == "__main__":
    main("ledger_confidence", __doc__, {"events": "folder or glob of event files", "output": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"}, run)
