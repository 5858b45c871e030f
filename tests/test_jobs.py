"""The jobs over copies of tables that grow between runs, with late, repeated and changed rows and runs that fail."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import index_pages, ledger_confidence
from jobs.queries import ORACLES, QUERIES
from tessera.operators import confidence
from tessera.sources.tables import ledger_lines

SF = "/root/testdata/sf0.001"
NOW = "2024-02-01 00:00:00"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_index_over_documents_that_change(spark, tmp_path):
    table, index, work = (str(tmp_path / x) for x in ("documents", "index", "work"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs.where("doc_id < 40").write.parquet(table)
    run = lambda: index_pages.run(spark, table, index, work, buckets=8)
    assert run() == {"inserted": 40}
    first = rows(index_pages.output(spark, index))
    assert run() == {"unchanged": 40} and rows(index_pages.output(spark, index)) == first
    docs.where("doc_id >= 40").write.mode("append").parquet(table)
    assert run() == {"inserted": 20, "unchanged": 40}
    text = F.when(F.col("doc_id") == 7, F.lit("# Anew\nwritten")).when(F.col("doc_id") == 8, None).otherwise(F.col("text"))
    table = str(tmp_path / "changed")
    docs.withColumn("text", text).where("doc_id <> 9").write.parquet(table)
    assert index_pages.run(spark, table, index, work, buckets=8) == {"updated": 2, "deleted": 1, "unchanged": 57}
    index_pages.run(spark, table, str(tmp_path / "whole"), str(tmp_path / "work2"), buckets=8)
    assert rows(index_pages.output(spark, index)) == rows(index_pages.output(spark, str(tmp_path / "whole")))


def expected(spark, events):
    return rows(confidence.state(ledger_lines(events).where("page_id is not null"), F.lit(NOW).cast("timestamp_ntz")))


def test_ledger_over_events_that_come_late_and_twice(spark, tmp_path):
    table, output, checkpoint = (str(tmp_path / x) for x in ("events", "output", "checkpoint"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    run = lambda each=1: ledger_confidence.run(spark, table, output, checkpoint, NOW, 4, each)
    seen = lambda: rows(ledger_confidence.output_table(spark, output))
    add = lambda df: df.coalesce(1).write.mode("append").parquet(table)
    add(events.where("event_id % 3 = 0"))
    add(events.where("event_id % 3 = 1 and event_id < 500"))
    assert run() == 2 and seen() == expected(spark, events.where("event_id % 3 = 0 or event_id % 3 = 1 and event_id < 500"))
    before = seen()
    assert run() == 0 and seen() == before
    # late lines, lines that were there already, and an event of nobody
    add(events.where("event_id % 3 <> 0 and event_id < 900"))
    add(events.where("event_id % 2 = 0").unionByName(events.limit(1).withColumn("user_id", F.lit(None).cast("long"))))
    taken = events.where("event_id % 3 = 0 or event_id < 900 or event_id % 2 = 0")
    assert run() == 2 and seen() == expected(spark, taken)
    add(events.where("event_id % 7 = 1"))
    assert run(100) == 1 and seen() == expected(spark, taken.unionByName(events.where("event_id % 7 = 1")).dropDuplicates(["event_id"]))


def test_ledger_goes_on_after_a_batch_that_failed(spark, tmp_path, monkeypatch):
    table, output, checkpoint = (str(tmp_path / x) for x in ("events", "output", "checkpoint"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(table)
    state, calls = confidence.state, [0]

    def failing(*given):
        calls[0] += 1
        if calls[0] == 2:  # the batch's lines are in the ledger, its pages not yet folded
            raise OSError("lost")
        return state(*given)

    monkeypatch.setattr(confidence, "state", failing)
    with pytest.raises(Exception, match="lost"):
        ledger_confidence.run(spark, table, output, checkpoint, NOW, 4, 1)
    monkeypatch.setattr(confidence, "state", state)
    assert ledger_confidence.run(spark, table, output, checkpoint, NOW, 4, 1) == 2
    assert rows(ledger_confidence.output_table(spark, output)) == expected(spark, events)


def test_command_line(spark, tmp_path):
    config = tmp_path / "job.json"
    config.write_text(json.dumps({"now": NOW, "buckets": 2}))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    command = [sys.executable, "-m", "jobs.ledger_confidence", "--config", str(config), "--events", f"{SF}/events.parque[t]", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 batches" in done.stderr
    assert rows(ledger_confidence.output_table(spark, str(tmp_path / "out"))) == expected(spark, spark.read.parquet(f"{SF}/events.parquet"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_job_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, want = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, found.select(*want.columns).collect()), key=repr) == sorted(map(plain, want.fetchall()), key=repr)
