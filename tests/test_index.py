"""The index that is kept between runs: what a run takes, what it leaves alone, and that it equals one made at once."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import index

SCHEMA = "page_id string, path string, content string, extra int"
BUCKETS = 8


def frame(spark, pages):
    return spark.createDataFrame([(k, f"pages/{k}.md", v, 1) for k, v in pages], SCHEMA)


def contents(spark, folder):
    return {name: sorted(map(repr, index.read(spark, folder, name).collect())) for name in index.TABLES}


def files(spark, folder, name):
    """The files of each bucket."""
    out = {}
    for f in spark.read.parquet(f"{folder}/{name}").inputFiles():
        out.setdefault(f.split("bucket=")[1].split("/")[0], set()).add(f)
    return out


def rebuilt(spark, tmp_path, pages):
    folder = str(tmp_path / "rebuilt")
    index.update(frame(spark, pages), folder, str(tmp_path / "rebuilt-work"), BUCKETS, 5)
    return contents(spark, folder)


FIRST = [(f"p{k}", f"# Page {k}\nÉtat some_words number {k} of this page. " + "More text follows here. " * (k % 3)) for k in range(20)]


def test_a_second_run_takes_what_changed_and_equals_a_rebuild(spark, tmp_path):
    folder, work = str(tmp_path / "index"), str(tmp_path / "work")
    assert index.update(frame(spark, FIRST), folder, work, BUCKETS, 5) == {"inserted": 20}
    before = {name: files(spark, folder, name) for name in index.TABLES}
    assert index.update(frame(spark, FIRST), folder, work, BUCKETS, 5) == {"unchanged": 20}
    assert {name: files(spark, folder, name) for name in index.TABLES} == before
    second = [(k, v + "changed" if k == "p3" else v) for k, v in FIRST if k not in ("p5", "p6")] + [("q1", "new"), ("q2", ""), ("q3", None)]
    assert index.update(frame(spark, second), folder, work, BUCKETS, 5) == {"inserted": 3, "updated": 1, "deleted": 2, "unchanged": 17}
    moved = {str(r[0]) for r in spark.createDataFrame([(x,) for x in ("p3", "p5", "p6", "q1", "q2", "q3")], "p string").select(index.bucket_of(F.col("p"), BUCKETS)).collect()}
    for name in index.TABLES:
        after = files(spark, folder, name)
        assert {b for b in after if after[b] != before[name].get(b)} <= moved
        assert {b for b in before[name] if b not in moved} == {b for b in after if b not in moved}
    assert contents(spark, folder) == rebuilt(spark, tmp_path, second)
    assert {r["page_id"] for r in index.read(spark, folder, "pages").collect()} >= {"q2", "q3"}


def test_a_bucket_that_is_empty_now_is_emptied(spark, tmp_path):
    folder, work = str(tmp_path / "index"), str(tmp_path / "work")
    index.update(frame(spark, FIRST), folder, work, BUCKETS, 5)
    assert index.update(frame(spark, []), folder, work, BUCKETS, 5) == {"deleted": 20}
    assert contents(spark, folder) == {name: [] for name in index.TABLES}
    assert index.update(frame(spark, FIRST), folder, work, BUCKETS, 5) == {"inserted": 20}
    assert contents(spark, folder) == rebuilt(spark, tmp_path, FIRST)


@pytest.mark.parametrize("dies_at", [2, 4])
def test_a_run_that_dies_is_made_good_by_the_next(spark, tmp_path, monkeypatch, dies_at):
    folder, work = str(tmp_path / "index"), str(tmp_path / "work")
    index.update(frame(spark, FIRST), folder, work, BUCKETS, 5)
    second = [(k, v + "changed" if k == "p3" else v) for k, v in FIRST if k != "p5"]
    write, count = index._write, [0]

    def dying(rows, touched, path):
        count[0] += 1
        if count[0] == dies_at:
            if dies_at == 2:  # half of the buckets are gone already
                write(rows.limit(0), touched.limit(1), path)
            raise OSError("lost")
        write(rows, touched, path)

    monkeypatch.setattr(index, "_write", dying)
    with pytest.raises(OSError):
        index.update(frame(spark, second), folder, work, BUCKETS, 5)
    monkeypatch.setattr(index, "_write", write)
    index.update(frame(spark, second), folder, work, BUCKETS, 5)
    assert contents(spark, folder) == rebuilt(spark, tmp_path, second)


def test_odd_pages(spark, tmp_path):
    folder, work = str(tmp_path / "index"), str(tmp_path / "work")
    pages = [(None, "lost"), ("a", "one"), ("a", "one"), ("b", "x"), ("b", "y"), ("c", "word " * 5000)]
    found = index.update(frame(spark, pages), folder, work, BUCKETS)
    assert found == {"inserted": 3, "invalid": 1}
    assert index.read(spark, folder, "chunks").where("page_id in ('a', 'b')").count() == 2
    assert index.update(frame(spark, pages), folder, work, BUCKETS) == {"unchanged": 3, "invalid": 1}
    text = index.read(spark, folder, "chunks").where("page_id = 'c'").orderBy("idx").collect()
    assert len(text) > 5 and sum(r["text"].count("word") for r in text) == 5000
    norms = {r["chunk_id"]: r["norm"] for r in text}
    counted = index.read(spark, folder, "postings").where("page_id = 'c' and kind = 'vec'").groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("n")).collect()
    assert {r["chunk_id"]: r["n"] for r in counted} == norms


def test_index_terms(spark):
    from tessera.functions.text import index_terms

    texts = ["Crème BRÛLÉE foo_bar", "Crème", "日本語 x1", "", "Ǆ Ελλάδα"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(index_terms(F.col("t"))).collect()]
    assert found == [["creme", "brulee", "foo", "bar"], ["creme"], ["日本語", "x1"], [], ["ǆ", "ελλαδα"]]


def test_postings_and_their_counts_are_made_where_the_chunks_are(spark):
    rows = [("p", f"p:c{k}", t) for k, t in enumerate(["b a b A_b été", "", None, "x", "日本 z 日本 z z"])]
    found = index.postings(spark.createDataFrame(rows, "page_id string, chunk_id string, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    expected = {("vec", "b", 0): 2, ("vec", "a", 0): 1, ("vec", "a_b", 0): 1, ("vec", "été", 0): 1, ("fts", "b", 0): 3, ("fts", "a", 0): 2, ("fts", "ete", 0): 1}
    expected |= {(kind, *rest): n for kind in ("vec", "fts") for *rest, n in [("x", 3, 1), ("日本", 4, 2), ("z", 4, 3)]}
    assert {(r["kind"], r["term"], int(r["chunk_id"][3:])): r["tf"] for r in found.collect()} == expected and found.count() == len(expected)
    counts = {r["chunk_id"]: tuple(r)[1:] for r in index.term_counts(found.repartition(3)).collect()}
    assert counts == {"p:c0": (3, 5, "été"), "p:c3": (1, 1, "x"), "p:c4": (2, 5, "日本")}


def test_buckets_are_written_without_a_sort_and_the_setting_is_given_back(spark, tmp_path, monkeypatch):
    seen, counted = [], index.postings
    monkeypatch.setattr(index, "postings", lambda *a: seen.append(spark.conf.get(index.WRITERS)) or counted(*a))
    was = spark.conf.get(index.WRITERS)
    index.update(frame(spark, FIRST), str(tmp_path / "index"), str(tmp_path / "work"), BUCKETS, 5)
    assert seen == [was] == [spark.conf.get(index.WRITERS)] and was != str(index.OPEN)


def test_texts_are_shuffled_twice_and_postings_never(spark, tmp_path, monkeypatch):
    """Words that no two pages share, so that nothing packs: what a first run shuffles follows the texts, not the postings."""
    monkeypatch.setattr(index, "OPEN", 3)  # postings of three buckets at a time
    words = lambda k: " ".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest()[:12] for i in range(1500))
    pages = [(f"p{k}", words(k)) for k in range(40)]
    frame(spark, pages).write.parquet(str(tmp_path / "pages"))
    rows = spark.read.parquet(str(tmp_path / "pages"))

    def written():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    folder, work, before = str(tmp_path / "index"), str(tmp_path / "work"), written()
    assert index.update(rows, folder, work, BUCKETS) == {"inserted": 40}
    assert written() - before < 2.5 * sum(len(v) for _, v in pages)
    assert index.read(spark, folder, "postings").count() == 2 * 1500 * 40
    assert spark.read.parquet(f"{work}/changed").count() == 0  # cut up, so not kept
    second = [(k, v + " changed" if k == "p3" else v) for k, v in pages if k != "p5"] + [("q", "new")]
    assert index.update(frame(spark, second), folder, work, BUCKETS) == {"inserted": 1, "updated": 1, "deleted": 1, "unchanged": 38}
    index.update(frame(spark, second), str(tmp_path / "whole"), str(tmp_path / "work2"), BUCKETS)
    assert contents(spark, folder) == contents(spark, str(tmp_path / "whole"))
