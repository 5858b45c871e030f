"""Search over chunks: what the cases say, and scores against a full-text index of another make."""

import sqlite3

import pytest

from tessera.operators import chunk_search, index

PAGES = [
    ("page_gc", "pages/gc.md", "---\ntitle: Garbage Collection\n---\n# Garbage Collection\ngarbage collection primary result\n\n## More Garbage Collection\ngarbage collection secondary result, garbage\n"),
    ("page_ftl", "pages/ftl.md", "---\ntitle: FTL\n---\n# Mapping\nThe mapping cache keeps the Crème map_table hot.\n# Other\nnothing to see\n"),
    ("page_x", "pages/x.md", "creme cache only\n" + "filler words here " * 30),
    ("page_y", "pages/a.md", "filler words"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    index.update(spark.createDataFrame(PAGES, "page_id string, path string, content string"), folder, folder + "-work", 4)
    return index.read(spark, folder, "chunks"), index.read(spark, folder, "postings")


def ask(spark, tables, how, *queries, k=10):
    asked = spark.createDataFrame(list(enumerate(queries)), "item_id int, query string")
    return sorted(how(*tables, asked, k).collect(), key=lambda r: (r["item_id"], r["rank"]))


def test_search(spark, tables):
    found = ask(spark, tables, chunk_search.search, "garbage collection", "CREME", "nothing absent", "", None, "map_table")
    assert [(r["item_id"], r["page_id"]) for r in found] == [(0, "page_gc"), (1, "page_ftl"), (1, "page_x"), (5, "page_ftl")]
    assert found[0]["title"] == "Garbage Collection" and (found[0]["line_start"], found[0]["line_end"]) in ((4, 5), (7, 8))
    assert "garbage collection" in found[0]["snippet"]


def test_scores_equal_those_of_a_full_text_index(spark, tables):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(r["chunk_id"], r["text"]) for r in tables[0].collect()])
    for query in ("garbage collection", "cache", "creme", "filler words", "the mapping cache", "result result"):
        want = {i: round(-s, 6) for i, s in db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (" ".join(f'"{w}"' for w in query.split()),))}
        asked = spark.createDataFrame([(0, query)], "item_id int, query string")
        found = {r["chunk_id"]: r["bm25"] for r in chunk_search.bm25(*tables, asked, 10).collect()}
        assert found == pytest.approx(want, abs=2e-6)


def test_hybrid(spark, tables):
    found = ask(spark, tables, chunk_search.hybrid, "mapping cache", "filler", "zzz")
    assert found[0]["page_id"] == "page_ftl" and found[0]["bm25_score"] == 1.0 and found[0]["vector_score"] > 0
    assert {r["page_id"] for r in found if r["item_id"] == 0} == {"page_ftl", "page_x"}
    assert [r["bm25_score"] for r in found if r["item_id"] == 0] == [1.0, 0.0]
    assert len({r["page_id"] for r in found if r["item_id"] == 1}) == 2 and not [r for r in found if r["item_id"] == 2]
    assert len(ask(spark, tables, chunk_search.hybrid, "filler", k=1)) == 1


def test_pages_give_what_a_kept_index_gives(spark, tables, monkeypatch):
    """Chunks counted as they are cut, without postings of them; in groups and slices, too."""
    pages = spark.createDataFrame(PAGES, "page_id string, path string, content string")
    asked = spark.createDataFrame(list(enumerate(["garbage collection", "CREME cache", "", None, "map_table", "filler words", "result zzz"])), "item_id int, query string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    found, mixed = rows(chunk_search.search(*tables, asked)), rows(chunk_search.hybrid(*tables, asked))
    assert found and mixed and rows(chunk_search.search_pages(pages, asked)) == found
    monkeypatch.setattr(chunk_search.scoring, "MOST_TERMS", 4)
    monkeypatch.setattr(chunk_search.scoring, "CELLS", 4)
    assert rows(chunk_search.hybrid_pages(pages, asked)) == mixed
