"""Rules of pages: kinds of sources, titles, wiki targets and source weights, row by row."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import markdown as md
from tessera.operators import lineage, vault


@pytest.mark.parametrize(
    "path, kind, language",
    [("a.mts", "code", "ts"), ("a.cc", "code", "cpp"), ("a.H", "code", "c"), ("a.text", "text", None), ("a.odt", "document", None), ("a.py", "none", None), ("a.rs", "none", None), ("a.ts", "code", "ts"), ("a.tsx", "code", "tsx"),
     ("a.cjs", "code", "js"), ("a.jsx", "code", "jsx"), ("x/.md", "markdown", None), ("a", "none", None), ("a.tar.LOG", "text", None)],
)
def test_kinds(spark, path, kind, language):
    found = spark.createDataFrame([(path,)], "path string").select(md.kind(F.col("path")), md.language(F.col("path"))).first()
    assert tuple(found) == (kind, language)


def page(n, front, body, path="pages/en/6.md"):
    return (f"page_{n}", path, (f"---\n{front}\n---\n" if front is not None else "") + body)


def test_wiki_targets(spark):
    rows = [
        page(1, 'title: "Real Title"\naliases: [Nick, "Other Name"]', "# H1\n", "pages/en/6.md"),
        page(2, "title: 'T 2'\naliases:\n  - One\n  - 'Two'\nsource_type: x", "", "pages/de/Seven.md"),
        page(3, None, "[[Real Title]] [[en/6]] [[EN/6.md]] [[nick|n]] [[Other name#a]] [[6]] [[one]] [[two]] [[t 2]] [[pages/de/seven]] [[page_1]] [[H1]] [[nowhere]] [[de\\Seven]]", "pages/x.md"),
    ]
    found = vault.wiki(spark.createDataFrame(rows, "page_id string, path string, content string")).collect()
    to = {r["target"]: r["to"] for r in found}
    assert len(found) == 14
    assert {t for t, x in to.items() if x is None} == {"H1", "nowhere"}
    assert {t for t, x in to.items() if x == "page_2"} == {"one", "two", "t 2", "pages/de/seven", "de\\Seven"}


def test_titles(spark):
    rows = [page(1, "title: Front", "# H1\n"), page(2, "x: y", "text\n# H1 \n"), page(3, None, "text", "pages/stem.md"), page(4, None, "", ""), page(5, "title: ''", "", "a/b.c.md")]
    found = {r["page_id"]: r["title"] for r in vault.parts(spark.createDataFrame(rows, "page_id string, path string, content string")).collect()}
    assert found == {"page_1": "Front", "page_2": "H1", "page_3": "stem", "page_4": "Untitled", "page_5": "b.c"}


@pytest.mark.parametrize(
    "front, weight",
    [("source_type: pdf\nsource_subtype: academic", 0.8), ("source_type: pdf\nsource_subtype: vendor_whitepaper", 0.5), ("source_type: pdf", 0.5), ("source_type: pdf\nsource_hash: x", 0.8), ("source_type: docx", 0.5),
     ("source_type: docx\nsource_path: a", 0.8), ("x: y", 0.5), ("source_hash: a", 0.8), ("source_type: git_commit", 0.9), ("source_type: webpage", 0.3), ("source_type: webpage\nsource_url: https://Docs.Example.org/x?y", 0.6),
     ("source_type: webpage\nsource_url: me@docs.example.org", 0.6), ("source_type: webpage\nsource_url: example.com/manual/a", 0.6), ("source_type: webpage\nsource_url: https://example.com/blog", 0.3), ("source_type: webpage\nsource_url: https://docs-example.org", 0.3)],
)
def test_source_weights(spark, front, weight):
    rows = spark.createDataFrame([page(1, front, "")], "page_id string, path string, content string")
    assert vault.parts(rows, ["docs.example.org", "example.com/manual/*"]).first()["weight"] == pytest.approx(weight)


def test_lint_cuts_pages_up_once(spark, tmp_path):
    from tessera.plans import registry
    from tessera.sources import tables

    sf = "/root/testdata/sf0.001"
    pages, now = tables.vault(spark, sf), F.lit(registry.LATER).cast("timestamp_ntz")
    found = vault.lint(pages, tables.ledger(spark, sf), now, str(tmp_path / "lint"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ":derived" not in plan
    kept = spark.read.parquet(f"{tmp_path}/lint/chunks")
    assert kept.count() == lineage.derived_chunks(pages).count() > 0
