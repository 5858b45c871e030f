"""Markers, lineage both ways, what is orphaned, and cycles of supersessions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lineage, supersession

PAGES = "page_id string, path string, content string"


def derived(spark, contents, max_tokens=800):
    return lineage.derived_chunks(spark.createDataFrame([(p, f"pages/{p}.md", c) for p, c in contents], PAGES), max_tokens)


def test_markers(spark):
    big = "# Big\n<!-- kb:derived source=page_b:su1 -->\n" + "word " * 100
    marker = '<!--  x:derived  source=" page_b:c0 ,page_b:su0,, nowhere:su9 " method=summary patch="p 1" modelId=m compiledAt=t source=page_b:c0,page_b:su0,page_b:c7 -->'
    chunks = derived(spark, [("page_a", f"plain\n# D\n{marker}\ntext\n<!-- kb:derived source=second -->\n# E\n<!-- kb:derived method=new -->\n# F\n<!-- derived source=x -->"), ("page_b", big)], 20)
    rows = {r["id"]: r for r in lineage.lineage(chunks).collect()}
    assert sorted(x for x in rows if x.startswith("page_a:c1:")) == ["page_a:c1:l0", "page_a:c1:l1", "page_a:c1:l2"]
    one = [rows[f"page_a:c1:l{k}"] for k in range(3)]
    assert [(r["source_unit_id"], r["source_chunk_id"]) for r in one] == [("page_b:su0", None), (None, "page_b:c0"), (None, "page_b:c7")]
    assert {(r["method"], r["patch_id"], r["prompt_hash"], r["model_id"], r["compiled_at"]) for r in one} == {("summary", "p 1", "", "m", "t")}
    pieces = [r for x, r in rows.items() if x.startswith("page_b")]
    assert len(pieces) > 3 and {(r["source_unit_id"], r["method"], r["compiled_at"]) for r in pieces} == {("page_b:su1", "extend", "1970-01-01T00:00:00.000Z")}
    ratio = {r["page_id"]: (r["derived"], r["total"]) for r in lineage.derived_ratio(chunks).collect()}
    assert ratio["page_b"][0] == ratio["page_b"][1]


def test_uses_and_orphans(spark):
    chunks = derived(spark, [("page_a", "# A\n<!-- kb:derived source=page_b:c0,page_b:c1,page_b:su3,page_b,gone:su1,unit:su2,page_bb:c0 -->"), ("page_b", "text")])
    rows = lineage.lineage(chunks)
    asked = spark.createDataFrame([("page_b",), ("page_b:c0",), ("page_b:su3",), ("page_b:su",), ("gone",), ("page",)], "asked string")
    found = sorted((r["asked"], r["id"].split(":")[-1]) for r in lineage.uses(rows, asked).collect())
    # units come first: su3, page_b, gone:su1, unit:su2; then chunks c0, c1, page_bb:c0
    assert found == [("gone", "l2"), ("page_b", "l0"), ("page_b", "l1"), ("page_b", "l4"), ("page_b", "l5"), ("page_b:c0", "l4"), ("page_b:su3", "l0")]
    lost = sorted(r["source"] for r in lineage.orphaned(rows, chunks, spark.createDataFrame([("unit:su2",)], "unit_id string")).collect())
    assert lost == ["gone:su1", "page_b:c1", "page_bb:c0"]
    lines = {r["source_chunk_id"]: r["source_line_start"] for r in lineage.with_source_lines(rows, chunks).where("source_chunk_id is not null").collect()}
    assert lines == {"page_b:c0": 1, "page_b:c1": None, "page_bb:c0": None}


def cycles_of(to):
    found, done = set(), set()
    for start in to:
        way, at = [], start
        while at in to and at not in way and at not in done:
            way.append(at)
            at = to[at]
        if at in way:
            ring = way[way.index(at) :]
            k = ring.index(min(ring))
            found |= {(min(ring), i, p, len(ring)) for i, p in enumerate(ring[k:] + ring[:k])}
        done.update(way)
    return sorted(found)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_cycles_of_random_graphs(spark, tmp_path, seed):
    r = random.Random(seed)
    ids = [f"p{k:03d}" for k in range(90)]
    to = {p: r.choice(ids) for p in r.sample(ids, 60)}
    if seed == 2:  # one ring with a tail, and one page that supersedes itself
        to = {ids[k]: ids[(k + 1) % 50] for k in range(50)} | {ids[50 + k]: ids[49 + k] for k in range(1, 20)} | {"self": "self"}
    links = spark.createDataFrame(list(to.items()), "page_id string, to string")
    found = sorted(map(tuple, supersession.cycles(links, str(tmp_path / "c")).collect()))
    assert found == cycles_of(to)


def test_no_cycles_without_links(spark, tmp_path):
    assert supersession.cycles(spark.createDataFrame([], "page_id string, to string"), str(tmp_path / "a")).collect() == []
    chain = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(9)], "page_id string, to string")
    assert supersession.cycles(chain, str(tmp_path / "b")).collect() == []
    vault = spark.createDataFrame([("page_1", "a", "---\nsupersedes: page_2\n---\n"), ("page_2", "b", "---\nsupersedes: page_9\n---\n"), ("page_3", "c", "")], PAGES)
    assert [tuple(r) for r in supersession.edges(vault).collect()] == [("page_1", "page_2")]
