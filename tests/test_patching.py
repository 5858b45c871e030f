"""Patches that can be applied and those that cannot, one rule at a time, and section edits against a plain model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.editing import edited, has_section
from tessera.operators import chunks, patching

A, B, C, NEW = (f"page_{x * 12}" for x in "abcn")
PAGES = [(A, "pages/a.md", "---\ntitle: A\n---\n# One\nfirst\n## Two\nsecond\n\n# Three\nthird\n"), (B, "pages/b.md", "plain\n"), (C, "pages/c.md", "c")]
UNIT = ("good", "u0", A, [f"{A}:c0"])


def change(patch, n, type, page, **more):
    names = ["operation", "section", "content", "relation", "path", "supersedes", "impact", "weight", "severity", "other"]
    return (patch, n, type, page, *[more.get(k) for k in names])


def frames(spark, changes, units=(UNIT,)):
    pages = spark.createDataFrame(PAGES, "page_id string, path string, content string")
    table = spark.createDataFrame(changes, patching.CHANGES)
    wrong = patching.errors(table, spark.createDataFrame(list(units), patching.UNITS), pages, chunks.chunks(pages), spark.createDataFrame([(C,)], "page_id string"))
    return table, wrong, pages


def create(patch="p", page=NEW, **more):
    return change(patch, 0, "create", page, **({"content": "new", "relation": "new", "path": "pages/new.md"} | more))


CASES = [
    (create(), None), (create(path=None), None), (create(path="pages/../x.md"), "unsafe create path pages/../x.md"), (create(path="x.md"), "unsafe create path x.md"), (create(page=A), f"page already exists {A}"),
    (create(path="pages/b.md"), "target path exists pages/b.md"), (create(content=f"---\nid: {A}\n---\nx"), "create content id mismatch"), (create(relation="extend", supersedes="page_none00000000"), "target page not found page_none00000000"),
    (create(supersedes=A), "new create cannot supersede"), (create(relation="supersede", supersedes=A, impact="supersedes", other=B), "supersede create requires matching confidenceImpact"),
    (create(relation="supersede", supersedes=A, impact="supersedes", other=A), None), (create(relation="supersede", supersedes=C, impact="supersedes", other=C), f"{C} is already superseded"),
    (change("p", 0, "modify", C, operation="append_section", content="x", impact="superseded_by", other=A), f"{C} is already superseded"), (change("p", 0, "confidence_only", "page_zzzzzzzzzzzz"), "target page not found page_zzzzzzzzzzzz"),
    (change("p", 0, "modify", A, operation="replace_section", section="Four", content="x"), "target section not found Four"), (change("p", 0, "modify", A, operation="replace_section", content="x"), "target section not found undefined"),
    (change("p", 0, "modify", A, operation="replace_section", section="## two ", content="x"), None), (change("p", 0, "modify", A, content="x", impact="source_added", weight=1.5), "sourceWeight must be 0-1"),
    (change("p", 0, "modify", A, content="x", impact="source_added"), "sourceWeight must be 0-1"), (change("p", 0, "modify", A, content="x", impact="contradicted_by", severity="big"), "contradiction severity must be minor or major"),
    (change("p", 0, "modify", A, content="x", impact="superseded_by", other="x"), "invalid supersederPageId"), (change("p", 0, "modify", A, content="x", impact="else"), "unsupported confidenceImpact kind"),
    (change("p", 0, "modify", A, content=f"<!-- kb:derived source={A}:c0 -->"), None), (change("p", 0, "modify", A, content=f"<!-- kb:derived source={A}:c9,u0 -->"), f"unresolved derived source {A}:c9"),
]


def test_each_rule(spark):
    changes = [(f"p{k:02d}", *c[1:]) for k, (c, _) in enumerate(CASES) if c[2] != "create"]
    _, wrong, _ = frames(spark, changes, [("p23", "u0", A, [])])
    found = {}
    for r in wrong.collect():
        found.setdefault(r["patch_id"], set()).add(r["error"])
    assert found == {f"p{k:02d}": {e} for k, (c, e) in enumerate(CASES) if e and c[2] != "create"}
    # created pages one by one, as they would clash with each other
    rows = [(f"q{k:02d}", 0, "create", f"page_{k:012d}" if c[3] == NEW else c[3], *c[4:8], f"pages/{k}.md" if c[8] == "pages/new.md" else c[8], *c[9:]) for k, (c, _) in enumerate(CASES) if c[2] == "create"]
    _, wrong, _ = frames(spark, rows)
    found = {}
    for r in wrong.collect():
        found.setdefault(r["patch_id"], set()).add(r["error"])
    assert found == {f"q{k:02d}": {e} for k, (c, e) in enumerate(CASES) if e and c[2] == "create"}


def test_duplicates_units_and_all_or_nothing(spark):
    changes = [
        create("a", NEW), create("b", NEW, path="pages/other.md"), change("b", 1, "modify", B, operation="append_section", content="never"), create("c", "page_mmmmmmmmmmmm", path="pages/new.md"),
        change("good", 0, "modify", A, operation="insert_after_section", section="One", content=f"<!-- kb:derived source=u0,{A}:c1 -->\nadded\n\n"), change("good", 1, "modify", A, operation="replace_section", section="three", content="# Three\nchanged"),
        change("good", 2, "modify", B, operation="append_section", content="tail \n", impact="contradicted_by", severity="major"), change("good", 3, "confidence_only", C, relation="duplicate"),
        change("later", 0, "modify", A, operation="append_section", content="end"), create("s", "page_ssssssssssss", path=None, relation="supersede", supersedes=B, impact="supersedes", other=B, content="---\ntitle: S\n---\nbody"),
        change("units", 0, "modify", B, operation="append_section", content="never"),
    ]
    table, wrong, pages = frames(spark, changes, [UNIT, ("units", "u1", "what", [f"{A}:c77"])])
    assert {(r["patch_id"], r["n"], r["error"]) for r in wrong.collect()} == {
        ("b", 0, f"duplicate create page id {NEW}"), ("c", 0, "duplicate create path pages/new.md"), ("units", None, "invalid lineage sourcePageId"), ("units", None, f"unresolved lineage source {A}:c77"),
    }
    after = {r["page_id"]: r for r in patching.applied(table, wrong, pages).collect()}
    assert set(after) == {A, B, C, NEW, "page_ssssssssssss"}
    assert after[A]["content"] == f"---\ntitle: A\n---\n# One\nfirst\n## Two\nsecond\n\n<!-- kb:derived source=u0,{A}:c1 -->\nadded\n\n# Three\nchanged\n\nend" and after[A]["patches"] == ["good", "good", "later"]
    assert after[B]["content"] == "plain\n\ntail" and after[C]["content"] == "c" and after[C]["patches"] is None
    assert after[NEW]["content"] == f"---\nid: {NEW}\n---\nnew" and after["page_ssssssssssss"]["content"] == "---\nid: page_ssssssssssss\ntitle: S\n---\nbody"
    lines = {(r["patch_id"], r["page_id"], r["kind"], r["source_weight"], r["severity"], r["other"]) for r in patching.ledger_lines(table, wrong).collect()}
    assert lines == {("good", B, "contradicted_by", None, "major", None), ("good", C, "source_added", 0.7, None, None), ("s", "page_ssssssssssss", "supersedes", None, None, B), ("s", B, "superseded_by", None, None, "page_ssssssssssss")}


def find(lines, target):
    fence, start, level = "", -1, 0
    for k, line in enumerate(lines):
        if m := re.match(r"\s*(```+|~~~+)", line):
            fence = m[1] if not fence else "" if m[1][0] == fence[0] and len(m[1]) >= len(fence) else fence
        elif not fence and (m := re.match(r"(#{1,6})\s+(.+?)\s*$", line)):
            if start < 0:
                if re.sub(r"^#+\s*", "", m[2]).strip().lower() == target:
                    start, level = k, len(m[1])
            elif len(m[1]) <= level:
                return start, k
    return start, len(lines) if start >= 0 else -1


@pytest.mark.parametrize("seed", [0, 1])
def test_random_edits(spark, seed):
    r = random.Random(seed)
    rows, want = [], []
    for _ in range(150):
        body = "\n".join(r.choice(["# A", "## a ", "### B", "# B", "```", "````", "~~~", "text", "", "  ", "#no", " # x", "## # A"]) for _ in range(r.randint(0, 14)))
        name, op, content = r.choice(["a", "B ", "# a", "none"]), r.choice(["replace_section", "insert_after_section", "append_section"]), r.choice(["new\nlines \n\n", "x"])
        lines = body.split("\n")
        start, end = find(lines, re.sub(r"^#+\s*", "", name).strip().lower())
        has = start >= 0
        if op == "append_section":
            out = body.rstrip() + "\n\n" + content.rstrip()
        elif not has:
            continue
        elif op == "replace_section":
            out = "\n".join(lines[:start] + content.rstrip().split("\n") + lines[end:])
        else:
            before = lines[:end]
            while before and not before[-1].strip():
                before.pop()
            out = "\n".join([*before, "", *content.rstrip().split("\n"), "", *lines[end:]])
        rows.append((len(rows), body, op, name, content))
        want.append((out, has))
    table = spark.createDataFrame(rows, "k int, body string, op string, name string, content string")
    found = table.select("k", edited(F.col("body"), F.col("op"), F.col("name"), F.col("content")).alias("out"), has_section(F.col("body"), F.col("name")).alias("has")).orderBy("k").collect()
    assert [(x["out"], x["has"]) for x in found] == want


def test_errors_need_only_the_chunks_of_pages_that_patches_name(spark):
    from tessera.sources import tables

    sf = "/root/testdata/sf0.001"
    pages, (changes, units) = tables.vault(spark, sf), tables.patches(tables.table(spark, sf, "documents"))
    ids = patching.named_pages(changes, units)
    assert 0 < ids.count() < pages.count() / 5
    none = spark.createDataFrame([], "page_id string")
    some, whole = (chunks.chunks(p) for p in (pages.join(ids, "page_id", "left_semi"), pages))
    assert sorted(map(repr, patching.errors(changes, units, pages, some, none).collect())) == sorted(map(repr, patching.errors(changes, units, pages, whole, none).collect()))
