import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    for n in (3, 5, 7, 10):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, seen, twice, again = Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            if counts[g] > 1:
                twice.update(range(i, i + n))
            if g in seen:
                again.update(range(i, i + n))
            seen.add(g)
        if n == 3:
            out["n_repeat_words"] = len(twice)
        else:
            out[f"dup{n}_chars"] = sum(len(words[i]) for i in again)
    seen, out["n_dup_lines"], out["dup_line_chars"] = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line) and line in seen:
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += sum(map(len, WORD.findall(line)))
        seen.add(line)
    out["base_failed"] = out["n_words"] < 50 or 100 * out["n_repeat_words"] > 50 * out["n_words"]
    small = all(100 * out[f"dup{n}_chars"] <= most * out["word_chars"] for n, most in ((5, 15), (7, 13), (10, 10)))
    out["kept"] = not out["base_failed"] and small and 100 * out["dup_line_chars"] <= 20 * out["word_chars"] and 100 * out["n_symbols"] <= 10 * out["n_words"]
    return out


def odd_texts():
    r = np.random.default_rng(3)
    prose = lambda n, kinds=400: " ".join(f"w{k}é" for k in r.integers(0, kinds, n))
    line = prose(12)
    return [
        None, "", " \n\t\n ", "one", "a\nb\na\nb \na", "\n\nx\n\nx\n", "x\r\nx\r\nx", prose(60), prose(300), f"{prose(200)}\n{line}\n{prose(100)}\n{line}\n", (prose(7) + " ") * 20, (line + "\n") * 30,
        prose(100) + " # * $ % & | < >" * 3, "日本語 " * 60, "A b " * 30 + "a B " * 30, prose(40_000, 9000), "longword" * 300_000, prose(49), prose(50), "x\x0bx\x0cx\x85x x " * 12, prose(500, 12),
    ]


def test_odd_rows_equal_brute_force(spark):
    texts = odd_texts()
    rows = [(i if i % 7 else None, t, 1.5, "z") for i, t in enumerate(texts)] + [(900, texts[9], 0.0, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept double, n_words string")
    found = sorted(map(tuple, rules.report(docs).collect()), key=repr)
    names = ["doc_id", *rules.COLUMNS, "base_failed", "kept"]
    want = sorted(((k, *[(b := brute(t))[c] for c in names[1:]]) for k, t, _, _ in rows), key=repr)
    assert rules.report(docs).columns == names
    assert found == want
    assert {x[-1] for x in found} == {True, False}
    good = rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(x[-1] for x in want)
    assert rules.report(docs.limit(0)).collect() == [] and rules.keep_good(docs.limit(0)).collect() == []


@pytest.mark.parametrize("step, block", [(7, 50), (64, 1000), (1 << 20, 1 << 22)])
def test_pieces_and_blocks_change_nothing(monkeypatch, step, block):
    texts = [t for t in odd_texts() if t is None or len(t) < 20_000]
    monkeypatch.setattr(rules, "STEP", step)
    monkeypatch.setattr(rules, "BLOCK", block)
    monkeypatch.setattr(rules.Hasher, "up", rules._powers(rules._FACTOR, step))
    monkeypatch.setattr(rules.Hasher, "down", rules._powers(rules._INVERSE, step))
    found = rules.measured(pa.array(texts, pa.string()))
    assert found.tolist() == [[brute(t)[c] for c in rules.COLUMNS] for t in texts]


def test_whole_table_equals_brute_force(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = QUERIES["op12_repetition_rules"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        assert {c: r[c] for c in r.asDict() if c != "doc_id"} == brute(texts[r["doc_id"]])
