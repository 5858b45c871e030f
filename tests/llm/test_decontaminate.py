import hashlib
import random
import re

from tessera.llm import decontaminate
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, size=13, parts=20):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for k in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, len(hit) > 0 and parts * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = QUERIES["op1_decontaminate"](spark, SF)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items)


def cases():
    r = random.Random(2)
    vocabulary = ["a", "B", "7", "é", "Éa", "zz", "x1"]
    items = [(1, " ".join(r.choice(vocabulary) for _ in range(30))), (2, "one two"), (2, "three four"), (10, "ONE, two"), (3, None), (4, ""), (5, "?!"), (None, "lost words"), (6, "a " * 13), (7, " ".join(f"w{k}" for k in range(13)))]
    docs = [(0, None), (1, ""), (2, "!! --"), (3, "One-two one two three"), (4, "one twox"), (5, "three; FOUR"), (6, items[0][1] + " tail"), (7, "a " * 5000), (8, "lost words"), (8, "lost words"), (None, "one two"), (9, " ".join(f"w{k}" for k in range(12)))]
    docs += [(20 + k, " ".join(r.choice(vocabulary) for _ in range(200))) for k in range(20)]
    docs += [(50, "w0 w1 " + " ".join(f"w{k}" for k in range(13)) + " pad" * 245), (51, " ".join(f"w{k}" for k in range(13)) + " pad" * 247), (52, " ".join(f"w{k}" for k in range(13)) + " pad" * 248)]
    return docs, items


def test_edge_cases_equal_brute_force(spark, monkeypatch):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words_held, block in ((decontaminate.SHARD_WORDS, decontaminate.BLOCK_BYTES), (50, 40)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", words_held)
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        assert sorted(map(tuple, decontaminate.report(d, b).drop("spans").collect()), key=repr) == brute(docs, items)


def test_spans_and_kept_rows(spark):
    d = spark.createDataFrame([(1, "é ONE, two.", 3), (2, "clean", 4), (3, None, 5)], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in decontaminate.report(d, b).collect()}
    assert spans == {1: [(3, 11)], 2: [], 3: []}
    assert sorted(map(tuple, decontaminate.drop_contaminated(d, b).collect())) == [(2, "clean", 4), (3, None, 5)]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.report(d, b).collect()] == [(1, 3, 0, 0)]
    assert decontaminate.report(spark.createDataFrame([], d.schema), b).collect() == []
