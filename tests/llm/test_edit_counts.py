import random

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import edit_counts
from tessera.llm.encoder import Encoder
from tessera.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
COUNT = Tokenizer.from_file(PATH)


def count(text):
    return len(COUNT.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for a, b, s in edits:
        a = min(max(0, a), len(text))
        text = text[:a] + s + text[max(a, b) :]
    return text


def test_recount_equals_full_encoding(spark):
    r = random.Random(8)
    pieces = ["hello", "World's", "é", "x" * 40, " ", "\n", "  ", "12", ",", "naïve", "…", "é", "<|endoftext|>", "<|", "endoftext", "|>", "İ"]
    make = lambda n: "".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(n))
    rows = [(None, "null key", [(0, 4, "no")]), (0, None, None), (1, "", [(0, 0, "a b")]), (2, "abc", [(5, 1, "d")]), (3, "abc", None), (3, "abc", None), (4, "word " * 200_000, [(500_000, 500_003, "é")])]
    rows += [(5, " \n ", [(1, 2, "x")]), (6, "<|endof text|>", [(7, 8, "")]), (7, "a", [(-3, -1, "b")])]
    for i in range(8, 160):
        t = make(r.choice([1, 5, 60, 400]))
        edits, now = [], t
        for _ in range(r.randrange(6)):
            a = r.randrange(len(now) + 1)
            edits.append((a, min(len(now), a + r.choice([0, 0, 1, 30, 300])), make(r.choice([0, 1, 3, 90]))))
            now = edited(now, edits[-1:])
        rows.append((i, t, edits))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, n_tokens int")
    expected = sorted(((i, count(t or ""), len(e or ()), count(new), len(new.encode())) for i, t, e in rows for new in [edited(t or "", e or ())]), key=repr)
    assert sorted((tuple(x)[:5] for x in edit_counts.recount(docs, PATH).collect()), key=repr) == expected
    assert edit_counts.recount(docs.limit(0), PATH).collect() == []
    odd = spark.createDataFrame([(1, "abc", [None])], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    assert [tuple(x) for x in edit_counts.recount(odd, PATH).collect()] == [(1, count("abc"), 1, count("abc"), 3, 0)]


def test_trees_nest_and_are_laid_out_anew():
    r = random.Random(3)
    encoder = Encoder.shared(PATH)
    for text in ("", "some words of a text " * 50):
        edits, now = [], text
        for k in range(400):
            a = r.choice([len(now), len(now) // 2, min(3, len(now)), r.randrange(len(now) + 1)]) if k % 3 else len(now)
            edits.append((a, a + r.choice([0, 0, 2, 40]), r.choice(["typed ", "é, ", "many words at once " * 20, ""])))
            now = edited(now, edits[-1:])
        own = edit_counts.trees(encoder, *edit_counts.joined([text.encode()]))
        edit_counts.apply_edits(encoder, own, [[(a, b, s.encode()) for a, b, s in edits]])
        assert own[0].text() == now.encode()
        assert own[0].total == (len(now), len(now.encode()), count(now))


def test_only_the_touched_region_is_encoded_again():
    encoder = Encoder.shared(PATH)
    text = ("plain words that stand here " * 4000).encode()
    own = edit_counts.trees(encoder, *edit_counts.joined([text]))
    again = edit_counts.apply_edits(encoder, own, [[(60_000, 60_003, b"new "), (10, 10, b"x"), (100_000, 100_001, b"")]])
    assert again[0] < 100


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    found = {x["doc_id"]: x for x in QUERIES["op6_edit_counts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        t = text or ""
        n = len(t)
        new = edited(t, [(n // 2, n // 2, " a revised passage "), (n // 4, min(n, int(n / 4 + 20)), ""), (n * 3 // 4, min(n, int(n * 3 / 4 + 1)), "\n")])
        assert tuple(found[doc_id])[:5] == (doc_id, count(t), 3, count(new), len(new.encode()))
