import random
import zlib

import numpy as np
import pytest

from tessera.llm import repair
from tessera.llm.queries import QUERIES, _tokenizer

SF = "/root/testdata/sf0.001"


def brute(rows, file="word_bpe_49k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_tokenizer(file))
    out, before = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_whole_text_encoding(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op2_repair"](spark, sf)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_edge_cases(spark, monkeypatch):
    r = random.Random(4)
    odd = ["Straße", "İstanbul", "ÉCOLE", "été", "don't", "a.b", "x...", "<s>", "</s>", "<unk>", "ﬁn", "日本語", "a b", "a b", "tab\tx", "​", "Ω", "ſ", "3.14!", "ABC,,", "q\0r", "😀ok", "’s", "ǅ", "\x1c", "a\x1db", "\x85", "K"]
    rows = [(None, "null key"), (0, None), (1, ""), (2, " \n\t "), (3, "same"), (3, "same"), (-5, "before zero"), (4, "ab " * 20_000)]
    rows += [(10 + k, " ".join(r.choice(odd) for _ in range(40))) for k in range(40)]
    rows += [(100 + k, "".join(r.choice(odd) for _ in range(40))) for k in range(40)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, start int, n_tokens int")
    expected = brute(rows)
    for held in (repair.SHARD_TOKENS, 100):
        monkeypatch.setattr(repair, "SHARD_TOKENS", held)
        assert sorted(map(tuple, repair.round_trip(docs, _tokenizer("word_bpe_49k.json")).collect()), key=repr) == expected
    assert repair.round_trip(docs.limit(0), _tokenizer("word_bpe_49k.json")).collect() == []
    # a file of another kind sees texts whole
    assert sorted(map(tuple, repair.round_trip(docs, _tokenizer("byte_bpe_50k.json")).collect()), key=repr) == brute(rows, "byte_bpe_50k.json")


def test_pairs_are_replaced_until_none_is_frequent():
    r = np.random.default_rng(2)
    for ids in (np.tile(r.integers(0, 50_000, 300), 400), r.integers(0, 40, 60_000), np.zeros(5000, int)):
        terminals, rules, lengths, seq, per = repair.compress(ids.astype(np.uint32), np.array([len(ids)]))
        pairs = np.stack([seq[:-1], seq[1:]], 1)
        assert len(pairs) == 0 or np.unique(pairs, axis=0, return_counts=True)[1].max() < 2 * repair.LEAST
        assert per.tolist() == [len(seq)]
    assert lengths.max() > 100


def test_grammar_expands_to_its_input_and_at_random_places():
    r = np.random.default_rng(1)
    for sizes in ([0, 1, 5, 0], [5000, 0, 3000, 1], [4000]):
        phrases = [r.integers(0, 60_000, 7) for _ in range(9)]
        n = sum(sizes)
        ids = np.concatenate([phrases[k] for k in r.integers(0, 9, n // 7 + 1)])[:n] if n else np.zeros(0, int)
        shard = repair.Shard(repair.pack(list(range(len(sizes))), ids.astype(np.uint32), np.array(sizes)))
        assert shard.tokens().tolist() == ids.tolist()
        assert shard.sizes.tolist() == sizes
        if n > 1000:
            assert len(shard.rules) and len(shard.symbols) < n / 2
        for a, b in r.integers(0, n + 1, (50, 2)).tolist():
            assert shard.span(a, b).tolist() == ids[a:b].tolist()
