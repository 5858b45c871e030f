import random
import zlib

import numpy as np

from tessera.llm import wfst
from tessera.llm.queries import QUERIES, _tokenizer

SF = "/root/testdata/sf0.001"
MODEL = "piece_bpe_32k.model"


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=_tokenizer(MODEL))


def brute(rows):
    p = library()
    out = []
    for key, text in rows:
        ids = p.encode(text or "")
        back = p.decode(ids)
        out.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(back.encode()), back == (text or "")))
    return sorted(out, key=repr)


def test_query_equals_the_library(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op4_sentencepiece"](spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_edge_cases_equal_the_library(spark):
    r = random.Random(8)
    odd = ["Straße", "ÉCOLE", "don't", "  ", "   two", "a  b", "▁", "x▁y", "日本語", "\t", "\n", "\n\n", "<s>", "</s>", "<unk>", "<0x41>", "😀", "aaaaaaa", "tokenisation", "1234567", "https://x.y/z?a=b", "​", "\r\n", "ﬁ", "é", "\U0010ffff", "_", "__", "==="]
    rows = [(0, None), (1, ""), (2, " "), (3, "    "), (4, "same"), (4, "same"), (None, "null key"), (5, " lead"), (6, "trail "), (7, "word " * 30_000), (8, "q" * 3000)]
    rows += [(100 + k, " ".join(r.choice(odd) for _ in range(25))) for k in range(80)]
    rows += [(300 + k, "".join(r.choice(odd) for _ in range(25))) for k in range(80)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n_tokens int, ids_crc32 int")
    assert sorted(map(tuple, wfst.encode(docs, _tokenizer(MODEL)).collect()), key=repr) == brute(rows)
    assert wfst.encode(docs.limit(0), _tokenizer(MODEL)).collect() == []
    p = library()
    kept = wfst.with_tokens(docs, _tokenizer(MODEL)).collect()
    assert sorted(((x["doc_id"], x["text"], x["token_ids"]) for x in kept), key=repr) == sorted(((k, None if t is None else p.decode(p.encode(t)), p.encode(t or "")) for k, t in rows), key=repr)
