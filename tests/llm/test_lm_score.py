import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_score
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def words(t):
    return "".join(c.lower() if c.isascii() else c for c in (t or "")).split() + [None]


def rows_of(n=120):
    r = random.Random(2)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = [(0, None), (1, ""), (2, "Ünknown ünknown"), (3, " \t ")]
    return rows + [(i, " ".join(r.choice(vocabulary).upper() if r.random() < 0.1 else r.choice(vocabulary) for _ in range(r.randrange(1, 90)))) for i in range(4, n)]


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in lm_score.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()}


def kept(c):
    return float(lm_score.TYPICAL[lm_score.level(np.array([c]))[0]]) if c else 0.0


class Brute:
    """The model by exact counts, without a filter."""

    def __init__(self, rows):
        train = [t for i, t in rows if fold(i)]
        self.one = Counter(w for t in train for w in words(t))
        self.two = Counter(p for t in train for p in zip(["<s>", *words(t)], words(t)))
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.sum, self.types = Counter(), Counter()
        for (h, _), c in self.two.items():
            self.sum[h] += kept(c)
            self.types[h] += 1

    def base(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def p(self, h, w):
        force = lm_score.FORCE * self.types[h]
        return (kept(self.two[h, w]) + force * self.base(w)) / (self.sum[h] + force) if force else self.base(w)

    def check(self, found, rows):
        off = []
        for i, t in rows:
            w, r = words(t), found[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(self.one[x] > 0 for x in w), self.n, not fold(i))
            assert math.isclose(r["base_score"], sum(math.log10(self.base(x)) for x in w), abs_tol=1e-7)
            off.append(abs(r["score"] - sum(math.log10(self.p(h, x)) for h, x in zip(["<s>", *w], w))) / len(w))
            assert r["score"] <= 0
        assert sorted(off)[len(off) // 2] < 1e-3 and sum(off) / len(off) < 0.01


@pytest.mark.parametrize(("part", "hot"), [(12 << 20, 500), (600, 500), (600, 3)])
def test_scores_against_exact_counts(spark, monkeypatch, part, hot):
    monkeypatch.setattr(lm_score, "PART_BYTES", part)
    monkeypatch.setattr(lm_score, "HOT", hot)
    rows = rows_of()
    found = run(spark, rows)
    assert len(found) == len(rows)
    Brute(rows).check(found, rows)


def test_probabilities_after_a_word_sum_to_one():
    model = Brute(rows_of())
    for h in [*list(model.types)[:40], "never seen"]:
        assert math.isclose(sum(model.p(h, w) for w in [*model.one, "unknown"]), 1, abs_tol=1e-9)


def test_filter_gives_levels_back():
    r = np.random.default_rng(3)
    keys, counts = r.integers(0, 1 << 63, 20_000).astype(np.uint64), r.geometric(0.3, 20_000) ** 3
    f = lm_score.Filter(keys, lm_score.level(counts))
    found = f.levels(keys)
    assert (found >= lm_score.level(counts)).all() and (found != lm_score.level(counts)).mean() < 0.005
    assert (f.levels(r.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.005


def test_registered_query_equals_exact_counts_and_beats_the_base(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in QUERIES["op8_lm_score"](spark, SF).collect()}
    Brute(rows).check(found, rows)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] > r["base_score"] for r in held) > 0.85 * len(held)


def test_empty_table_and_odd_rows(spark):
    assert run(spark, [(2, None)])[2]["n_tokens"] == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(empty, F.lit(True)).collect() == []
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, "c", 5, "x"), (4, "long words " * 60_000, 5, "x")], "doc_id long, text string, part int, payload string")
    found = lm_score.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"]) for r in found if r["doc_id"]) == [(1, not fold(1), 3), (1, not fold(1), 3), (4, not fold(4), 120_001)]
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [True]
    nothing = lm_score.score(docs, F.lit(False)).collect()
    assert all(r["score"] == r["base_score"] and r["train_tokens"] == 0 and r["held_out"] for r in nothing)
