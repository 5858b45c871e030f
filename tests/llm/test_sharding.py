import random
import zlib
from collections import Counter, defaultdict

from tessera.llm import sharding
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def check(rows, found, n):
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((k, size(t), zlib.crc32((t or "").encode())) for k, t in rows)
    slots, load = defaultdict(list), Counter()
    for r in found:
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_query_keeps_groups_whole_and_sizes_near_equal(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op3_sharding"](spark, sf).collect()
    load = check(rows, found, 40)
    text = dict(rows)
    where = defaultdict(set)
    for r in found:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    total = sum(load.values())
    biggest = Counter()
    for _, t in rows:
        biggest[t] += len((t or "").encode()) + 16
    assert max(load.values()) <= max(1.02 * total / 40, max(biggest.values()))
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_edge_cases(spark):
    r = random.Random(1)
    rows = [(0, None), (1, None), (2, ""), (2, ""), (None, "null key"), (3, "é" * 50_000), (4, "x" * 70_001)]
    rows += [(100 + k, "copy of a text") for k in range(3000)]  # 90,000 bytes
    rows += [(10_000 + k, "y" * r.randrange(300)) for k in range(500)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, shard int, slot int")
    found = sharding.shards(docs, 10).collect()
    check(rows, found, 10)
    # a group of more bytes than a share is cut; all others are whole
    where = defaultdict(set)
    text = dict(rows)
    for x in found:
        where[text[x["doc_id"]]].add(x["shard"])
        assert x["group_split"] == (x["doc_id"] is not None and 100 <= x["doc_id"] < 3100)
    assert all(len(s) == 1 for t, s in where.items() if t != "copy of a text")
    assert sharding.shards(docs.limit(0), 10).collect() == []
    one = sharding.shards(docs.where("doc_id = 3"), 4).collect()
    assert [(x["doc_id"], x["slot"]) for x in one] == [(3, 0)]


def test_large_group_of_copies_is_dealt_evenly(spark):
    rows = [(k, "a much repeated text") for k in range(4000)] + [(5000 + k, f"text {k}") for k in range(4000)]
    load = check(rows, sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), 8)
    assert max(load.values()) <= 1.02 * sum(load.values()) / 8


def naive(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= s]
        if fits:
            k = min(fits, key=lambda k: bins[k])
            bins[k] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_best_fit_equals_the_naive_packer():
    r = random.Random(3)
    for _ in range(60):
        sizes = [r.choice([1, 2, 3, 5, 8, 13, 30, 47]) for _ in range(r.randrange(1, 80))]
        classes = sorted(Counter(sizes).items(), reverse=True)
        runs = sharding.best_fit(classes, 50)
        load, count = Counter(), Counter()
        for (size, n), placed in zip(classes, runs, strict=True):
            assert sum(k for _, k in placed) == n
            for b, k in placed:
                load[b] += size * k
                count[b] += k
        assert sorted(50 - x for x in load.values()) == naive(sizes, 50)
