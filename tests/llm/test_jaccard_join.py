import random

import numpy as np
import pyarrow as pa

from tessera.llm import jaccard_join, suffix_dedup
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_clusters(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {(i, len(sets[i]), top(i)) for i in ids}


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 8, 12, 40, 120, 400]))] for _ in range(n // 4)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "Ünï one two three four"), (6, "Ünï one two three four")]
    for i in range(7, n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    return rows


def test_clusters_equal_brute_force(spark, monkeypatch):
    rows = corpus(260, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_clusters(rows)
    assert {tuple(r) for r in jaccard_join.clusters(docs).collect()} == expected
    for chunk in (500, 60):  # groups of several chunks: stand-ins, then what lies outside the largest partition
        monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
        assert {tuple(r) for r in jaccard_join.clusters(docs).collect()} == expected


def test_registered_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op7_jaccard_join"](spark, SF)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect())) == sorted(brute_clusters(rows))


def test_keys_that_repeat_null_keys_long_texts_and_clashing_columns(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    long = "x y z " * 40_000
    rows = [(1, a), (1, b), (2, a + " "), (3, b), (None, b), (None, "alone on its own here"), (4, long), (5, long + "end"), (6, long.upper()), (7, None)]
    docs = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "doc_id long, text string, gone int, class int, t string")
    found = sorted((tuple(r) for r in jaccard_join.clusters(docs).collect()), key=repr)
    assert found == sorted([(1, 5, 1), (1, 5, 1), (2, 5, 1), (3, 5, 1), (None, 5, 1), (None, 2, None), (4, 3, 4), (5, 4, 5), (6, 3, 4), (7, 0, 7)], key=repr)
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 1, None, None, 4, 5, 7], key=repr)


def test_matrix_equals_comparing_all_pairs():
    r = random.Random(4)
    base = [r.sample(range(5000), r.choice([1, 2, 5, 30, 90])) for _ in range(12)]
    sets = []
    for _ in range(150):
        s = set(r.choice(base))
        for _ in range(r.randrange(4)):
            s.add(r.randrange(5000))
        sets.append(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sets = [np.sort(s) for s in sets]
    groups = jaccard_join.TokenGroups(85)
    for s in sets:
        groups.add(s)
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if jaccard_join.links(sets[a], sets[b], 85):
                x, y = sorted((root[a], root[b]))
                root = [x if k == y else k for k in root]
    assert dict(groups.forest(list(range(len(sets))))) == dict(enumerate(root))


def test_empty_table_and_kept_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.clusters(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e", 7), (2, "A b c d e", 8), (3, None, 9)], "doc_id long, text string, n long")
    assert sorted(tuple(r) for r in jaccard_join.drop_near_duplicates(docs).collect()) == [(1, "a b c d e", 7), (3, None, 9)]


def test_suffix_dedup_equals_brute_force(spark):
    r = random.Random(5)
    passages = ["".join(r.choice("abcdefé ") for _ in range(k)) for k in (49, 50, 51, 60, 130, 400)]
    rows = [(0, None), (1, ""), (2, "x" * 300), (3, "x" * 80), (4, "short")]
    for i in range(5, 90):
        rows.append((i, "".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(40))) for _ in range(4))))
    rows.append((90, rows[20][1]))
    first, expected = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        expected[i] = (len(b), sum(gone), len(gone.decode("latin1").replace("\0", " ").split()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in suffix_dedup.report(docs).collect()} == expected


def test_texts_that_only_share_passages_are_in_no_group(spark, monkeypatch):
    """A passage that many texts have makes up .6 of each; links ask for .8."""
    r = random.Random(8)
    fresh = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(124) for _ in range(2)]
    rows = [(i, " ".join(passages[i % 2] + fresh(80))) for i in range(60)]
    alone = fresh(184)
    rows += [(60, " ".join(alone)), (61, " ".join(alone[:170] + fresh(14))), (62, " ".join(passages[0] + fresh(20))), (63, " ".join(passages[0] + fresh(20)))]
    seen, linked = [], jaccard_join._linked

    def spied(likely, groups, *rest):
        seen.append(groups.count())
        return linked(likely, groups, *rest)

    monkeypatch.setattr(jaccard_join, "_linked", spied)
    found = jaccard_join.clusters(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=80)
    assert {x["doc_id"]: x["component_id"] for x in found.collect() if x["doc_id"] != x["component_id"]} == {61: 60}
    assert seen[0] <= 4  # before, all 64: each has a part in common with some other


def test_rows_of_counts_do_not_follow_classes_times_tasks(spark):
    """What tasks count for a class is packed: rows follow the tasks."""
    rows = [(0, c, c, True, 8, " ".join(f"w{k}" for k in range(60)) + f" own{c}") for c in range(1, 301)]
    frame = spark.createDataFrame(rows, "root long, part long, class long, minor boolean, spread int, t string")
    got = {x["class"]: x["overlap"] for x in jaccard_join._overlaps(frame, 4, 8).collect()}
    assert got == {c: 57 for c in range(1, 301)}
    sent = spark.createDataFrame([(t, p) for t, p in zip(*jaccard_join._tallies(np.arange(-150, 150), np.full(300, 5), 8), strict=True)], "task int, payload binary")
    assert sent.count() == 8
    assert {tuple(x) for x in jaccard_join._totals(sent.unionByName(sent), 8).collect()} == {(c, 10) for c in range(-150, 150)}


def test_linked_sets_have_as_many_parts_in_common_as_they_need():
    r = np.random.default_rng(9)
    for percent in (80, 85):
        for n in [1, 2, 3, 5, 8, 9, 13, 40, 150, 700]:
            for _ in range(30):
                a = r.integers(0, 1 << 63, n, dtype=np.uint64)
                cut, more = int(r.integers(0, n // 5 + 1)), int(r.integers(0, n // 5 + 2))
                a, b = np.unique(a), np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 63, more, dtype=np.uint64)]))
                if not jaccard_join.links(a, b, percent):
                    continue
                sig, of, later, need = jaccard_join.part_hashes([a, b], percent)
                for me in (0, 1):
                    met = np.isin(sig, sig[of != me]) & (of == me)
                    assert any(np.count_nonzero(met & (later == bool(k))) >= int(need[me]) >> (32 * k) & 0xFFFFFFFF for k in (0, 1))


def test_linked_sets_have_as_much_of_their_heads_in_common_as_they_need():
    r = np.random.default_rng(10)
    for percent in (50, 80, 85):
        for n in [1, 2, 3, 5, 8, 9, 13, 40, 150, 700]:
            for _ in range(30):
                a = r.integers(0, 1 << 63, n, dtype=np.uint64)
                cut, more = int(r.integers(0, n // 5 + 1)), int(r.integers(0, n // 5 + 2))
                a, b = np.unique(a), np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 63, more, dtype=np.uint64)]))
                if not jaccard_join.links(a, b, percent):
                    continue
                head, need = jaccard_join.heads(np.array([len(a), len(b)]), percent)
                assert len(np.intersect1d(a[: head[0]], b[: head[1]])) >= max(need) and (need >= 1).all()


def test_classes_that_travel_as_one_are_compared(spark):
    """A class travels as half its number: two that share this half, and of which each is all that the other links with, meet."""
    base = [f"b{k}" for k in range(12)]
    rows = [" ".join([*base, f"x{k}"]) for k in range(400_000)]
    met = {}
    for at in range(0, len(rows), 5000):
        sets = [s for found in jaccard_join.shingle_sets(pa.array(rows[at : at + 5000])) for s in found]
        for k, s in enumerate(sets, at):
            half = jaccard_join.number(s)[0] & 0xFFFFFFFF
            if half in met:
                break
            met[half] = k
        else:
            continue
        break
    pair = [rows[met[half]], rows[k]]
    docs = spark.createDataFrame([(1, pair[0] + " " + pair[0]), (2, pair[0]), (3, pair[1])], "doc_id long, text string")
    assert {(x["doc_id"], x["component_id"]) for x in jaccard_join.clusters(docs, percent=80).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert {(x["doc_id"], x["component_id"]) for x in jaccard_join.clusters(docs.where("doc_id > 1"), percent=80).collect()} == {(2, 2), (3, 2)}


def _written(spark):
    """Bytes of all shuffles so far."""
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_what_a_shingle_sends_does_not_grow_with_the_tasks(spark):
    r = random.Random(11)
    rows = [(i, " ".join(f"x{r.randrange(10**9)}" for _ in range(1503))) for i in range(300)]
    narrow = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    before = _written(spark)
    described = jaccard_join._described(narrow, 4, 80, 0, 200)
    assert described.where("n = 1500").count() == 300
    assert _written(spark) - before < 3.5 * 1500 * 300  # 6.5 bytes a shingle when parts travelled with whole classes


def test_blocks_come_in_rounds(spark, monkeypatch):
    """Texts of two common passages and words of their own, which all reach the bound on the others together: blocks are compared some at a time."""
    r = random.Random(12)
    pool = [[f"p{k}_{j}" for j in range(30)] for k in range(12)]
    rows = [(i, " ".join(w for k in sorted(r.sample(range(12), 6)) for w in pool[k])) for i in range(90)]
    rows += [(90 + i, rows[i][1] + f" end{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, compared = [], jaccard_join._compared

    def spied(sent, by, *rest):
        if by == ["root", "slice", "block"]:
            sizes.append((sent.count(), sent.select("class").distinct().count()))
        return compared(sent, by, *rest)

    monkeypatch.setattr(jaccard_join, "_compared", spied)
    monkeypatch.setattr(jaccard_join, "CHUNK", 300)
    assert {tuple(x) for x in jaccard_join.clusters(docs).collect()} == brute_clusters(rows)
    assert len(sizes) > 1 and max(n for n, _ in sizes) < 9 * max(m for _, m in sizes)
