import numpy as np

from tessera.llm import cross_polytope


def brute(rows):
    unit = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[k] = x / np.linalg.norm(x)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                n[a] += 1
                n[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {(i, n[k], rows[top(k)][0], rows[top(k)][0] == i) for k, (i, _) in enumerate(rows)}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(0, None), (1, []), (2, [0.0] * 64), (3, [float("nan")] * 64), (4, [1.0, None])]
    centres = r.normal(size=(60, 64))
    for i in range(5, 400):
        v = centres[int(r.integers(60)) if i % 3 else 0] + r.normal(size=64) * r.choice([0.0, 0.02, 0.1, 0.15])
        rows.append((i, v.astype(np.float32).tolist()))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected = brute(rows)
    assert {tuple(x) for x in cross_polytope.near_duplicates(docs).collect()} == expected
    monkeypatch.setattr(cross_polytope, "BLOCK", 8)
    assert {tuple(x) for x in cross_polytope.near_duplicates(docs).collect()} == expected
    assert cross_polytope.near_duplicates(docs.limit(0)).collect() == []


def test_pairs_that_share_no_bucket_are_linked(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = []
    for k in range(0, 600, 2):
        x, y = np.linalg.qr(r.normal(size=(64, 2)))[0].T
        rows += [(k, x.tolist()), (k + 1, (0.951 * x + np.sqrt(1 - 0.951**2) * y).tolist())]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = brute(rows)
    assert sum(x[1] for x in expected) == 600
    assert {tuple(x) for x in cross_polytope.near_duplicates(docs).collect()} == expected
    monkeypatch.setattr(cross_polytope, "EXACT", 64 * 8 * 50)
    monkeypatch.setattr(cross_polytope, "TABLES", 1)
    assert {tuple(x) for x in cross_polytope.near_duplicates(docs).collect()} == expected


def test_chains_stay_whole(spark):
    """Every link of a bucket counts, not only a vector's link to its least neighbour."""
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(120)
        rows = sorted((int(i), [float(np.cos(k * 0.05)), float(np.sin(k * 0.05)), 0.0, 0.0]) for k, i in enumerate(order))
        docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert {tuple(x) for x in cross_polytope.near_duplicates(docs).collect()} == brute(rows)
