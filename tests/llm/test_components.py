import numpy as np
import pytest

from tessera.llm import common


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_components_equal_union_find(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_LINKS", local)
    r = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (220, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    want = sorted((x, find(x)) for x in root if find(x) != x)
    found = common.components(spark.createDataFrame(links, "a long, b long").repartition(3), "a", "b").collect()
    assert sorted(map(tuple, found)) == want
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
