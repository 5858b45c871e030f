"""Every registered query against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda x: (None if math.isnan(x) else round(x, 9)) if isinstance(x, float) else x
    return [columns[k] for k in order], sorted((tuple(clean(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = db.sql(registry.ORACLES[name])
    expected = canonical(want.columns, want.fetchall())
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1])
    assert found[1] == expected[1]
