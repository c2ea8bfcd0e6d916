"""Every query of the catalog that SQL can say gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from tessera import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


#: Queries that SQL cannot say; test_plain_queries.py, test_neighbours.py, test_isolation.py and test_plans.py hold each against a plain version or against what must hold of it.
PLAIN = {"vec_kmeans", "vec_pca", "vec_ivf_recall", "vec_pq_topk", "vec_pq_recall", "chunk_recursive_lateral", "multi_hop", "vec_isolation", "chunk_recursive", "chunk_adaptive", "augment_swap", "rouge_of_turns"}


def test_every_query_is_held_against_something():
    assert set(catalog.QUERIES) - set(catalog.SQL) == PLAIN


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows, columns = df.collect(), df.columns
    found = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)
    want = sorted((tuple(plain(r[found.columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert got == want
