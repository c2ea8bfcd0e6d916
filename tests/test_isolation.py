"""The isolation forest against a walk in plain Python, and against planted outliers."""

import numpy as np

from tessera import catalog
from tessera.operators import isolation


def walk(tree, x):
    at = 0
    while tree.place[at] >= 0:
        at = tree.left[at] if x[tree.place[at]] < tree.cut[at] else tree.right[at]
    return tree.depth[at]


def test_trees():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(200, 4)), np.full((10, 4), 2.0)])
    tree = isolation.grow(x, rng)
    assert tree.depths(x).tolist() == [walk(tree, v) for v in x]
    inner = tree.place >= 0
    assert sorted([*tree.left[inner], *tree.right[inner]]) == list(range(1, len(tree.place)))
    flat = isolation.grow(np.ones((50, 3)), rng)
    assert len(flat.place) == 1 and flat.depths(np.ones((2, 3))).tolist() == [isolation.average_depth(50)] * 2
    assert isolation.average_depth(1) == 0 and isolation.average_depth(2) == 1 and 10 < isolation.average_depth(256) < 10.5


def test_planted_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(950, 8)), rng.normal(size=(50, 8)) * 0.3 + rng.choice([-9, 9], size=(50, 8))])
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(5000, None, "s")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = {r.vec_id: r for r in isolation.isolation_outliers(table.repartition(7), 0.05).collect()}
    again = {r.vec_id: r for r in isolation.isolation_outliers(table.repartition(2), 0.05).collect()}
    assert found == again and set(found) == set(range(1000))
    assert {i for i, r in found.items() if r.is_outlier} == set(range(950, 1000))
    scores = np.array([found[i].score for i in range(1000)])
    assert scores[950:].min() > scores[:950].max() and [r.is_outlier for r in found.values()] == [r.score > np.percentile(scores, 95) for r in found.values()]
    assert isolation.isolation_outliers(table.limit(0)).count() == 0 and isolation.isolation_outliers(table.where("vec_id = 1")).count() == 1


def test_query(spark):
    found = catalog.QUERIES["vec_isolation"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count() and 20 <= sum(r.is_outlier for r in found) <= 30
