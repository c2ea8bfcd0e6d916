"""Queries that SQL cannot say, against plain versions or against what must hold of their results."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera import catalog
from tessera.operators import metrics

SF = "/root/testdata/sf0.001"


def read(name, *columns):
    return pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pydict()


@pytest.fixture(scope="module")
def vectors():
    t = read("embeddings", "vec_id", "embedding")
    return np.array(t["vec_id"]), np.array(t["embedding"], dtype=float)


def test_kmeans(spark, vectors):
    from tessera.operators import embeddings

    ids, x = vectors
    rows = embeddings.kmeans(spark.read.parquet(f"{SF}/embeddings.parquet"), 8).select("vec_id", "cluster").collect()
    cluster = np.array([dict((r.vec_id, r.cluster) for r in rows)[i] for i in ids])
    counts = {r.cluster: r.n for r in catalog.vec_kmeans(spark, SF).collect()}
    assert counts == {int(c): int((cluster == c).sum()) for c in set(cluster)} and sum(counts.values()) == len(ids)
    centres = {c: x[cluster == c].mean(axis=0) for c in counts}
    near = [min(centres, key=lambda c: ((v - centres[c]) ** 2).sum()) for v in x]
    assert np.mean(np.array(near) == cluster) > 0.9
    spread = lambda labels: sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels))
    assert spread(cluster) < 0.97 * spread(np.arange(len(x)) % 8)


def test_pca(spark, vectors):
    ids, x = vectors
    rows = {r.vec_id: r.reduced for r in catalog.vec_pca(spark, SF).collect()}
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = x @ axes[:8].T
    got = np.array([rows[i] for i in ids])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5)


def test_ivf_recall(spark):
    recalls = [r.recall for r in catalog.vec_ivf_recall(spark, SF).collect()]
    assert len(recalls) == len([i for i in read("embeddings", "vec_id")["vec_id"] if i % 50 == 0]) and np.mean(recalls) >= 0.9


def chunks_by_doc(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return {k: [r.content for r in sorted(v, key=lambda r: r.chunk_index)] for k, v in out.items() if {r.chunk_count for r in v} == {len(v)}}


def test_chunk_recursive(spark):
    t = read("documents", "doc_id", "text")
    got = chunks_by_doc(catalog.chunk_recursive(spark, SF))
    for doc, text in zip(t["doc_id"], t["text"]):
        ends = {0}  # each chunk begins within the overlap before the last one's end, and none leaves a gap
        for chunk in got.get(doc, []):
            assert len(chunk) <= 550
            ends = {k + len(chunk) for e in ends for k in range(max(0, e - 50), e + 1) if text.startswith(chunk, k)}
        assert len(text) in ends, doc


def test_chunk_adaptive(spark):
    t = read("documents", "doc_id", "text")
    got = chunks_by_doc(catalog.chunk_adaptive(spark, SF))
    for doc, text in zip(t["doc_id"], t["text"]):
        assert " ".join(got.get(doc, [])).split() == text.split()
        assert all(len(c) <= 1000 or len(c.split(". ")) == 1 for c in got.get(doc, []))


def test_augment_swap(spark):
    t = read("conversations", "conv_id", "turn", "text")
    texts = {f"{c}-{n}": x for c, n, x in zip(t["conv_id"], t["turn"], t["text"])}
    rows = catalog.augment_swap(spark, SF).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        w = texts[r.id].split()
        moved = sum(a != b for a, b in zip(w, r.content.split()))
        assert sorted(r.content.split()) == sorted(w) and moved <= 2 * max(1, int(0.1 * len(w)))
    assert sorted(map(tuple, catalog.augment_swap(spark, SF).collect())) == sorted(map(tuple, rows))


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge(spark):
    t = read("conversations", "conv_id", "turn", "text")
    turns = {(c, n): x for c, n, x in zip(t["conv_id"], t["turn"], t["text"])}
    rows = {r.id: r for r in catalog.QUERIES["rouge_of_turns"](spark, SF).collect()}
    order = sorted(turns)
    pairs = [(a, b) for a, b in zip(order, order[1:]) if a[0] == b[0]]
    assert len(rows) == len(pairs)
    for a, b in pairs:
        c, r = turns[b].split(), turns[a].split()
        n = lcs(c, r)
        p, q = n / len(c) if c else 0, n / len(r) if r else 0
        want = (round(p, 6), round(q, 6), round(2 * p * q / (p + q), 6) if p + q else 0.0)
        got = rows[f"{b[0]}-{b[1]}"]
        assert (got.precision, got.recall, got.f) == want
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 30)).tolist(), rng.integers(0, 5, rng.integers(0, 30)).tolist()
        assert metrics.common_length(a, b) == lcs(a, b)
