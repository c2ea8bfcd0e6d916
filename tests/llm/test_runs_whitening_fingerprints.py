"""Periodic runs, whitening and document fingerprints against plain versions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import periodic, piecewise, queries, whitening


def plain_runs(w, exponent=4, least=6):
    """Every maximal stretch of every period, shortest periods first; a stretch that a shorter period has already is not new."""
    found = {}
    for p in range(1, len(w) // exponent + 1):
        start = 0
        while start + p < len(w):
            end = start
            while end + p < len(w) and w[end] == w[end + p]:
                end += 1
            if end > start and end + p - start >= max(least, exponent * p):
                found.setdefault((start, end + p - start), p)
            start = max(end, start) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 9), st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.integers(0, 12))
def test_runs_of_any_words(head, times, block, lags):
    w = head + block * (times * 2) + head[:7]
    ids = periodic.word_ids([x.encode() for x in w])
    assert periodic.runs_of(ids) == plain_runs(w)
    parts = [r for low in range(1, len(w), lags + 1) for r in periodic.runs_of(ids, low, low + lags + 1)]
    assert sorted(parts) == sorted(plain_runs(w))
    assert periodic.runs_of(ids, exponent=2, least=3) == plain_runs(w, 2, 3)


def test_long_runs_take_no_square_of_the_length():
    ids = np.zeros(400_000, dtype=np.int32)
    assert periodic.runs_of(ids) == [(0, 400_000, 1)]
    rng = np.random.default_rng(1)
    block = rng.integers(0, 1000, 30_000).astype(np.int32)
    assert periodic.runs_of(np.tile(block, 5)) == [(0, 150_000, 30_000)]


SCHEMA = "doc_id long, text string, runs int, start string, period string, doc string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) + " x y" * rng.randint(0, 9) + " z" * rng.randint(0, 9) for _ in range(150)]
    texts += [None, "", " \n\t", "one", "a " * 6, "a " * 5, "ä ö " * 4 + "\u00a0 \x00", "a b c " * 700, " ".join(str(k % 37) for k in range(1500)), texts[3], texts[3]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t, 1, "s", "p", "d") for i, t in zip(ids, texts)] + [(5000, texts[8], 1, "s", "p", "d")] * 2 + [(None, "q r " * 9, 1, "s", "p", "d"), (None, None, 1, "s", "p", "d")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def edited_words(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


@pytest.mark.parametrize("lags", [periodic.LAGS, 3])
def test_periodic_runs(docs, rows, lags):
    got = periodic.report(periodic.detect(periodic.tail_repeated(docs), lags=lags)).collect()
    want = []
    for i, t, *_ in rows:
        w = edited_words(i, t)
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, plain_collapsed(w, runs))]
        want.append((i, len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in want) > 50 and any(r[2] > 1 for r in want)


def test_periodic_runs_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = periodic.report(periodic.detect(periodic.tail_repeated(empty)))
    assert found.count() == 0 and dict(found.dtypes)["period"] == "bigint"


def test_ties_of_the_strongest_run(spark):
    runs = [(9, 8, 2), (3, 8, 2), (3, 4, 1), (1, 6, 2)]
    found = spark.createDataFrame([(runs,), ([],)], f"runs array<{periodic.RUN}>").select(periodic.strongest(F.col("runs")).alias("b")).collect()
    assert tuple(found[0].b) == (3, 4, 1) and found[1].b is None


VECTORS = "vec_id long, embedding array<float>, label int, component string, n int, whitened string"


def plain_whitening(rows, k):
    good = [(i, e) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    d = max({len(e) for _, e in good}, key=lambda m: (sum(len(e) == m for _, e in good), m))
    good = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in e]) for i, e in good if len(e) == d]
    n = len(good)
    sums = [sum(x[j] for _, x in good) for j in range(d)]
    each = [(i, [n * x[j] - sums[j] for j in range(d)]) for i, x in good]
    v = [[float(Fraction(sum(c[a] * c[b] for _, c in each), n**3)) for b in range(d)] for a in range(d)]
    values, vectors = np.linalg.eigh(np.array(v))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = [(i, j + 1, n, sum(x * x for x in c), float(np.array(c) / n @ vectors[:, j] / np.sqrt(values[j])), values[j] / np.trace(v)) for i, c in each for j in range(min(k, d))]
    return out


def rounded(rows, signs):
    return sorted((repr(i), c, n, dev, round(signs[c] * w, 8), round(e, 10)) for i, c, n, dev, w, e in rows)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12))
    rows = [(i, [float(np.float32(c)) for c in e]) for i, e in enumerate(base)]
    rows += [(300, None), (301, [None] * 12), (302, [float("nan")] + [0.0] * 11), (303, [float("inf")] + [0.0] * 11), (304, [-float("inf")] + [1.0] * 11), (305, [1.0] * 5), (306, [])]
    rows += [rows[4], rows[4], (None, rows[9][1]), (8, rows[11][1])]
    table = spark.createDataFrame([(i, e, 1, "c", 2, "w") for i, e in rows], VECTORS).repartition(5)
    got = whitening.report(table, 8).collect()
    want = plain_whitening(rows, 8)
    assert len(got) == len(want) == 8 * 304
    one = {r.component: r.whitened for r in got if r.vec_id == 1}
    other = {r[1]: r[4] for r in want if r[0] == 1}
    signs = {c: 1 if one[c] * other[c] > 0 else -1 for c in one}
    assert rounded([(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got], dict.fromkeys(signs, 1)) == rounded(want, signs)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    z = np.array([[r.whitened for r in sorted(got, key=lambda r: r.component) if r.vec_id == i] for i in range(300) if i not in (4, 8)])
    assert np.abs(np.cov(z.T) - np.eye(8)).max() < 0.1


def test_whitening_of_flat_and_few_vectors(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = whitening.report(table, 8).collect()
    assert len(got) == 30 and {r.component: r.whitened is None for r in got} == {1: False, 2: True, 3: True} and got[0].identity_error < 1e-10
    same = whitening.report(spark.createDataFrame(rows[:1] * 3, "vec_id int, embedding array<double>")).collect()
    assert len(same) == 9 and all(r.whitened is None and r.deviation == 0 and r.n == 3 for r in same)
    for none in ([], [(1, None), (2, [None])], [(1, [])]):
        found = whitening.report(spark.createDataFrame(none, VECTORS.split(", label")[0]))
        assert found.count() == 0 and dict(found.dtypes)["deviation"] == "bigint"


def test_deviations_beyond_doubles_are_exact(spark):
    rows = [(0, [2.0**21, 1.0]), (1, [-(2.0**21), 0.0]), (2, [3.0, 0.5])]
    got = {r.vec_id: r.deviation for r in whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[math.floor(1024 * c) + 100000 for c in e] for _, e in rows]
    want = [sum((3 * v - sum(o[j] for o in x)) ** 2 for j, v in enumerate(r)) for r in x]
    assert [got[i] for i in range(3)] == [w if w < 1 << 63 else None for w in want] and max(want) > 1 << 63


def text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    pair = {1: (a1, b1), 2: (a1, b2), 0.5: (a2, b1)}.get(int(m) / int(n))
    if not pair:
        return 0.0
    x, y = pair
    k = min(4, max(1, min(len(x), len(y))))
    grams = [{s[i : i + k] for i in range(max(1, len(s) - k + 1))} for s in pair]
    return 1 - plain_distance(x, y) / max(len(x), len(y), 1) if grams[0] & grams[1] else 0.0


def test_fingerprints_of_long_texts_are_those_of_their_pieces(monkeypatch):
    data = text(1, 40_000).encode()
    whole = piecewise.fingerprint(data)
    monkeypatch.setattr(piecewise, "PIECE", 1000)
    assert piecewise.fingerprint(data) == whole
    size, one, two = whole.split(":")
    assert int(size) >= 2048 and 30 <= len(one) <= 64 and len(two) < len(one)


def test_a_fingerprint_depends_on_the_texts_bytes_alone_and_edits_stay_local():
    for seed, n in ((1, 30), (2, 300), (3, 3000)):
        t = text(seed, n)
        a, b = piecewise.fingerprint(t.encode()), piecewise.fingerprint(t.replace(" ", "  ", 1).encode())
        assert a != b and plain_likeness(a, b) > 0.8
        assert plain_likeness(a, piecewise.fingerprint((text(9, 20) + t).encode())) > (0.5 if n == 30 else 0.8)
        assert plain_likeness(a, piecewise.fingerprint(text(seed + 50, n).encode())) == 0.0
    assert piecewise.fingerprint(b"") == piecewise.fingerprint(b"") and piecewise.fingerprint(b"ab" * 5000).count(":") == 2


def test_document_fingerprints(spark):
    texts = [text(k, random.Random(k).randint(1, 400)) for k in range(60)]
    texts += [texts[4], texts[4], None, "", "a", "abcd", "ab " * 5000, texts[9] + " more", "é" * 90]
    rows = [(3 * k, t, "f", 1, "p") for k, t in enumerate(texts)]
    rows += [(9000, texts[2], "f", 1, "p")] * 2 + [(None, texts[5], "f", 1, "p"), (None, None, "f", 1, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, part int, place string").repartition(3)
    got = piecewise.report(docs).collect()
    assert len(got) == len(rows)
    known = [(r[0], r[1] or "") for r in rows if r[0] is not None]
    known.sort(key=lambda r: r[0])
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[None]) == 2 and {r.n_chars for r in by[None]} == {0, len(texts[5])}
    for at, (i, t) in enumerate(known):
        if i == 9000 or at + 1 == len(known):
            continue
        following = known[at + 1][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        (r,) = by[i]
        marks = [piecewise.fingerprint(x.encode()) for x in (t, edited, following)]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), *marks[:2])
        assert (round(r.near_edited, 9), round(r.near_next, 9)) == (round(plain_likeness(*marks[:2]), 9), round(plain_likeness(marks[0], marks[2]), 9))
        if len(t) > 100 and k < len(following) and " " in t:
            assert r.near_edited > 0.4
    # of the two equal rows at the end one is followed by the other, and one by the first row of all, which has no id
    ends = sorted(by[9000], key=lambda r: r.near_next)
    assert ends[1].near_next == 1.0 and ends[1].edited_sha256 == hashlib.sha256((texts[2][: len(texts[2]) - len(texts[2]) // 4] + texts[2][: len(texts[2]) // 4]).encode()).hexdigest()
    alone = piecewise.report(docs.where("doc_id = 0")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert piecewise.report(docs.limit(0)).count() == 0
    assert {r.fingerprint for r in piecewise.fingerprints(docs).collect()} == {r.fingerprint for r in got}


def test_new_queries_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    found = queries.op13_document_fingerprints(spark, sf).collect()
    assert len(found) == n and sum(r.near_edited for r in found) / n > 0.6 and sum(r.near_next for r in found) / n < 0.1
    assert queries.op11_periodic_runs(spark, sf).count() == n
    assert queries.op12_embedding_whitening(spark, sf).count() == 8 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
