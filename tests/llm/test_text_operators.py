"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_extract, line_dedup, mixing, quality, simhash, substring_dedup, suffix_dedup, token_records, url_filter
from tessera.llm.queries import mixture, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, bucket int, hash string, n_words int, `at` string"


def corpus(seed=1, n=60):
    """Texts of few words with shared passages, copies, near copies and odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = []
    for _ in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), passage)
        texts.append("\n".join(lines))
    texts += [texts[3], texts[3], texts[5].replace("a", "b", 1), texts[7] + " tail", None, "", "   \n\t ", "one", "one two", "x " * 3000, "Ab\x00c d\u00a0e f" * 40, texts[8].upper()]
    texts.append("\n".join(texts[:12] * 20))  # a long one
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "de", None, "xx"]), rng.choice(["src0", "src12", None, "a"]), 1, "h", 2, "z") for i, t in zip(ids, texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_substring_dedup(docs, rows, empty):
    first = {}
    for i, t, *_ in sorted(rows):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = by_id(substring_dedup.dedup(docs))
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_without_ids(spark):
    t = " ".join(f"w{k}" for k in range(20))
    got = substring_dedup.dedup(spark.createDataFrame([(None, t), (4, t), (4, t), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in got) == [(False, 20, 0), (False, 20, 0), (True, 0, 0), (True, 20, 20)]


def thue_morse(n, one, two):
    return "".join(two if bin(k).count("1") % 2 else one for k in range(n))


def test_substring_dedup_compares_words(spark):
    """Words that a polynomial hash modulo 2 ** 64 cannot tell apart."""
    head = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{head} {thue_morse(1024, 'a', 'b')}"), (2, f"{head} {thue_morse(1024, 'b', 'a')}"), (3, f"{head} {thue_morse(1024, 'b', 'a')}")]
    got = by_id(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k].n_removed for k in (1, 2, 3)] == [0, 0, 13]


def local(rows, cut, decide, finish, strict, n_blocks, n_buckets):
    """The steps of anchors.plan() one after another in this process."""
    import pyarrow as pa

    from tessera.llm import anchors

    blocks = {}
    for i, t in rows:
        blocks.setdefault(hash((i, "block")) % n_blocks, []).append((i, t))
    blocks = {b: pa.table({"doc_id": pa.array([i for i, _ in v], pa.int64()), "text": pa.array([t for _, t in v], pa.string())}) for b, v in blocks.items()}

    def by(tables, key):
        whole = pa.concat_tables(tables)
        return {k: whole.filter(pa.compute.equal(whole[key], k)) for k in set(whole[key].to_pylist())}

    found = by([anchors.find_repeats(t) for t in by([anchors.send_anchors(b, anchors.ordered(t)[1], cut, n_buckets) for b, t in blocks.items()], "bucket").values()], "block")
    none = pa.table({"block": pa.array([], pa.int64()), "data": pa.array([], pa.binary()), "hot": pa.array([], pa.binary())})
    runs = by([anchors.send_runs(b, t, found.get(b, none), cut, n_buckets, strict) for b, t in blocks.items()], "bucket")
    spans = by([anchors.with_decided(t, decide, cut.size) for t in runs.values()], "block")
    none = pa.table({"block": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
    out = [finish(t, spans.get(b, none)) for b, t in blocks.items()]
    return sorted(x for t in out for x in zip(t["doc_id"].to_pylist(), t["n_removed"].to_pylist())), sorted(len(t) for t in runs.values())


def test_hot_anchors_are_dealt_by_a_second_one(rows, monkeypatch):
    from functools import partial

    from tessera.llm import anchors
    from tessera.llm.anchors import Windows

    rng = random.Random(8)
    common = " ".join(rng.choice("abcdefgh") * 3 for _ in range(9))
    texts = [" ".join([str(rng.random()), *rng.choices("pqrs", k=3), common, *rng.choices("pqrs", k=4), str(rng.random())]) for _ in range(300)]
    pairs = [(i, t) for i, t, *_ in rows] + [(1000 + k, t) for k, t in enumerate(texts)]
    for cut, decide, finish, strict in (
        (Windows(anchors.word_hashes, 13, 7, 1 << 17, b" "), partial(substring_dedup.parse_block, size=13), partial(substring_dedup.finish_block, texts=False), True),
        (Windows(suffix_dedup.byte_symbols, 50, 20), partial(suffix_dedup.decide_shard, size=50), partial(suffix_dedup.finish_block, texts=False), False),
    ):
        plain, few = local(pairs, cut, decide, finish, strict, 40, 64)
        monkeypatch.setattr(anchors, "HOT", 3)
        split, more = local(pairs, cut, decide, finish, strict, 40, 64)
        monkeypatch.setattr(anchors, "HOT", 32)
        assert plain == split and sum(n for _, n in plain) > 0 and few != more


def test_parse_with_colliding_hashes(monkeypatch):
    from tessera.llm import anchors

    rng = np.random.default_rng(6)
    n = rng.integers(1, 8, 200)
    words = rng.integers(0, 3, int((n + 3).sum()))
    doc = np.repeat(rng.integers(0, 30, 200), n)
    want = substring_dedup.parse(words, n, doc, 4)
    at = np.repeat(3 * np.arange(200), n) + np.arange(n.sum())
    first = {}
    for a, d in zip(at, doc):
        first[tuple(words[a : a + 4])] = min(d, first.get(tuple(words[a : a + 4]), 99))
    assert want.tolist() == [first[tuple(words[a : a + 4])] < d for a, d in zip(at, doc)]
    plain = anchors.grams_hash
    monkeypatch.setattr(anchors, "grams_hash", lambda x, size: plain(x, size) % np.uint64(7))
    assert substring_dedup.parse(words, n, doc, 4).tolist() == want.tolist()


def test_suffix_dedup(docs, rows, empty):
    seen = set()
    got = by_id(suffix_dedup.dedup(docs))
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), sum(gone), spans, kept), i
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a, b = text(300), text(150)
    rows = [(3, a, 1), (3, a, 1), (3, b + a[100:260], 2), (1, b, 3), (None, a + b, 4), (None, a + b, 4), (None, None, 5), (2, "", 6), (9, text(99), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(docs).collect())
    seen, want = set(), Counter()
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        want[i, len(data), sum(gone)] += 1
    assert got == want


def test_rows_are_judged_for_themselves(spark):
    """Quality, decontamination and fingerprints of repeated rows and rows without ids, with columns of clashing names."""
    text = "a word and another word of a text that is long enough to be read by all"
    rows = [(1, text, "en", "r"), (1, text, "en", "s"), (1, "short", None, "r"), (None, text, "xx", "r"), (None, None, None, None), (None, None, None, None), (2, " \n", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")
    judged = Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.judge(docs).collect())
    assert judged == Counter([(1, 17, False, True)] * 2 + [(1, 1, True, False), (None, 17, False, True)] + [(None, 0, True, False)] * 2 + [(2, 0, True, False)])
    assert Counter(quality.keep(docs).collect()) == Counter(docs.where("length(text) > 10").collect())
    items = spark.createDataFrame([(1, text), (1, text), (None, "SHORT"), (3, None)], "item_id long, text string")
    found = Counter((r.doc_id, r.n_hit, r.n_items) for r in decontaminate.report(docs, items).collect())
    assert found == Counter([(1, 17, 1)] * 2 + [(1, 1, 1), (None, 17, 1)] + [(None, 0, 0)] * 2 + [(2, 0, 0)])
    assert Counter(decontaminate.keep(docs, items).collect()) == Counter(docs.where("text IS NULL OR doc_id = 2").collect())
    groups = Counter((r.doc_id, r.component_id) for r in simhash.cluster(docs).collect())
    assert groups == Counter([(1, 1), (1, 1), (1, 1), (None, 1), (None, 2), (None, 2), (2, 2)])


def test_token_records_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    shards = token_records.write(docs, tokenizer_path(), end_id=1)
    got, start = by_id(token_records.read(spark, shards)), 0
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = next(p for p, n, _ in shards if n > 3)
    shard = token_records.Shard(path)
    assert sorted(k for k, _ in shard.shuffled(5)) == list(range(len(shard)))
    assert [k for k, _ in shard.shuffled(5)] == [k for k, _ in shard.shuffled(5)] != [k for k, _ in shard.shuffled(6)]
    assert token_records.read(spark, token_records.write(empty, tokenizer_path(), end_id=1)).count() == 0


def test_token_records_notice_damage(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (None, None)], "doc_id long, text string")
    shards = token_records.write(docs, tokenizer_path(), f"file://{tmp_path}/out", 1)
    assert sorted((r.doc_id is None, r.n_tokens) for r in token_records.read(spark, shards).collect()) == [(False, 3), (True, 1)]
    name = next(p for p, n, _ in shards if n)[len("file://") :] + ".rec"
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(ValueError):
        s = token_records.Shard("file://" + name[:-4])
        [s[k] for k in range(len(s))]


def test_simhash_components(spark, docs, rows, empty):
    import xxhash

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    prints = []
    rows = sorted(rows, key=lambda r: r[0])
    for _, t, *_ in rows:
        w = words((t or "").translate(low))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    got = by_id(simhash.cluster(docs))
    for k, (i, *_) in enumerate(rows):
        assert (got[i].fingerprint % 2**64, got[i].component_id) == (prints[k], rows[label[k]][0])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[x][0] for x in label})
    assert simhash.cluster(empty).count() == simhash.keep_one(empty).count() == 0


def test_simhash_keeps_one_row_of_each_group(spark):
    rng = random.Random(11)
    one, two, three, four = (" ".join(str(rng.random()) for _ in range(40)) for _ in range(4))
    rows = [(1, one, "a"), (2, one, "a"), (2, two, "a"), (3, three, "a"), (3, three, "a"), (3, three, "b"), (None, one, "a"), (None, four, "a"), (None, four, "a"), (4, None, "a"), (None, "", "a")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(got) == Counter([(1, one), (2, two), (3, three), (None, four), (4, None)])


def test_simhash_links_span_all_links():
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    values = np.unique([centre ^ sum(1 << int(b) for b in rng.integers(0, 30, k)) for k in rng.integers(0, 6, 400)]).astype(np.uint64)
    a, b = simhash.linked(values)

    def parts(pairs):
        label = {int(v): int(v) for v in values}

        def top(x):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in pairs:
            x, y = top(int(x)), top(int(y))
            label[max(x, y)] = min(x, y)
        return {v: top(v) for v in label}

    every = [(x, y) for x in values for y in values if x < y and int(x ^ y).bit_count() <= 3]
    assert parts(zip(a, b)) == parts(every)
    assert len(a) < len(values) <= len(every)


def test_simhash_parts_dense_lists():
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 62, 12).astype(np.uint64)
    low = np.uint64(0xFFFFFF)  # all share the bytes of the first triple, positions 0 to 2
    values = np.unique([(int(c) & ~int(low) | 0xABCDEF) ^ sum(1 << int(b) for b in rng.integers(24, 64, k)) for c in centres for k in rng.integers(0, 4, 60)]).astype(np.uint64)
    key = np.full(len(values), simhash.TRIPLES.index((0, 1, 2)) << 24)

    def parts(pairs):
        label = {int(v): int(v) for v in values}

        def top(x):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in pairs:
            x, y = top(int(x)), top(int(y))
            label[max(x, y)] = min(x, y)
        return {v: top(v) for v in label}

    every = [(x, y) for x in values for y in values if x < y and int(x ^ y).bit_count() <= 3]
    assert parts(zip(*simhash._pairs(key, values, 10))) == parts(zip(*simhash._pairs(key, values))) == parts(every) and every


def test_token_records_of_other_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["two words", " a\n\n b ", "", "x" * 50, "don't  stop\tnow"]
    assert not token_records.encoder(path).by_word and token_records.encoder(tokenizer_path()).by_word
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(token_records.read(spark, token_records.write(docs, path)))
    for i, t in enumerate(texts):
        assert got[i].ids_crc32 == zlib.crc32(np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes())


def test_token_records_of_one_doc_id(spark):
    rng = random.Random(12)
    rows = [(5 if k % 3 else None, " ".join(rng.choices("abcdef", k=rng.randint(0, 9)))) for k in range(300)]
    shards = token_records.write(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), end_id=1)
    assert sum(n > 0 for _, n, _ in shards) > 2  # one doc_id is dealt to several
    code, at, want = token_records.encoder(tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[1])):
        ids = np.frombuffer(code.encode(t.encode()), f"<u{code.width}").tolist() + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(map(tuple, token_records.read(spark, shards).collect()), key=lambda r: r[1])
    assert got == want


def test_suffix_array_spills(monkeypatch):
    from tessera.llm import suffix_array

    spilled = []
    plain = suffix_array.BucketQueue._spill
    monkeypatch.setattr(suffix_array.BucketQueue, "_spill", lambda q: (spilled.append(1), plain(q)))
    rng = random.Random(7)
    for n in (1, 2, 30, 500):
        text = np.array([rng.randint(1, 4) for _ in range(n)] + [0], dtype=np.uint16)
        want = sorted(range(n + 1), key=lambda k: text[k:].tolist())
        assert suffix_array.suffix_array(text, 5, n + 1, room=7).tolist() == want
    assert spilled


def test_decontaminate(spark, docs, rows, empty):
    def normal(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    texts = [t for _, t, *_ in rows if t]
    bench = [(1, texts[0][:120].upper()), (2, "one two"), (3, None), (4, ""), (5, "nothing like this in any text at all we hope"), (6, "one"), (2, texts[4]), (None, "zz zz")]
    items = []
    for k, t in bench:
        w = normal(t)
        items += [(("" if k is None else str(k)), tuple(w[a : a + 10])) for a in range(max(1, len(w) - 9))] if w else []
    table = spark.createDataFrame(bench, "item_id long, text string")
    for most in (decontaminate.MOST_BROADCAST, 0):  # broadcast and shuffled
        got = by_id(decontaminate.report(docs, table, most_broadcast=most))
        for i, t, *_ in rows:
            w, hit, names = normal(t), set(), set()
            for name, win in items:
                for a in range(len(w) - len(win) + 1):
                    if tuple(w[a : a + len(win)]) == win:
                        hit.update(range(a, a + len(win)))
                        names.add(name)
            digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(names), digest, bool(hit))
    clean = {i for i, r in got.items() if not r.contaminated}
    kept = decontaminate.keep(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    rest = {r.doc_id: r.text for r in decontaminate.cut(docs, table).collect()}
    for i, t, *_ in rows:
        if i in clean:
            assert rest[i] == t
        else:
            assert normal(rest[i]) == [w for k, w in enumerate(normal(t)) if k not in set(got[i].hit_words)]
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontaminate.report(docs, none).where("contaminated").count() == 0
    assert decontaminate.report(empty, table).count() == 0


def test_quality_base_columns(docs, rows, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t, lang, *_ in rows:
        w = words(t)
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {p for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        base = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), base,
        )
        assert not (q.base_failed and q.kept) and (lang in ("en", "de") or q.js_chars is None)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, q in got.items() if q.kept}
    assert quality.judge(empty).count() == 0


def test_quality_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(5)
    common, rest = quality.COMMON["en"].split(), ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    prose = [" ".join(rng.choice(common) if rng.random() < 0.35 else rng.choice(rest) for _ in range(200)) + "." for _ in range(60)]
    noise = [" ".join(w + "###" for w in p.split()) for p in prose[:3]] + [p.upper() for p in prose[3:6]] + [" | ".join(rng.sample(rest, 150))]
    got = quality.judge(spark.createDataFrame([(k, t, "en") for k, t in enumerate(prose + noise)], "doc_id long, text string, lang string"))
    assert {r.doc_id for r in got.where("NOT kept").collect()} == set(range(60, 67))


def line_chunks(lines, window=line_dedup.WINDOW, divisor=line_dedup.DIVISOR):
    v = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    start, out = 0, []
    for i in range(len(lines)):
        rolling = 0
        for x in v[max(0, i - window + 1) : i + 1]:
            rolling = rolling * line_dedup.BASE + x
        if i == len(lines) - 1 or (i >= window - 1 and rolling % divisor == 0):
            out.append((start, i + 1))
            start = i + 1
    return out


def test_line_dedup(docs, rows, empty):
    seen, want = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        lines, kept, gone = (t or "").split("\n"), [], 0
        for a, b in line_chunks(lines):
            part = "\n".join(lines[a:b])
            if b - a >= 2 and part in seen:
                gone += b - a
            else:
                kept += lines[a:b]
                seen.add(part)
        want[i] = (None if t is None else "\n".join(kept), len(lines), gone)
    got = line_dedup.dedup(docs)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == want
    assert sum(g for *_, g in want.values()) > 50
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_tells_texts_of_one_hash_apart(docs, monkeypatch):
    want = Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(docs).collect())
    monkeypatch.setattr(line_dedup, "chunk_hash", lambda t: F.pmod(F.xxhash64(t), F.lit(5)))
    assert Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(docs).collect()) == want
    monkeypatch.setattr(line_dedup, "chunk_hash", lambda t: F.when(F.length(t) % 2 == 0, F.xxhash64(t)).otherwise(F.lit(5)))
    assert Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(docs).collect()) == want


def test_line_dedup_repeated_rows_and_null_ids(spark):
    lines = [f"line {k} of a text" for k in range(40)]
    a, b = "\n".join(lines), "\n".join(["new"] + lines[:30])
    rows = [(3, a, 1), (3, a, 2), (2, b, 3), (None, a, 4), (None, a, 5), (None, None, 6), (4, "", 7), (2, a, 8)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, row long"))
    assert got.columns == ["doc_id", "text", "row", "n_lines", "n_removed"]
    cut = [(x, y) for x, y in line_chunks(lines) if y - x >= 2]
    whole = sum(y - x for x, y in cut)
    assert {r.row: r.n_removed for r in got.collect() if r.row != 3} == {1: whole, 2: whole, 4: 0, 5: 0, 6: 0, 7: 0, 8: whole}


def test_line_chunks_resist_shifts():
    rng = random.Random(2)
    lines = [str(rng.random()) for _ in range(200)]
    cut = {"\n".join(lines[a:b]) for a, b in line_chunks(lines)}
    shifted = ["new"] + lines
    assert len(cut - {"\n".join(shifted[a:b]) for a, b in line_chunks(shifted)}) <= 1


def fill(given, children):
    """Water-filling by raising the level step by step: {name: budget} of [(name, weight, capacity)]."""
    left, out = list(children), {}
    while left:
        level = given / sum(w for _, w, _ in left)
        full = [c for c in left if c[2] <= c[1] * level]
        if not full:
            return out | {n: int(w * level) for n, w, _ in left}
        small = min(full, key=lambda c: (c[2] / c[1], c[0]))
        out[small[0]] = small[2]
        given -= small[2]
        left.remove(small)
    return out


def test_mixing_budgets_go_to_siblings_first(spark):
    leaves = [("a", "x", 100), ("a", "y", 10), ("a", "z", 1000), ("b", "x", 5), ("b", "y", 5), ("c", "x", 400)]
    levels = [mixing.Level("domain", None, {"a": 5, "b": 4}, 1), mixing.Level("source", None, {"z": 2}, 1)]
    got = {(r.domain, r.source): r.budget for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, source string, tokens long"), levels, 50, 2).collect()}
    top = fill(760, [("a", 5, 2220), ("b", 4, 20), ("c", 1, 800)])
    for d in "abc":
        own = fill(top[d], [(s, 2 if s == "z" else 1, 2 * t) for x, s, t in leaves if x == d])
        assert {s: got[d, s] for s in own} == own
    assert got["b", "x"] == 10 and got["a", "y"] == 20  # both full; a's shortage went to x and z of a


def test_mixing_prefixes(spark, docs, rows, empty):
    got = mixing.plan(docs, mixture(), per_cent=70, epochs=2, seed=3).collect()
    assert len(got) == len(rows)
    leaves = {}
    for r in got:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    table = spark.createDataFrame([(*k, sum(r.n_tokens for r in v)) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    budget = {(r.domain, r.lang, r.source): (r.budget, r.tokens) for r in mixing.budgets(table, mixture(), 70, 2).collect()}
    for k, v in leaves.items():
        b, t = budget[k]
        whole, left = divmod(b, t) if t else (0, 0)
        upto = 0
        for r in sorted(v, key=lambda r: (hashlib.md5(f"3:{whole}:{r.doc_id}".encode()).hexdigest(), r.row)):
            upto += r.n_tokens
            assert r.copies == (0 if not r.n_tokens or not b else whole + (upto <= left)), k
    mixed = mixing.mix(docs, mixture(), per_cent=70, epochs=2, seed=3)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.plan(empty, mixture()).count() == mixing.mix(empty, mixture()).count() == 0


def test_mixing_of_repeated_rows(spark):
    level = [mixing.Level("source", F.col("source"), {}, 1)]
    rows = [(1, "a b c d", "s", 1), (1, "a b c d", "s", 2), (1, "a b c d", "s", 2), (1, "a b c d", "t", 3), (None, "a b", "t", 4), (None, "a b", "t", 4), (None, None, "t", 5), (7, " ", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    for per_cent, epochs in ((30, 1), (50, 1), (90, 2), (150, 3)):
        want = mixing.plan(docs, level, per_cent, epochs, 5).collect()
        got = mixing.mix(docs, level, per_cent, epochs, 5)
        assert got.columns == docs.columns and len(want) == len(rows)
        assert Counter((r.doc_id, r.source) for r in got.collect()) == Counter(x for r in want for x in [(r.doc_id, r.source)] * r.copies)
    assert mixing.mix(docs, level, 5, 1, 5).count() == 0


PAGES = {
    "plain": ("<html><body><article><h1>T &amp; U</h1><p>One\n two<br>three.<p>Be.</article></body>", "T & U\n\nOne two three.\n\nBe."),
    "furniture": (
        "<head><title>no</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'><p>We use cookies and more cookies than you want.</p></div><main><h2>Title</h2><p>First paragraph of the text, which is long enough.</p>"
        "<aside><p>An aside of some length.</p></aside><div class=\"ad\"><p>Buy now, buy here.</p></div><p>Second &lt;paragraph&gt; &nbsp; of the <b>bo</b>ld text.</p>"
        "<form><p>Subscribe</p><input><button>Go</button></form><section id='comments'><article><p>A reader's comment that is rather long as well, longer than most.</p></article></section></main>"
        "<div class=sidebar><ul><li>One<li>Two</ul></div><footer><p>Copyright</p></footer></body>",
        "Title\n\nFirst paragraph of the text, which is long enough.\n\nSecond <paragraph> of the bold text.",
    ),
    "divs": (
        "<body><div><a href=a>Menu one</a> <a href=b>Menu two</a></div><div><div><p>" + "A long paragraph in a plain element. " * 5 + "</p><p>Short.</p><p>" + "Another long paragraph here. " * 6 + "</p></div></div><div class='footer'>End</div></body>",
        ("A long paragraph in a plain element. " * 5).strip() + "\n\nShort.\n\n" + ("Another long paragraph here. " * 6).strip(),
    ),
    "hidden": ("<article><p style='display: none'>no</p><p hidden>no</p><p>yes</p><template><p>no</p></template></article>", "yes"),
    "null": (None, ""), "empty": ("", ""), "blank": ("<html><body> \n </body></html>", ""), "text": ("just text", "just text"), "broken": ("<article><p>a<b>b</p><![bad <p>c", None),
    "long": ("<article>" + "<p>word word</p>" * 20000 + "</article>", "\n\n".join(["word word"] * 20000)),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_html_extract(name):
    html, want = PAGES[name]
    got = html_extract.extract(html)
    assert want is None or got == want


DECLARATIONS = {
    "broken": (PAGES["broken"][0], "ab\n\nc"),
    "endif": ("<p>a</p><![ endif]--><p>b</p>", "a\n\nb"),
    "far close": ("<p>a</p><![endif]--><p>b</p><p>c</p><![if x]><p>d</p>", "a\n\nb\n\nc\n\nd"),
    "unknown": ("<article><p>a</p><![foo[x]]><p>b</p></article>", "a\n\nb"),
    "plain text": ("a <![1] b", "a <![1] b"),
    "cdata": ("<p>a</p><![CDATA[ x > y ]]><p>b</p>", "a\n\nb"),
}


@pytest.mark.parametrize("name", list(DECLARATIONS))
def test_html_goes_on_after_declarations(name):
    html, want = DECLARATIONS[name]
    assert html_extract.extract(html) == want


SENTENCES = ["This is the %s sentence of an article, and it is long enough to be taken for a sentence by all." % n for n in ("first", "second", "third", "fourth", "fifth", "sixth")]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in SENTENCES)
WHOLE = "\n\n".join(SENTENCES)
AD = "<div class=ad><p>Buy now, as this offer of ours ends soon, and it will not come again before the next year.</p></div>"
NAMED = {
    "discussion": (f"<main>{PARAGRAPHS}<section id=discussion><h2 id=the-discussion>So what</h2><p>{SENTENCES[0]}</p></section></main>", f"{WHOLE}\n\nSo what\n\n{SENTENCES[0]}"),
    "heading": (f"<article><h2 id=related-work>Related work</h2>{PARAGRAPHS}</article>", f"Related work\n\n{WHOLE}"),
    "entry header": (f"<article><header class=entry-header><h1>Title</h1></header>{PARAGRAPHS}{AD}</article>", f"Title\n\n{WHOLE}"),
    "has": (f"<div class='content has-sidebar'>{PARAGRAPHS}</div>{AD}", WHOLE),
    "no": (f"<div class='no-comments'>{PARAGRAPHS}</div>{AD}", WHOLE),
    "wrapper": (f"<div class=sidebar-layout><article>{PARAGRAPHS}</article><div class=sidebar><p>{SENTENCES[0]}</p></div></div>", WHOLE),
    "large": (f"<div class='ad-free'>{PARAGRAPHS}</div>", WHOLE),
    "form": (f"<body><form action=/>{PARAGRAPHS}</form>{AD}</body>", WHOLE),
    "short form": ("<body><form action=/><p>All there is.</p><input></form></body>", "All there is."),
    "long comments": (f"<article>{PARAGRAPHS}</article><div id=comments>{PARAGRAPHS * 3}</div>", WHOLE),
    "related links": (f"<article>{PARAGRAPHS}<div class=related><a href=a>{SENTENCES[0]}</a></div></article>", WHOLE),
    "inline": (f"<article><p>One <span class=ad>two</span> three.</p>{PARAGRAPHS}</article>", f"One three.\n\n{WHOLE}"),
    "empty article": (f"<article></article>{AD}", ""),
}


@pytest.mark.parametrize("name", list(NAMED))
def test_html_names_only_propose(name):
    html, want = NAMED[name]
    assert html_extract.extract(html) == want


LEAD = "A lead paragraph that is long enough to be chosen by itself, ahead of the text."
BESIDE = {
    "lead": (f"<body><div class=post><h1>A title of the page</h1><p>{LEAD}</p><div class=text>{PARAGRAPHS}</div></div></body>", f"A title of the page\n\n{LEAD}\n\n{WHOLE}"),
    "levels": (f"<div><p>{LEAD}</p><div><p>{LEAD}</p><blockquote>{PARAGRAPHS}</blockquote><p>{LEAD}</p></div></div>", "\n\n".join([LEAD, LEAD, WHOLE, LEAD])),
    "menu": (f"<div><div><a href=a>One</a> <a href=b>Two</a></div><div>{PARAGRAPHS}</div></div>", WHOLE),
}


LINKS = "<ul>" + "".join(f"<li><a href={k}>Link {k}</a></li>" for k in range(4)) + "</ul>"
LINKED = "\n\n".join(f"Link {k}" for k in range(4))
BESIDE |= {
    "two articles": (f"<div><article><h2>One</h2>{PARAGRAPHS}</article><article><h2>Two</h2>{PARAGRAPHS}</article></div>{AD}", f"One\n\n{WHOLE}\n\nTwo\n\n{WHOLE}"),
    "three articles": (f"<body>{'<article>' + PARAGRAPHS + '</article>' * 1}<article>{PARAGRAPHS}</article><article>{PARAGRAPHS}</article></body>", "\n\n".join([WHOLE] * 3)),
    "teaser": (f"<body><article>{PARAGRAPHS * 3}</article><article><p>{SENTENCES[0]}</p></article></body>", "\n\n".join([WHOLE] * 3)),
    "links in the article": (f"<article>{PARAGRAPHS}{LINKS}</article>", f"{WHOLE}\n\n{LINKED}"),
    "links beside": (f"<div><div>{PARAGRAPHS}</div>{LINKS}</div>", WHOLE),
    "list with text": (f"<div>{PARAGRAPHS}<ul><li><a href=a>One</a></li><li>A plain item of the list</li></ul></div>", f"{WHOLE}\n\nOne\n\nA plain item of the list"),
    "related work": (f"<article>{PARAGRAPHS}<section class=related-work><p>{SENTENCES[2]}</p></section></article>", f"{WHOLE}\n\n{SENTENCES[2]}"),
    "post header": (f"<article><div class=post-header><h1>Title</h1></div>{PARAGRAPHS}</article>", f"Title\n\n{WHOLE}"),
}


@pytest.mark.parametrize("name", list(BESIDE))
def test_html_keeps_chosen_lines_beside_the_largest_element(name):
    html, want = BESIDE[name]
    assert html_extract.extract(html) == want


def test_html_table(spark):
    rows = [(k, f"u{k}", h, "x") for k, (h, _) in enumerate(PAGES.values())] + [(None, None, None, None)]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_rules(spark):
    cases = {
        "http://a.example.net/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://EXAMPLE.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "https://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"), "https://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"),
        "https://xexample.net/en/": ("xexample.net", "/en/", "net/", "block"), "https://net": ("net", "", None, None), "https://a.net?q=/": ("a.net", "", None, None),
        "nothing": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "a://b/c://d": ("b", "/c://d", None, None), "x://y.org/fr/" + "é/" * 3000: ("y.org", "/fr/" + "é/" * 3000, "org/fr/", "allow"),
    }
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(cases)] * 2, "page_id long, url string, html string")
    got = url_filter.judge(pages).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert url_filter.judge(pages.where("false")).count() == 0


def test_url_model_on_held_out_urls(spark):
    rng = random.Random(4)
    good, bad = ["river", "garden", "winter", "history", "kitchen"], ["casino", "xxx", "pills", "spam", "win88"]
    urls = []
    for k in range(600):
        kind = k % 2
        name = "-".join(rng.sample(bad if kind else good, 2))
        site = f"https://{name}.{('bad' if kind else 'good') if k < 400 else 'test'}.example/"
        urls.append((k, site + str(rng.randint(1, 999))))
    rules = (("good.example", "/", "allow"), ("bad.example", "/", "block"))  # alike but for one label
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    right = sum(got[k] == ("block" if k % 2 else "allow") for k in range(400, 600))
    assert right >= 190
