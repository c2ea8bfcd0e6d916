"""The whole pipeline against a plain version, on documents without a language (whose distances are not judged)."""

import hashlib
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_text_operators import fill

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def domain(source):
    n = int(re.search("[0-9]+$", source)[0])
    return "web" if n < 5 else "books" if n < 10 else "code" if n < 15 else "news"


def expected(rows, item):
    import public_tokenizers
    import xxhash
    from tokenizers import Tokenizer

    def windows(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    def good(t):
        w = t.split()
        five = windows(w, 5)
        rep = {p for i, x in enumerate(five) if five.count(x) > 1 for p in range(i, i + 5)}
        return len(w) >= 10 and 100 * len(rep) <= 20 * len(w)

    docs = [r for r in rows if good(r[1] or "")]
    prints = {}
    for i, t, *_ in docs:
        h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in windows(t.lower().split(), 3)]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    label = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            label[a] = min(label[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3)
    docs = [r for r in docs if label[r[0]] == r[0]]
    bad = set(windows(item.lower().split(), 10))
    docs = [r for r in docs if not bad & set(windows(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r[1].lower()), 10))]
    size, leaves = {r[0]: len(r[1].split()) for r in docs}, {}
    for r in docs:
        leaves.setdefault((domain(r[3]), r[3]), []).append(r[0])
    tokens = {k: sum(size[i] for i in v) for k, v in leaves.items()}
    weights = {"web": 40, "books": 30, "code": 20, "news": 10}
    top = fill(sum(tokens.values()) * 80 // 100, [(d, weights[d], 2 * sum(t for k, t in tokens.items() if k[0] == d)) for d in sorted({k[0] for k in leaves})])
    copies = {}
    for d, given in top.items():
        for s, b in fill(given, [(k[1], 1, 2 * t) for k, t in sorted(tokens.items()) if k[0] == d]).items():
            whole, left = divmod(b, tokens[d, s])
            upto = 0
            for i in sorted(leaves[d, s], key=lambda i: hashlib.md5(f"1:{whole}:{i}".encode()).hexdigest()):
                upto += size[i]
                copies[i] = whole + (upto <= left)
    encode, start, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode, 0, []
    for i, t, *_ in sorted(docs):
        ids = encode(t, add_special_tokens=False).ids + [1]
        for _ in range(copies[i]):
            out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(15)
    rows = [(i, text(rng.randint(12, 90)), None, f"src{rng.choice([0, 1, 5, 12, 17])}", 1) for i in range(60)]
    rows += [(60, rows[3][1], None, "src0", 1), (61, rows[4][1] + " tail", None, "src5", 1), (62, text(20) + " " + item.upper() + " " + text(5), None, "src1", 1)]
    rows += [(63, "too short", None, "src1", 1), (64, "a b c d e f g " * 9, None, "src1", 1), (65, None, None, "src1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted(expected(rows, item))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Repeated rows, rows without ids, sources, texts or languages, noise in a judged language, columns with clashing names; then no rows at all."""
    from tessera.llm import quality

    rng = random.Random(3)
    common, rest = quality.COMMON["en"].split(), ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.35 else rng.choice(rest) for _ in range(150)) + "."
    schema = "doc_id long, text string, lang string, source string, row long, hash string, `__row` int, `at` string, label string"
    tail = (1, "h", 2, "z", "l")
    rows = [(i, prose(), "en", f"src{i % 3}", *tail) for i in range(80)]
    rows += [rows[5], rows[5], (80, rows[6][1], None, None, *tail), (None, rows[7][1], "en", None, *tail), (None, prose(), "en", None, *tail), (None, None, None, None, *tail), (81, "", "xx", "", *tail)]
    noise = [(100 + k, " ".join(w + "###" for w in prose().split()), "en", "src1", *tail) for k in range(3)] + [(110, prose().upper(), "en", "src1", *tail)]
    docs = spark.createDataFrame(rows + noise, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, rows[9][1][:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        docs = spark.createDataFrame([tuple(r) for r in docs.collect()], schema)
    good = [r[:2] for r in rows if r[1]]
    assert kept["quality"] == sorted(good, key=repr)
    assert kept["near_duplicates"] == sorted({r[1]: r[:2] for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0), reverse=True) if r[1]}.values(), key=repr)
    assert kept["decontaminate"] == [r for r in kept["near_duplicates"] if r[0] != 9]
    assert set(kept["mix"]) <= set(kept["decontaminate"])
    words = lambda rs: sum(len(t.split()) for _, t in rs)
    assert 0.5 * words(kept["decontaminate"]) < words(kept["mix"]) <= 0.8 * words(kept["decontaminate"])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in kept["mix"]), key=repr)
    for at in ("none", "all"):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.createDataFrame([] if at == "all" else [(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/{at}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{at}").count() == 0
