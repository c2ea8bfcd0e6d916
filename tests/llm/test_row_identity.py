"""Rows that differ only in which column is null, in a column beside the text, or in an added token with a space."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality, simhash, token_records
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import identity


def test_identity_tells_nulls_and_moments_apart(spark):
    rows = [(1, None, "a"), (1, "a", None), (None, "1", "a"), (1, "", "a"), (1, "null", "a")]
    found = spark.createDataFrame(rows, "x long, y string, z string").select(identity(F.struct("*")).alias("i")).collect()
    assert len({r.i for r in found}) == len(rows)
    times = spark.sql("SELECT explode(array(timestamp'2024-01-01 00:00:00.000001', timestamp'2024-01-01 00:00:00.000002')) t").select(identity(F.struct("t")).alias("i"), identity(F.struct(F.col("t").cast("timestamp_ntz"))).alias("j")).collect()
    assert len({r.i for r in times}) == len({r.j for r in times}) == 2


def test_keep_one_keeps_rows_whose_nulls_change_places(spark):
    rows = [(1, None, "alpha beta gamma delta"), (1, "alpha beta gamma delta", None), (1, "alpha beta gamma delta", None), (2, "alpha beta gamma delta", "x"), (None, None, None), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {tuple(r) for r in simhash.keep_one(docs).collect()}
    # wordless rows are a group of their own, of which the row with an id stays
    assert kept == {rows[0], rows[1]}


def test_keep_judges_rows_of_one_text_by_their_language(spark):
    rng = np.random.default_rng(1)
    english = quality.Rules().common["en"].split()
    text = " ".join(rng.choice(english + ["house", "river", "mountain", "walks", "slowly"], 400))
    base = [(k, " ".join(rng.choice(english + ["house", "river", "stone", "tree"], 400)), "en") for k in range(5)]
    other = [(10 + k, " ".join(rng.choice(quality.Rules().common["de"].split() + ["haus", "fluss", "stein"], 400)), "de") for k in range(5)]
    docs = spark.createDataFrame([*base, *other, (50, text, "en"), (50, text, "de")], "doc_id long, text string, lang string")
    judged = {(r.doc_id, r.row): r.kept for r in quality.judge(docs).collect()}
    kept = [(r.doc_id, r.lang) for r in quality.keep(docs).where("doc_id = 50").collect()]
    assert sorted(v for (i, _), v in judged.items() if i == 50) == [False, True] and len(kept) == 1


def test_mix_tells_null_texts_and_levels_apart(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, None, "a b"), (1, "a b", "s")], "doc_id long, text string, source string")
    level = [mixing.Level("source", F.col("source"), {}, 1)]
    assert sorted(map(tuple, mixing.mix(docs, level, 200, 2).collect()), key=repr) == sorted([(1, "a b", None)] * 2 + [(1, "a b", "s")] * 2, key=repr)


CHANGES = {
    "token with a space": lambda t: t["added_tokens"].append(t["added_tokens"][0] | {"id": 49408, "content": "new york", "special": False}),
    "token that is a space": lambda t: t["added_tokens"].append(t["added_tokens"][0] | {"id": 49408, "content": " ", "special": False}),
    "pre-tokenizer that keeps space": lambda t: t["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),
    "pattern with space": lambda t: t["pre_tokenizer"]["pretokenizers"][0].update(pattern={"Regex": r"\s?[\p{L}]+|[^\s\p{L}]+"}),
    "no pre-tokenizer": lambda t: t.update(pre_tokenizer=None),
    "normalizer that joins": lambda t: t["normalizer"]["normalizers"].insert(0, {"type": "Replace", "pattern": {"String": " "}, "content": "_"}),
}


@pytest.mark.parametrize("change", [None, *CHANGES])
def test_words_are_encoded_apart_only_if_the_file_shows_that_they_can_be(tmp_path, change):
    from tokenizers import Tokenizer

    described = json.load(open(tokenizer_path()))
    if change:
        CHANGES[change](described)
    path = str(tmp_path / "t.json")
    json.dump(described, open(path, "w"))
    own = token_records.WordEncoder(path)
    assert own.by_word is (change is None)
    texts = ["in new york city", " new  york\nnew york ", "a\tb\x0bc", "don't, stop... é́ 東京 12", "", "  "]
    plain = Tokenizer.from_file(path)
    for packed, t in zip(own.encode_all([t.encode() for t in texts]), texts):
        assert np.frombuffer(packed, dtype=f"<u{own.width}").tolist() == plain.encode(t, add_special_tokens=False).ids
