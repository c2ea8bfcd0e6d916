"""Token-ID / binary output: length-delimited records of token ids with a separate offset index.

A shard is two files. `<shard>.rec` starts with MAGIC, a version and the width of an id in bytes (2 if every id of the
vocabulary fits, else 4); then each sequence is a record

    uint64 length | uint32 masked crc of the length | ids, little-endian | uint32 masked crc of the ids

`<shard>.idx` holds a fixed-size entry per record (document id, whether it has one, byte offset, number of ids), so that
a reader can visit records in any order. A masked checksum is the crc rotated right by 15 bits plus a constant, so that
checksums of data that hold checksums stay meaningful.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import n_partitions, shared_dir
from tessera.session import ship

MAGIC = b"TSRA"
HEAD = struct.Struct("<4sHH")
LENGTH = struct.Struct("<QI")
CRC = struct.Struct("<I")
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n", "<u8")])
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Letters (ASCII, or of Latin-1 in UTF-8), then marks: to a tokenizer that splits letters from marks, two pieces.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


#: Normalizers that neither join what white space parts nor make white space of anything else than white space or one character.
_ALONE = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer")
#: Alternatives of a pattern that match no white space: plain letters behind an apostrophe or not, or a class, once or more often.
_LITERAL, _CLASS = re.compile("'?[A-Za-z]+"), re.compile(r"\[(\^?)((?:\\s|\\p\{\w+\})+)\]\+?")


def _spaceless(pattern: str) -> bool:
    """Whether no match of the pattern holds white space, as far as its form shows."""
    for part in pattern.split("|"):
        found = _CLASS.fullmatch(part)
        if not (_LITERAL.fullmatch(part) or (found and (found[1] == "^") == (r"\s" in found[2]) and r"\p{Z" not in found[2])):
            return False
    return True


def _parts(kind: dict | None, many: str) -> list[dict]:
    return [] if kind is None else [x for y in kind[many] for x in _parts(y, many)] if kind["type"] == "Sequence" else [kind]


def parts_at_space(tokenizer: dict) -> bool:
    """Whether a tokenizer's file shows that the ids of a text are those of its words in order: no added token holds white space, no normalizer carries anything across it, and
    the first pre-tokenizer cuts there and drops it. Where the file does not show it, the answer is no."""
    if any(not t["content"].strip() or len(t["content"].split()) > 1 or t["content"] != t["content"].strip() for t in tokenizer.get("added_tokens", [])):
        return False
    for x in _parts(tokenizer.get("normalizer"), "normalizers"):
        if x["type"] not in _ALONE and not (x["type"] == "Replace" and x["pattern"].get("Regex") in (r"\s+", r"\s") and x["content"] == " "):
            return False
    first = next(iter(_parts(tokenizer.get("pre_tokenizer"), "pretokenizers")), None)
    if first is None:
        return False
    if first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    return first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and _spaceless(first["pattern"].get("Regex", " "))


class WordEncoder:
    """Encodes texts, remembering words where the tokenizer never joins characters across ASCII white space.

    For such a tokenizer the ids of a text are those of its words in order, so a word is encoded once per worker. If its tokens also
    mark the ends of pieces (an end-of-word suffix), letters and the marks behind them are remembered apart, and
    new pieces are encoded many at a time. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), remembered
        described = json.loads(self.tokenizer.to_str())
        self.by_word = parts_at_space(described)
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {b"": b""}
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        suffix = described["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=f"<u{self.width}").tobytes()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [self.pack(e.ids) for e in found]

    def _learn_pieces(self, new: list[bytes]) -> None:
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            packed = self._encode([b" ".join(part)])[0]
            cuts = (np.flatnonzero(self.ends[np.frombuffer(packed, dtype=f"<u{self.width}")]) + 1) * self.width
            if len(cuts) == len(part):
                starts = [0, *cuts[:-1].tolist()]
                self.pieces.update((w, packed[a:b]) for w, a, b in zip(part, starts, cuts.tolist()))
            else:
                self.pieces.update(zip(part, self._encode(part)))

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        if len(self.pieces) > self.most:
            self.pieces = {b"": b""}
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if self.ends.any():
            plain = [m.groups() for m in map(PLAIN.fullmatch, new) if m]
            new = [w for w in new if not PLAIN.fullmatch(w)]
            self._learn_pieces([p for p in dict.fromkeys(x for pair in plain for x in pair) if p not in self.pieces])
            self.known.update((a + b, self.pieces[a] + self.pieces[b]) for a, b in plain)
        for i in range(0, len(new), 4096):
            self.known.update(zip(new[i : i + 4096], self._encode(new[i : i + 4096])))

    def encode(self, text: bytes) -> bytes:
        """The ids of one text, packed. A very long text is taken in pieces that end at white space if the tokenizer goes by words."""
        if not self.by_word:
            return self._encode([text])[0]
        return b"".join(self._words(piece.split()) for piece in pieces(text))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """encode() of each; what is new in all of them is learned together."""
        if not self.by_word:
            return self._encode(texts)
        split = [t.split() if len(t) < 1 << 22 else None for t in texts]
        self._learn([w for words in split if words for w in words if w not in self.known])
        return [self.encode(t) if words is None else self._words(words) for t, words in zip(texts, split)]

    def _words(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.known.__getitem__, words))


def pieces(text: bytes, most: int = 1 << 22) -> Iterator[bytes]:
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(b" ", at, at + most), text.rfind(b"\n", at, at + most))
        if cut <= at:  # no such white space: look on for the next
            ends = [x for x in (text.find(b" ", at + most), text.find(b"\n", at + most)) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[at:cut]
        at = cut
    yield text[at:]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


@dataclass
class Shard:
    """Reads one shard by its index: all in order, or any record by its number."""

    path: str  # without suffix

    def __post_init__(self):
        from pyarrow import fs

        self.store, at = fs.FileSystem.from_uri(self.path)
        self.at = at
        with self.store.open_input_stream(f"{at}.idx") as f:
            self.index = np.frombuffer(f.read(), dtype=INDEX)
        self.file = self.store.open_input_file(f"{at}.rec")
        magic, _, self.width = HEAD.unpack(self.file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{self.path}.rec is not a token record file")

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> np.ndarray:
        at, n = int(self.index["offset"][i]), int(self.index["n"][i])
        self.file.seek(at)
        return self._record(self.file.read(LENGTH.size + n * self.width + CRC.size), i)

    def records(self, at_once: int = 1 << 23) -> Iterator[np.ndarray]:
        """All records in order, read in stretches of at_once bytes."""
        ends = np.append(self.index["offset"][1:].astype(np.int64), self.file.size()) if len(self.index) else []
        held, start = b"", HEAD.size
        self.file.seek(start)
        for i, (at, end) in enumerate(zip(self.index["offset"].astype(np.int64).tolist(), map(int, ends))):
            if end > start + len(held):
                held, start = held[at - start :] + self.file.read(max(at_once, end - start - len(held))), at
            yield self._record(held[at - start : end - start], i)

    def _record(self, data: bytes, i: int) -> np.ndarray:
        size, crc = LENGTH.unpack_from(data) if len(data) >= LENGTH.size else (-1, 0)
        ids = data[LENGTH.size : -CRC.size]
        if size != len(ids) or crc != masked_crc(data[:8]) or CRC.unpack(data[-CRC.size :])[0] != masked_crc(ids):
            raise ValueError(f"{self.path}.rec: record {i} is damaged")
        return np.frombuffer(ids, dtype=f"<u{self.width}")

    def shuffled(self, seed: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of all records in an order that seed decides."""
        for i in np.random.default_rng(seed).permutation(len(self)):
            yield int(i), self[i]


def encoded(code: WordEncoder, texts: pa.Array, at_once: int = 256) -> Iterator[bytes]:
    for i in range(0, len(texts), at_once):
        yield from code.encode_all(texts[i : i + at_once].to_pylist())


def write_shard(batches: Iterator[pa.RecordBatch], out_dir: str, tokenizer_path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    """Write the (doc_id, text) rows of one task, which come in order, as the shard of that task's number."""
    from pyarrow import fs

    shard = TaskContext.get().partitionId()
    store, at = fs.FileSystem.from_uri(out_dir)
    store.create_dir(at, recursive=True)
    name, own = f"{at}/{shard:06d}", f"{at}/.{shard:06d}-{uuid.uuid4().hex}"
    code = encoder(tokenizer_path)
    end = b"" if end_id is None else code.pack([end_id])
    index, offset, total = [], HEAD.size, 0
    with store.open_output_stream(f"{own}.rec") as f:
        f.write(HEAD.pack(MAGIC, 1, code.width))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for doc, data in zip(ids, encoded(code, texts)):
                data += end
                size = struct.pack("<Q", len(data))
                f.write(size + CRC.pack(masked_crc(size)) + data + CRC.pack(masked_crc(data)))
                n = len(data) // code.width
                index.append((doc.as_py() or 0, doc.is_valid, offset, n))
                offset += LENGTH.size + len(data) + CRC.size
                total += n
    with store.open_output_stream(f"{own}.idx") as f:
        f.write(np.array(index, dtype=INDEX).tobytes())
    for suffix in ("rec", "idx"):
        store.move(f"{own}.{suffix}", f"{name}.{suffix}")
    yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [len(index)], "ids": [total]})


def write(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int | None = None) -> list[tuple[str, int, int]]:
    """Encode docs(doc_id, text) and write shards in ascending doc_id order; returns (path, documents, ids) of each shard in order.

    Texts are whole; null counts as empty; rows without doc_id come first; rows of the same doc_id follow their texts.
    Other columns are ignored. An empty table gives no shard with a record. A shard is written under a name of its own
    attempt and then renamed, so a repeated task leaves whole files. What reaches the driver is one row per shard.
    """
    spark = docs.sparkSession
    ship(spark)
    out_dir = out_dir or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(n_partitions(spark), "doc_id", F.substring("text", 1, 64))  # many rows of one doc_id are dealt by how their texts begin
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(lambda batches: write_shard(batches, out_dir, tokenizer_path, end_id), "shard long, documents long, ids long")
        .collect()
    )
    return [(f"{out_dir}/{r.shard:06d}", r.documents, r.ids) for r in sorted(rows, key=lambda r: r.shard)]


def read_shards(batches: Iterator[pa.RecordBatch], plan: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """The records of the shards whose numbers in plan (path, start) come in."""
    for batch in batches:
        for k in batch.column(0).to_pylist():
            path, start = plan[k]
            shard = Shard(path)
            n = shard.index["n"].astype(np.int64)
            first = start + np.cumsum(n) - n
            crcs = [zlib.crc32(ids.astype("<u4")) for ids in shard.records()]
            ids = pa.array(shard.index["doc_id"].astype(np.int64), mask=shard.index["has_id"] == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(first), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Every record of shards from write(): doc_id, start (ids of all records before it), n_tokens, ids_crc32.

    Each task reads the shards given to it. ids_crc32 is the crc32 of the ids as little-endian uint32.
    """
    ship(spark)
    starts = np.cumsum([0, *(ids for _, _, ids in shards)]).tolist()
    plan = [(path, start) for (path, documents, _), start in zip(shards, starts) if documents]

    numbers = spark.range(0, len(plan), 1, max(1, len(plan)))
    return numbers.mapInArrow(lambda batches: read_shards(batches, plan), "doc_id long, start long, n_tokens long, ids_crc32 long")
