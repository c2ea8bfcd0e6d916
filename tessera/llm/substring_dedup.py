"""Substring dedup by relative Lempel-Ziv parsing over words.

The corpus is cut at content-defined anchors (see anchors.py) and its pieces are dealt into reference blocks by the hash
of their anchor, so that all occurrences of a window of words meet in one block, and a document meets every block that can hold any of its windows. A block indexes
its windows: of each, the place with the least doc_id. Every piece is then factored against the block, greedily from the left: the index gives an earlier document's
place with the window at hand, the factor goes on along that source word by word as long as words agree, and where it ends the
window that starts inside it and crosses its end is looked up next. Where no earlier document has the window, one word is passed over. Factors are
windows long or longer and become duplicate spans. As the window across each end is looked up anew, the spans are the same whatever source a factor follows.

Words are numbered within the block by their bytes. The index finds windows by a hash of those numbers; the words are then compared, and windows that share
a hash but not the words are indexed by the words themselves.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import anchors
from tessera.llm.anchors import Windows

SIZE = 13
GRAM = 7


def numbered(contents: pa.ChunkedArray) -> np.ndarray:
    """A number for each word of the contents: equal words, and only those, have equal numbers."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    out = [np.zeros(0, dtype=np.int64)]
    for content in contents:
        words = content.as_py().split()
        out.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
    return np.concatenate(out)


def index_windows(words: np.ndarray, at: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """For each window (its words start at `at`) the number of the window with the same words and the least doc."""

    def least(kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((doc, kind))
        ranked = kind[order]
        head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        out = np.empty(len(kind), dtype=np.int64)
        out[order] = order[head][np.cumsum(head) - 1]
        return out

    hashes = anchors.grams_hash(words.astype(np.uint64) + np.uint64(1), size)[at]
    source = least(hashes, doc)
    same = np.ones(len(at), dtype=bool)
    for k in range(size):
        same &= words[at + k] == words[at[source] + k]
    if not same.all():
        mixed = np.flatnonzero(np.isin(hashes, hashes[~same]))
        _, kind = np.unique(words[at[mixed][:, None] + np.arange(size)], axis=0, return_inverse=True)
        source[mixed] = mixed[least(kind.ravel(), doc[mixed])]
    return source


def parse(words: np.ndarray, n: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Factor all pieces at once: which windows lie in factors. A piece has n windows, so n + size - 1 words; doc is that of each window."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=bool)
    ends = np.cumsum(n)
    at = np.repeat((size - 1) * np.arange(len(n)), n) + np.arange(total)
    end = np.repeat(ends, n)  # where a window's piece ends
    source = index_windows(words, at, doc, size)
    edge = np.zeros(total + 1, dtype=np.int32)
    now = ends - n
    while len(now):
        step = np.ones(len(now), dtype=np.int64)
        hit = np.flatnonzero(doc[source[now]] < doc[now])
        p, q = now[hit], source[now[hit]]
        length = np.ones(len(hit), dtype=np.int64)
        live = np.arange(len(hit))
        while len(live):
            a, b = p[live] + length[live], q[live] + length[live]
            inside = (a < end[p[live]]) & (b < end[q[live]])
            live, a, b = live[inside], a[inside], b[inside]
            live = live[words[at[a] + size - 1] == words[at[b] + size - 1]]
            length[live] += 1
        np.add.at(edge, p, 1)
        np.add.at(edge, p + length, -1)
        step[hit] = length
        now = (now + step)[now + step < end[now]]
    return np.cumsum(edge[:total]) > 0


def parse_block(table: pa.Table, size: int) -> pa.Table:
    """Factor the pieces of one reference block against it; the spans that earlier documents hold, by the document's block."""
    block, records = anchors.received(table)
    n = records["n"].astype(np.int64)
    flags = parse(numbered(table.column("content")), n, np.repeat(records["id"], n), size)
    return anchors.send_spans(*anchors.dup_stretches(block, records, flags, size))


def finish_block(docs: pa.Table, spans: pa.Table, texts: bool) -> pa.Table:
    out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
    for doc, text, own in anchors.apply_spans(docs, spans):
        words = text.split()
        removed = 0
        if len(own):
            gone = anchors.covered(own, len(words))
            removed = int(gone.sum())
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
        else:
            kept = b" ".join(words)
        out["doc_id"].append(doc)
        out["n_words"].append(len(words))
        out["n_removed"].append(removed)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept.decode("utf-8", "replace") if texts else None)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    table = pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
    return table if texts else table.drop_columns("kept")


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (the words that stay, joined by one space) of each row of docs(doc_id, text).

    A word goes if a window of size words covers it whose words also stand in a row, anywhere in the text, with a smaller doc_id.
    Null and wordless texts have no words and an empty rest. Rows with the same doc_id don't judge each other; rows
    without doc_id are judged by all others and judge none. Other columns are ignored. An empty table gives no row.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return anchors.plan(
        docs, Windows(anchors.word_hashes, size, gram, chunk=1 << 17, between=b" "),
        lambda t: parse_block(t, size), lambda d, s: finish_block(d, s, texts), schema, strict=True,
    )
