"""Suffix-array dedup: bytes covered by a long string that stands earlier in the corpus.

The corpus is cut at content-defined anchors (see anchors.py), and the stretches of text around anchors that occur more
than once are dealt into shards by the anchor's hash, so that equal strings meet in one shard. In a shard equal stretches become one, the
distinct ones are suffix-sorted by induction in memory, and neighbours whose common prefix is
`size` bytes or more form a class of equal strings; all but the earliest occurrence of a class are duplicates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import anchors
from tessera.llm.anchors import Windows
from tessera.llm.suffix_array import prefix_at_least, suffix_array

SIZE = 100
GRAM = 40


def byte_symbols(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = np.arange(len(text) + 1)
    return np.frombuffer(text, dtype=np.uint8), places[:-1], places[1:]


def decide_shard(table: pa.Table, size: int) -> pa.Table:
    """The spans of one shard that stand earlier, by the document's block."""
    block, records = anchors.received(table)
    content = b"".join(table.column("content").to_pylist())
    if not len(records):
        return anchors.send_spans(block, np.zeros(0, dtype=anchors.SPAN))
    n = records["n"].astype(np.int64)
    sizes = n + size - 1
    ends = np.cumsum(sizes)
    order = np.lexsort((records["at"], records["row"], records["id"]))  # order in the corpus
    known: dict[bytes, int] = {}
    kind = np.empty(len(n), dtype=np.int64)  # which distinct stretch a run is
    firsts = []
    for r, a, b in zip(order.tolist(), (ends - sizes)[order].tolist(), ends[order].tolist()):
        kind[r] = k = known.setdefault(content[a:b], len(firsts))
        if k == len(firsts):
            firsts.append(r)
    firsts = np.array(firsts)
    data = np.frombuffer(b"\0".join(known) + b"\0", dtype=np.uint8)
    n_own, size_own = n[firsts], sizes[firsts] + 1
    begin = np.cumsum(size_own) - size_own
    text = data.astype(np.uint16) + 1
    text[begin + size_own - 1] = 0
    # place of a window among all windows of the distinct stretches; -1 elsewhere
    window_at = np.repeat(begin - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())
    place = np.full(len(data), -1, dtype=np.int64)
    place[window_at] = np.arange(len(window_at))
    # documents in order, and a window's place in the corpus as one number; a text has fewer than 2 ** 31 bytes
    new = np.concatenate(([True], (records["id"][order][1:] != records["id"][order][:-1]) | (records["row"][order][1:] != records["row"][order][:-1])))
    rank = np.empty(len(n), dtype=np.int64)
    rank[order] = np.cumsum(new)
    key = np.repeat((rank[firsts] << 31) + records["at"][firsts] - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())

    ranked = suffix_array(text, 257, size)
    ranked = ranked[place[ranked] >= 0]
    same = prefix_at_least(data, ranked[:-1], ranked[1:], size)
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    own = place[ranked]
    earliest = np.minimum.reduceat(key[own], heads)
    dup = np.empty(len(own), dtype=bool)
    dup[own] = key[own] != np.repeat(earliest, np.diff(np.append(heads, len(own))))

    is_first = np.zeros(len(n), dtype=bool)
    is_first[firsts] = True
    begin_own = np.cumsum(n_own) - n_own
    each = np.repeat(begin_own[kind] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return anchors.send_spans(*anchors.dup_stretches(block, records, dup[each] | np.repeat(~is_first, n), size))


def finish_block(docs: pa.Table, spans: pa.Table, texts: bool) -> pa.Table:
    out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for doc, text, own in anchors.apply_spans(docs, spans):
        removed = runs = 0
        kept = text
        if len(own):
            gone = anchors.covered(own, len(text))
            removed = int(gone.sum())
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        for name, v in zip(out, (doc, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if texts else None)):
            out[name].append(v)
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    table = pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
    return table if texts else table.drop_columns("kept")


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs removed), kept_sha256 and, with texts, kept (binary: cuts may fall inside a character).

    A byte of the UTF-8 text of docs(doc_id, text) goes if a string of size bytes covers it that also starts earlier: in a row with a smaller
    doc_id, or further ahead in the same row. Null counts as empty. Rows with the same doc_id come in the order of their texts,
    rows without doc_id after all others. Other columns are ignored. An empty table gives no row.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return anchors.plan(
        docs, Windows(byte_symbols, size, gram),
        lambda t: decide_shard(t, size), lambda d, s: finish_block(d, s, texts), schema, strict=False,
    )
