"""Finding repeated windows of symbols across a corpus: content-defined anchors lead windows of equal content to one place.

A document is a sequence of symbols (bytes, or words as 64-bit hashes); a window is `size` symbols in a row. Within each
window the `gram` symbols whose hash is least are its anchor (the leftmost on ties). Equal windows have equal anchors, so

1. each block of documents sends the hashes of its anchors, dealt by hash, and hears which of them occur again anywhere;
2. only windows around those anchors are sent on, again dealt by the anchor's hash, where equal windows meet;
3. what is decided there returns to the block as spans of its documents.

Every window is covered, whatever the corpus: the first step only drops windows that cannot occur twice. Hashes only lead windows together; whether
they are equal is decided by their content. Blocks are hashes of doc_id and grow in number with the corpus; all exchanges carry packed arrays. A frequent anchor is
sent twice at most by each block in step 1. Windows around a hot anchor, one that many blocks hold, are dealt in step 2 by a second anchor of the window as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import n_partitions
from tessera.session import ship

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20
#: Low bits of a gram's hash that give way to its place: a chunk has fewer symbols than 2 ** PLACE.
PLACE = 22
#: Bytes of text for a block and for a bucket, about, and the number of blocks that makes an anchor hot.
BLOCK, BUCKET, HOT = 8 << 20, 4 << 20, 32
#: Stands for a missing doc_id: such rows come after all others.
LAST = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of MurmurHash3, public domain)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Powers:
    """BASE ** i and its inverse modulo 2 ** 64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def spans_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of symbols[s:e] for each pair, mixed."""
    up, down = POWERS.get(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, dtype=U)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def grams_hash(symbols: np.ndarray, size: int) -> np.ndarray:
    """spans_hash of every run of size symbols."""
    n = len(symbols) - size + 1
    up, down = POWERS.get(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, dtype=U)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by running minima within blocks of width from both ends."""
    n = len(x)
    pad = -n % width
    grid = np.concatenate((x, np.full(pad, ~U(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, and where the words begin and end. Different words may share a hash."""
    starts, ends, data = word_bounds(text)
    if not len(starts):
        return np.zeros(0, dtype=U), starts, ends
    out = []
    for at in range(0, len(starts), CHUNK >> 2):  # a long text in parts
        s, e = starts[at : at + (CHUNK >> 2)], ends[at : at + (CHUNK >> 2)]
        part = data[s[0] : e[-1]].astype(U) + U(1)
        out.append(spans_hash(part, s - s[0], e - s[0]))
    return np.concatenate(out), starts, ends


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), data


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~x, width)


@dataclass
class Chunk:
    """Pieces of texts end to end: their symbols, where each symbol's bytes begin and end in raw, and each piece's start, document and offset there."""

    symbols: np.ndarray
    raw: bytes
    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    offsets: np.ndarray


@dataclass
class Windows:
    """How a corpus is cut: symbols of a text with the places of their bytes, window size, gram size, symbols of a chunk, what parts the contents of two runs."""

    symbols: Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]
    size: int
    gram: int
    chunk: int = CHUNK
    between: bytes = b""

    def chunks(self, texts: list[bytes]) -> Iterator[Chunk]:
        """All texts; long ones are cut with windows kept whole."""
        held, n, width = [], 0, 0
        for d, text in enumerate(texts):
            own, begin, end = self.symbols(text)
            for at in range(0, max(0, len(own) - self.size + 1), self.chunk):
                to = min(len(own), at + self.chunk + self.size - 1)
                raw = text[begin[at] : end[to - 1]]
                shift = width - int(begin[at])
                held.append((own[at:to], raw, begin[at:to] + shift, end[at:to] + shift, n, d, at))
                n, width = n + to - at, width + len(raw)
                if n >= self.chunk:
                    yield self._chunk(held)
                    held, n, width = [], 0, 0
        if held:
            yield self._chunk(held)

    @staticmethod
    def _chunk(held: list) -> Chunk:
        symbols, raw, begin, end, starts, docs, offsets = zip(*held)
        return Chunk(np.concatenate(symbols), b"".join(raw), np.concatenate(begin), np.concatenate(end), np.array(starts), np.array(docs), np.array(offsets))

    def runs(self, chunk: Chunk, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, hash of the anchor, hash to deal by) of each run of windows that share an anchor, or around hot ones both anchors."""
        n = len(chunk.symbols)
        grams = grams_hash(chunk.symbols.astype(U) + U(1), self.gram)
        place = U((1 << PLACE) - 1)
        keys = (grams & ~place) | np.arange(len(grams), dtype=U)
        at = (sliding_min(keys, self.size - self.gram + 1) & place).astype(np.int64)
        valid = np.zeros(n + 1, dtype=np.int8)  # windows that lie in one piece
        ends = np.append(chunk.starts[1:], n) - self.size + 1
        valid[chunk.starts] += 1
        valid[ends] -= 1
        where = np.flatnonzero(np.cumsum(valid[: len(at)]) > 0)
        own = at[where]
        change = own[1:] != own[:-1]
        seeds = grams[own]
        is_hot = member(seeds, hot) if hot is not None and len(hot) else np.zeros(0, dtype=bool)
        if is_hot.any():
            other = (sliding_max(keys, self.size - self.gram + 1) & place).astype(np.int64)[where]
            change |= is_hot[1:] & (other[1:] != other[:-1])
        new = np.flatnonzero(np.concatenate(([True], change)))
        deal = seeds[new]
        if is_hot.any():
            deal = np.where(is_hot[new], deal ^ mix(grams[other[new]] + U(1)), deal)
        return where[new], np.diff(np.append(new, len(own))), seeds[new], deal


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which x are in known, sorted and not empty."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _binary(parts: list[np.ndarray]) -> list[bytes]:
    return [p.tobytes() for p in parts]


def by_bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """A bucket by bits that the hash's own order doesn't use."""
    return (mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)) % U(n_buckets)).astype(np.int64)


def ordered(block: pa.Table) -> tuple[list[int], list[bytes], list[int | None]]:
    """(sort ids, texts, doc_ids) of a block's rows by doc_id, then text: rows of a block have the same order each time."""
    ids, texts = block.column("doc_id").to_pylist(), block.column("text").cast(pa.binary()).to_pylist()
    rows = sorted(((LAST if i is None else i), t or b"", i) for i, t in zip(ids, texts))
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def send_anchors(block: int, texts: list[bytes], cut: Windows, n_buckets: int) -> pa.Table:
    """The anchors of a block, each once, or twice if it is there more than once."""
    seeds = np.sort(np.concatenate([np.zeros(0, dtype=U), *(cut.runs(chunk)[2] for chunk in cut.chunks(texts))]))
    third = np.zeros(len(seeds), dtype=bool)
    third[2:] = (seeds[2:] == seeds[1:-1]) & (seeds[2:] == seeds[:-2])
    seeds = seeds[~third]
    bucket = by_bucket(seeds, n_buckets)
    order = np.argsort(bucket, kind="stable")
    seeds, bucket = seeds[order], bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, dtype=np.int64)
    return pa.table({"bucket": pa.array(bucket[first]), "block": pa.array(np.full(len(first), block)), "data": pa.array(_binary(np.split(seeds, first[1:])) if len(first) else [], pa.binary())})


def find_repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, those of its anchors that are there twice or in another block as well, and which of them are hot."""
    blocks, data = table.column("block").to_numpy(), table.column("data").to_pylist()
    seeds = np.frombuffer(b"".join(data), dtype=U)
    owner = np.repeat(blocks, [len(d) // 8 for d in data])
    order = np.argsort(seeds, kind="stable")
    seeds, owner = seeds[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], seeds[1:] != seeds[:-1]))) if len(seeds) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(new, len(seeds)))
    times = np.repeat(times, times)
    seeds, owner, times = seeds[times > 1], owner[times > 1], times[times > 1]
    order = np.argsort(owner, kind="stable")
    seeds, owner, times = seeds[order], owner[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)
    parts = [(np.unique(s), np.unique(s[t > HOT])) for s, t in zip(np.split(seeds, first[1:]), np.split(times, first[1:]))] if len(first) else []
    return pa.table({"block": pa.array(owner[first], pa.int64()), "data": pa.array(_binary([x for x, _ in parts]), pa.binary()), "hot": pa.array(_binary([x for _, x in parts]), pa.binary())})


#: A run of windows on its way to a bucket: identity and order of the document, number of windows, first window. Its content, the bytes of its symbols, goes along.
RECORD = np.dtype([("id", "<i8"), ("row", "<u4"), ("n", "<u4"), ("at", "<i8")])


def _all(column: pa.ChunkedArray) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(column.to_pylist()), dtype=U))


def send_runs(block: int, table: pa.Table, repeats: pa.Table, cut: Windows, n_buckets: int, strict: bool) -> pa.Table:
    """The windows of a block around repeated anchors, with their bytes, by bucket.

    A run whose bytes the block has sent already stands later than that one, so it is decided here and only its place goes on, to a bucket of the block's own; so
    a frequent passage reaches its bucket once from each block. strict: only an earlier document decides, not an earlier place or a row of the same doc_id.
    """
    ids, texts, _ = ordered(table)
    sent: dict[bytes, int] = {}
    decided: list[np.ndarray] = []
    known, hot = _all(repeats.column("data")), _all(repeats.column("hot"))
    out: dict[int, list[tuple[bytes, bytes]]] = {}
    if len(known):
        ids = np.array(ids, dtype=np.int64)
        for chunk in cut.chunks(texts):
            first, n, seeds, deal = cut.runs(chunk, hot)
            hit = member(seeds, known)
            first, n, bucket = first[hit], n[hit], by_bucket(deal[hit], n_buckets)
            order = np.argsort(bucket, kind="stable")
            first, n, bucket = first[order], n[order], bucket[order]
            piece = np.searchsorted(chunk.starts, first, side="right") - 1
            records = np.zeros(len(first), dtype=RECORD)
            records["id"], records["row"], records["n"] = ids[chunk.docs[piece]], chunk.docs[piece], n
            records["at"] = first - chunk.starts[piece] + chunk.offsets[piece]
            raw = chunk.raw
            contents = [raw[a:b] for a, b in zip(chunk.begin[first].tolist(), chunk.end[first + n + cut.size - 2].tolist())]
            go = np.ones(len(first), dtype=bool)
            for r, (doc, content) in enumerate(zip(records["id"].tolist(), contents)):
                before = sent.setdefault(content, doc if strict else -1)
                if strict:
                    go[r] = before >= doc
                elif before == -1:
                    sent[content] = 0
                else:
                    go[r] = False
            if not go.all():
                decided.append(records[~go])
                contents = [contents[r] for r in np.flatnonzero(go).tolist()]
                records, bucket = records[go], bucket[go]
            new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() if len(bucket) else []
            for a, b in zip(new, [*new[1:], len(bucket)]):
                out.setdefault(int(bucket[a]), []).append((records[a:b].tobytes(), cut.between.join(contents[a:b])))
    buckets = list(out)
    records, contents = [b"".join(r for r, _ in out[b]) for b in buckets], [cut.between.join([c for _, c in out[b]]) for b in buckets]
    if decided:
        buckets.append(int(by_bucket(np.array([block], dtype=U), n_buckets)[0]))
        records.append(b"".join(d.tobytes() for d in decided))
        contents.append(None)
    return pa.table([pa.array(buckets, pa.int64()), pa.array([block] * len(buckets), pa.int64()), pa.array(records, pa.binary()), pa.array(contents, pa.binary())], names=["bucket", "block", "records", "content"])


#: A span of symbols of a block's row that is to be removed.
SPAN = np.dtype([("row", "<u4"), ("n", "<u4"), ("at", "<i8")])


def send_spans(block: np.ndarray, spans: np.ndarray) -> pa.Table:
    """Spans by block."""
    order = np.argsort(block, kind="stable")
    block, spans = block[order], spans[order]
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, dtype=np.int64)
    return pa.table({"block": pa.array(block[first], pa.int64()), "data": pa.array(_binary(np.split(spans, first[1:])) if len(first) else [], pa.binary())})


def with_decided(table: pa.Table, decide: Callable[[pa.Table], pa.Table], size: int) -> pa.Table:
    """decide() of a bucket's rows with content, and the spans of the runs that were decided before (those rows have none)."""
    is_open = table.column("content").is_valid()
    block, records = received(table.filter(pc.invert(is_open)))
    rest = table.filter(is_open)
    spans = np.zeros(len(records), dtype=SPAN)
    spans["row"], spans["n"], spans["at"] = records["row"], records["n"] + size - 1, records["at"]
    return pa.concat_tables([decide(rest), send_spans(block, spans)]) if len(rest) else send_spans(block, spans)


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(block of each run, records) of one bucket."""
    records = table.column("records").to_pylist()
    block = np.repeat(table.column("block").to_numpy(), [len(r) // RECORD.itemsize for r in records])
    return block, np.frombuffer(b"".join(records), dtype=RECORD)


def dup_stretches(block: np.ndarray, records: np.ndarray, flags: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and spans of stretches of flagged windows; flags has a value for each window of the runs, end to end."""
    n = records["n"].astype(np.int64)
    run = np.repeat(np.arange(len(n)), n)
    on = np.flatnonzero(flags)
    if not len(on):
        return block[:0], np.zeros(0, dtype=SPAN)
    new = np.concatenate(([True], (on[1:] != on[:-1] + 1) | (run[on[1:]] != run[on[:-1]])))
    first = on[new]
    length = np.diff(np.append(np.flatnonzero(new), len(on)))
    of = run[first]
    begin = np.cumsum(n) - n
    spans = np.zeros(len(first), dtype=SPAN)
    spans["row"], spans["n"], spans["at"] = records["row"][of], length + size - 1, records["at"][of] + first - begin[of]
    return block[of], spans


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of a document's n symbols lie in spans."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, spans["at"], 1)
    np.add.at(edge, spans["at"] + spans["n"], -1)
    return np.cumsum(edge[:n]) > 0


def apply_spans(block: pa.Table, replies: pa.Table) -> Iterator[tuple[int | None, bytes, np.ndarray]]:
    """(doc_id, text, spans) of each row of a block."""
    _, texts, ids = ordered(block)
    spans = np.frombuffer(b"".join(replies.column("data").to_pylist()), dtype=SPAN)
    spans = spans[np.argsort(spans["row"], kind="stable")]
    at = np.searchsorted(spans["row"], np.arange(len(ids) + 1))
    for k, (doc, text) in enumerate(zip(ids, texts)):
        yield doc, text, spans[at[k] : at[k + 1]]


def plan(
    docs: DataFrame,
    cut: Windows,
    decide: Callable[[pa.Table], pa.Table],
    finish: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    strict: bool,
    block_bytes: int = BLOCK,
    bucket_bytes: int = BUCKET,
) -> DataFrame:
    """The steps above as one plan. The dealt-out documents are one exchange that three steps read.

    The texts are measured first: there is a block and a bucket for each shuffle partition, or more, so that none is beyond block_bytes or bucket_bytes of text on average.
    """
    ship(docs.sparkSession)
    measured = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = n_partitions(docs.sparkSession)
    n_blocks, n_buckets = max(least, -(-measured // block_bytes)), max(least, -(-measured // bucket_bytes))
    n = max(least, -(-n_blocks // 2))
    blocks = docs.select(
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), F.lit(n_blocks)).alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
    ).repartition(n, "block")

    def number(key) -> int:
        return key[0].as_py()

    anchors = blocks.groupBy("block").applyInArrow(
        lambda key, t: send_anchors(number(key), ordered(t)[1], cut, n_buckets), "bucket long, block long, data binary"
    )
    repeats = anchors.groupBy("bucket").applyInArrow(find_repeats, "block long, data binary, hot binary")
    runs = blocks.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(
        lambda key, t, r: send_runs(number(key), t, r, cut, n_buckets, strict), "bucket long, block long, records binary, content binary"
    )
    spans = runs.groupBy("bucket").applyInArrow(lambda t: with_decided(t, decide, cut.size), "block long, data binary")
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(finish, schema)
