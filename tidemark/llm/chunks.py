"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: each step shifts it left and adds a random number of the byte, so its bits 11 to
15 depend on the last 16 bytes only. Where they are all zero, and the last such place is at least 16 bytes back, a chunk
ends; nothing before these bytes matters, so an insertion moves no later boundary. Stretches of over 256 bytes without a
boundary are cut every 256. Chunks average about 50 bytes, so a passage of 50 words holds several whole ones.

A chunk is a duplicate if its digest (128 bits) also occurs in a document with a smaller doc_id, or earlier in its own.
Runs of duplicate chunks of at least ``least`` bytes (32) are removed; shorter ones are too small to be more than chance.
Boundaries never divide a character. A batch of documents sends a digest once, whatever number of them holds it.

Defined cases: a null or empty text has no chunks; a null doc_id stands behind every other one; rows that repeat a doc_id
do not remove each other's chunks; columns besides doc_id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.blocks import BATCH, counts, ddl, gather, grouped, ids_of, in_batches, number_of, numbers, part_of, parts, rows_table
from tidemark.llm.common import U64, buffers, mix, slices, span_hashes

GEAR = np.random.default_rng(20240619).integers(0, 1 << 32, 256, dtype=np.uint32)
MASK, LEAST_CHUNK, MOST_CHUNK = np.uint32(0b11111 << 11), 16, 256
_SECOND = np.random.default_rng(20240623).permutation(256).astype(np.uint8)

DIGESTS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])
EARLIER = pa.schema([("batch", pa.int64()), ("keys", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.string())])


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, modulo 2^32, from sums over doubled windows."""
    h, width = GEAR[data], 1
    while width < 32 and width < len(h):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))  # the right side is complete before it is stored
        width *= 2
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every chunk."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    ends = np.flatnonzero((gear(data) & MASK) == 0) + 1
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    doc = np.searchsorted(offsets, ends, side="right") - 1
    # Bytes of the document before must not decide: the hash needs 16 bytes of its own.
    ends = ends[ends - offsets[doc] >= LEAST_CHUNK]
    ends = ends[np.diff(ends, prepend=-LEAST_CHUNK) >= LEAST_CHUNK]
    cuts = np.unique(np.concatenate([ends, offsets]))
    size = np.diff(cuts)
    long = np.flatnonzero(size > MOST_CHUNK)
    if len(long):
        n = (size[long] - 1) // MOST_CHUNK
        more = np.repeat(cuts[long], n) + MOST_CHUNK * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        for _ in range(3):  # never between the bytes of one character
            more = more - ((data[more] & 0xC0) == 0x80)
        cuts = np.unique(np.concatenate([cuts, more]))
    start, end = cuts[:-1], cuts[1:]
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.stack([span_hashes(data, start, end), span_hashes(_SECOND[data], start, end)], axis=1)


def _chunks(tbl: pa.Table):
    """Document row, start, end and digest of all chunks of a batch, and its bytes."""
    data, offsets = buffers(tbl.column("text"))
    out = []
    for a, z in slices(offsets):
        part, at = data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]
        doc, start, end = boundaries(part, at)
        out.append((doc + a, start + offsets[a], end + offsets[a], digests(part, start, end)))
    doc, start, end, key = (np.concatenate([o[i] for o in out]) for i in range(4))
    return data, offsets, doc, start, end, key


def _first_of(key: np.ndarray, ids: np.ndarray):
    """(order, first of each distinct key in it, number of its distinct key for every chunk): smallest id first."""
    order = np.lexsort((ids, key[:, 1], key[:, 0]))
    first = np.ones(len(order), bool)
    first[1:] = (key[order][1:] != key[order][:-1]).any(axis=1)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(first) - 1
    return order, first, which


def send(n_parts: int):
    def run(tbl: pa.Table) -> pa.Table:
        _, _, doc, _, _, key = _chunks(tbl)
        ids = ids_of(tbl)[doc]
        order, first, _ = _first_of(key, ids)
        key, ids = key[order[first]], ids[order[first]]
        batch = number_of(tbl)
        return rows_table([(p, batch, k, d) for p, k, d in grouped(part_of(key[:, 0], n_parts), key, ids)], DIGESTS)
    return run


def answer(tbl: pa.Table) -> pa.Table:
    """To every batch those of its digests that another batch holds in a document with a smaller id."""
    key, ids = numbers(tbl, "keys").reshape(-1, 2), numbers(tbl, "docs", np.int64)
    batch = np.repeat(tbl.column("batch").to_numpy(), counts(tbl, "docs"))
    order, first, which = _first_of(key, ids)
    late = ids > ids[order[first]][which]
    return rows_table(grouped(batch[late], key[late]), EARLIER)


def remove(least: int):
    def run(docs: pa.Table, earlier: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return rows_table([], RESULT)
        data, offsets, doc, start, end, key = _chunks(docs)
        row_ids = ids_of(docs)
        ids = row_ids[doc]
        seen = numbers(earlier, "keys").reshape(-1, 2)
        # A known digest stands before all: its first document is smaller than any here.
        both_key = np.concatenate([seen, key])
        both_id = np.concatenate([np.full(len(seen), np.iinfo(np.int64).min), ids])
        order, first, which = _first_of(both_key, both_id)
        head = both_id[order[first]][which[len(seen):]]
        late = ids > head
        # Of a digest's chunks within one document all but the first are late.
        order = np.lexsort((start, doc, which[len(seen):]))
        w, d = which[len(seen):][order], doc[order]
        again = np.zeros(len(order), bool)
        again[1:] = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
        late[order] |= again
        # Runs of late chunks within a document.
        rows, per_doc = [], np.searchsorted(doc, np.arange(docs.num_rows + 1))
        for i in range(docs.num_rows):
            lo, hi = per_doc[i], per_doc[i + 1]
            a, z = offsets[i], offsets[i + 1]
            flags = late[lo:hi]
            if not flags.any():
                rows.append((row_ids[i], z - a, hi - lo, 0, [], [], data[a:z].tobytes()))
                continue
            change = np.flatnonzero(np.diff(flags, prepend=False, append=False))
            begin, stop = start[lo:hi][change[0::2]] - a, end[lo:hi][change[1::2] - 1] - a
            enough = stop - begin >= least
            begin, stop = begin[enough], stop[enough]
            keep_from, keep_to = np.append(0, stop), np.append(begin, z - a)
            kept = b"".join(data[a + x:a + y].tobytes() for x, y in zip(keep_from, keep_to))
            rows.append((row_ids[i], z - a, hi - lo, int((stop - begin).sum()), begin, stop, kept))
        out = rows_table(rows, RESULT)
        return out.set_column(0, "doc_id", docs.column("doc_id").combine_chunks())
    return run


def deduplicate(docs: DataFrame, least: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, the removed spans (starts, ends in bytes) and the kept text of every row."""
    batched, n = in_batches(docs), parts(docs)
    sent = batched.groupBy(BATCH).applyInArrow(send(n), ddl(DIGESTS))
    earlier = sent.groupBy("part").applyInArrow(answer, ddl(EARLIER))
    return batched.groupBy(BATCH).cogroup(earlier.groupBy("batch")).applyInArrow(remove(least), ddl(RESULT))
