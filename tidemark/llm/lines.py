"""Line deduplication by an exact set-similarity join.

A line's set holds its distinct lower-cased words. Later lines whose set is equal or similar (Jaccard of at least 0.8) to
an earlier line's are removed; earlier is by (doc_id, line), judged on the input and over the whole corpus. Lines without words
are blank and stay; lines of any other length take part (``least`` is 1), and those of fewer than five words go if they are equal.

1. Word frequencies over all lines, and for each distinct set its first line, are found through the parts.
2. The words of each first line are ordered by rarity (frequency, then hash). If two sets are similar enough, they share a
   word among the first ``n - ceil(0.8 n) + 1``; words that stand in one line only are dropped from this prefix.
3. Sets that share a prefix word meet in its part. Pairs pass the length filter, the positional filter (what can still be
   shared after this word) and a 64-bit signature's bound on the difference.
4. The sets of the pairs left are sent to the parts where they meet, once each, by half of every word's hash; pairs are never
   rows of a table. A word that many sets share is treated by products of blocks of their incidence matrix. For each set
   the earliest one found similar there is confirmed by whole hashes, and where that fails the whole part. Nothing is capped.

A batch of documents sends each word and each set once, so a line that a third of all documents hold costs one message
per batch. Sets are compared by 64-bit hashes of their words.

Defined cases: a null or empty text is one empty line; a null doc_id stands behind every other one; rows that repeat a
doc_id are ordered by their place in the batch; removing all lines leaves an empty text; columns besides doc_id and text
are carried along on request; an empty table gives no rows. A very long text is a batch of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import BATCH, counts, ddl, gather, grouped, ids_of, in_batches, number_of, numbers, part_of, parts, rows_table
from tidemark.llm.common import LOWER, U64, buffers, forget, mix, slices, span_hashes, stored, words

NEWLINE, MOST = 10, (1 << 32) - 1
#: Larger batches repeat fewer words between them.
BATCH_BYTES = 12 << 20
#: Sets of one prefix word from which they are compared by matrix products, and the sets in a block of these.
LARGE, BLOCK = 1024, 1024

ASKED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("times", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("lines", pa.binary())])
ANSWERED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("times", pa.binary()), ("later", pa.binary())])
PREFIXES = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("bits", pa.binary()), ("gone", pa.binary())])
MET = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("bits", pa.binary())])
SETS = pa.schema([("id", pa.int64()), ("doc", pa.int64()), ("line", pa.int64()), ("s", pa.binary())])


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document row, start and end of every line."""
    cuts = np.flatnonzero(data == NEWLINE)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    # A line break at a document's end opens an empty last line at the place where the next document begins.
    doc = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, side="right") - 1]), kind="stable")
    end = np.append(start[1:], len(data))
    return doc, start, np.where(np.append(doc[1:] == doc[:-1], False), end - 1, offsets[doc + 1])


def distinct_words(data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every line's distinct words in ascending order, line after line, and the lines' numbers."""
    begins, ends = words(data, offsets)
    h = span_hashes(data, begins, ends)
    line = np.searchsorted(start, begins, side="right") - 1
    short = (line.astype(U64) << U64(40)) | (h >> U64(24))
    order = np.argsort(short)
    h, line, short = h[order], line[order], short[order]
    if ((short[1:] == short[:-1]) & (h[1:] != h[:-1])).any():  # different words that agree in 40 bits
        order = np.lexsort((h, line))
        h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return h[new], line[new]


class Lines:
    """The lines of a batch: document row, place within it, byte span, and the distinct words of the lines long enough."""

    def __init__(self, tbl: pa.Table, least: int):
        self.data, self.offsets = buffers(tbl.column("text"))
        self.ids = ids_of(tbl)
        made = [self._slice(a, z, least) for a, z in slices(self.offsets)]
        self.row, self.start, self.end, size, key = (np.concatenate([m[i] for m in made]) for i in range(5))
        self.words = np.concatenate([m[5] for m in made])
        self.size, self.key = size, key
        self.at = np.concatenate([[0], np.cumsum(size)])
        first = np.searchsorted(self.row, np.arange(tbl.num_rows))
        self.place = np.arange(len(self.row)) - first[self.row]
        self.used = np.flatnonzero(size > 0)
        # The distinct sets in the order of their keys, and the first line of each.
        order = self.used[np.lexsort((self.place[self.used], self.row[self.used], self.ids[self.row[self.used]], key[self.used, 1], key[self.used, 0]))]
        head = np.ones(len(order), bool)
        head[1:] = (key[order][1:] != key[order][:-1]).any(axis=1)
        self.first, self.set_of = order[head], np.full(len(self.row), -1, np.int64)
        self.set_of[order] = np.cumsum(head) - 1

    def _slice(self, a: int, z: int, least: int):
        data, offsets = LOWER[self.data[self.offsets[a]:self.offsets[z]]], self.offsets[a:z + 1] - self.offsets[a]
        doc, start, end = split(data, offsets)
        h, line = distinct_words(data, offsets, start)
        size = np.bincount(line, minlength=len(start))
        keep = size >= least
        h = h[keep[line]]
        size = np.where(keep, size, 0)
        key = np.zeros((len(start), 2), U64)
        if len(h):
            at = np.concatenate([[0], np.cumsum(size[keep])])[:-1]
            key[keep, 0] = np.add.reduceat(mix(h), at)
            key[keep, 1] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), at)
        return doc + a, start + self.offsets[a], end + self.offsets[a], size, key, h


def ask(n_parts: int, least: int):
    def run(tbl: pa.Table) -> pa.Table:
        lines, batch = Lines(tbl, least), number_of(tbl)
        word, times = np.unique(lines.words, return_counts=True)
        key, at = lines.key[lines.first], lines.first
        asked = {p: (batch, w, t, b"", b"", b"") for p, w, t in grouped(part_of(word, n_parts), word, times.astype(np.uint32))}
        for p, k, d, n in grouped(part_of(key[:, 0], n_parts), key, lines.ids[lines.row[at]], lines.place[at]):
            asked[p] = (*asked.get(p, (batch, b"", b""))[:3], k, d, n)
        return rows_table([(p, *row) for p, row in asked.items()], ASKED)
    return run


def answer(tbl: pa.Table) -> pa.Table:
    """To every batch the frequencies of its words, in the order asked, and its sets whose first line another batch holds."""
    batches = tbl.column("batch").to_numpy()
    word, times = numbers(tbl, "words"), numbers(tbl, "times", np.uint32).astype(np.int64)
    _, which = np.unique(word, return_inverse=True)
    total = np.minimum(np.bincount(which, weights=times)[which], MOST) if len(word) else times
    frequencies = dict(grouped(np.repeat(batches, counts(tbl, "words")), total.astype(np.uint32)))
    key, doc, line = numbers(tbl, "keys").reshape(-1, 2), numbers(tbl, "docs", np.int64), numbers(tbl, "lines", np.int64)
    batch = np.repeat(batches, counts(tbl, "docs"))
    order = np.lexsort((batch, line, doc, key[:, 1], key[:, 0]))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (key[order][1:] == key[order][:-1]).all(axis=1)
    found = dict(grouped(batch[later], key[later]))
    part = tbl.column("part")[0].as_py()
    return rows_table([(part, b, frequencies.get(b, b""), found.get(b, b"")) for b in sorted({*frequencies, *found})], ANSWERED)


def _later(lines: Lines, answers: pa.Table) -> np.ndarray:
    """For each distinct set of the batch whether its first line is elsewhere."""
    seen, key = numbers(answers, "later").reshape(-1, 2), lines.key[lines.first]
    both = np.concatenate([seen, key])
    kind = np.concatenate([np.zeros(len(seen), np.int64), np.ones(len(key), np.int64)])
    order = np.lexsort((kind, both[:, 1], both[:, 0]))
    hit = np.zeros(len(order), bool)
    hit[order[1:]] = (both[order][1:] == both[order][:-1]).all(axis=1)
    return hit[len(seen):]


def required(size: np.ndarray, percent: int, of: int = 100) -> np.ndarray:
    return -(-percent * size // of)


def send_prefixes(n_parts: int, least: int, percent: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return rows_table([], PREFIXES)
        lines, batch = Lines(docs, least), number_of(docs)
        own = ~_later(lines, answers)
        # Every line with a set goes, but for the first lines of the sets that this batch has first.
        gone = lines.set_of >= 0
        gone[lines.first[own]] = False
        rows = [(None, batch, None, None, None, None, None, np.flatnonzero(gone).astype(np.uint32).tobytes())]
        at = lines.first[own]
        if not len(at):
            return rows_table(rows, PREFIXES)
        word, which_word = np.unique(lines.words, return_inverse=True)
        times = np.empty(len(word), np.int64)
        # The answers come by part, and within it in the order in which the words were sent.
        times[np.argsort(part_of(word, n_parts), kind="stable")] = numbers(answers.sort_by("part"), "times", np.uint32)
        rarity = np.empty(len(word), np.int64)
        rarity[np.lexsort((word, times))] = np.arange(len(word))
        size = lines.size[at]
        index, which = gather(which_word, lines.at[at], size), np.repeat(np.arange(len(at)), size)
        bits = np.bitwise_or.reduceat(U64(1) << (mix(word[index]) & U64(63)), np.cumsum(size) - size)
        index = index[np.argsort((which << 32) | rarity[index])]
        place = np.arange(len(index)) - np.repeat(np.cumsum(size) - size, size)
        keep = (times[index] > 1) & (place < (size - required(size, percent) + 1)[which])
        h, which, place = word[index[keep]], which[keep], place[keep]
        ids = (batch << 32) + at
        made = grouped(part_of(h, n_parts), h, ids[which], size[which].astype(np.uint32), place.astype(np.uint32), bits[which])
        return rows_table(rows + [(p, batch, *columns, None) for p, *columns in made], PREFIXES)
    return run


class Rows:
    """Prefix rows of one part, those of a word together and by size within it."""

    def __init__(self, tbl: pa.Table):
        word, size = numbers(tbl, "words"), numbers(tbl, "sizes", np.uint32).astype(np.int64)
        order = np.lexsort((size, word))
        self.word, self.size, self.ids = word[order], size[order], numbers(tbl, "ids", np.int64)[order]
        self.place, self.bits = numbers(tbl, "places", np.uint32).astype(np.int64)[order], numbers(tbl, "bits")[order]
        edge = np.flatnonzero(np.concatenate([[True], self.word[1:] != self.word[:-1]])) if len(word) else np.zeros(0, np.int64)
        self.edges = np.append(edge, len(word))
        self.large = np.repeat(np.diff(self.edges) > LARGE, np.diff(self.edges))

    def pairs(self, percent: int):
        """Pairs of rows of one word, but for the words of many sets, that pass the filters, the smaller set first."""
        n, x, step = len(self.word), np.flatnonzero(~self.large), 1
        while len(x):
            # Each row meets the next longer ones of its word, until the length filter ends its turn.
            x = x[x + step < n]
            y = x + step
            going = (self.word[x] == self.word[y]) & (percent * self.size[y] <= 100 * self.size[x])
            x, y = x[going], y[going]
            total = self.size[x] + self.size[y]
            reach = np.minimum(self.size[x] - self.place[x], self.size[y] - self.place[y])
            apart = np.bitwise_count(self.bits[x] ^ self.bits[y]).astype(np.int64)
            most = np.minimum(reach, (total - apart) // 2)
            # The smaller set must show the word even earlier: it has to share the larger part of both.
            early = self.place[x] <= self.size[x] - required(2 * self.size[x], percent, 100 + percent)
            good = early & ((100 + percent) * most >= percent * total)
            yield x[good], y[good]
            step += 1


def meet(percent: int):
    """The rows of a part that are in a pair; all rows of a word that many sets share."""
    def run(tbl: pa.Table) -> pa.Table:
        rows = Rows(tbl)
        keep = rows.large.copy()
        for x, y in rows.pairs(percent):
            keep[x] = keep[y] = True
        if not keep.any():
            return rows_table([], MET)
        columns = (rows.word, rows.ids, rows.size.astype(np.uint32), rows.place.astype(np.uint32), rows.bits)
        return rows_table([(tbl.column("part")[0].as_py(), *(c[keep].tobytes() for c in columns))], MET)
    return run


def confirm(percent: int, width: int):
    """Sets of a part to which an earlier one is similar, with the earliest such one. Words are compared by ``width`` bytes of
    their hashes: with fewer than all eight a set may be added, but none is lost."""
    def run(tbl: pa.Table, sets: pa.Table) -> pa.Table:
        if not tbl.num_rows or not sets.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, ["later", "earlier"])
        rows, sets = Rows(tbl), sets.sort_by("id").combine_chunks()
        ids = sets.column("id").to_numpy()
        which = np.searchsorted(ids, rows.ids)
        raw, offsets = buffers(sets.column("s"))
        at = offsets // width
        size = np.diff(at)
        word = np.unique(np.frombuffer(raw.tobytes(), f"<u{width}"), return_inverse=True)[1]
        turn = np.empty(len(ids), np.int64)
        turn[np.lexsort((ids, sets.column("line").to_numpy(), sets.column("doc").to_numpy()))] = np.arange(len(ids))
        best = np.full(len(ids), len(ids))

        def mark(i, j, shared):
            similar = (100 + percent) * shared >= percent * (size[i] + size[j])
            i, j = i[similar], j[similar]
            np.minimum.at(best, np.where(turn[i] > turn[j], i, j), np.minimum(turn[i], turn[j]))

        def compare(i, j):
            for a in range(0, len(i), 1 << 14):
                x, y = i[a:a + (1 << 14)], j[a:a + (1 << 14)]
                pair = np.arange(len(x))
                key = np.concatenate([np.repeat(pair, size[x]) << 32 | gather(word, at[x], size[x]), np.repeat(pair, size[y]) << 32 | gather(word, at[y], size[y])])
                key.sort()
                mark(x, y, np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=len(x)))

        found = [(which[x], which[y]) for x, y in rows.pairs(percent) if len(x)]
        if found:
            i, j = (np.concatenate(c) for c in zip(*found))
            pair = np.unique(np.minimum(i, j) << 32 | np.maximum(i, j))
            compare(pair >> 32, pair & 0xFFFFFFFF)
        for a, z in zip(rows.edges[:-1], rows.edges[1:]):
            if z - a > LARGE:
                _many(which[a:z], word, at, size, percent, mark)
        late = best < len(ids)
        return pa.table([pa.array(ids[late]), pa.array(ids[np.argsort(turn)][best[late]])], ["later", "earlier"])
    return run


def _many(group, word, at, size, percent, mark) -> None:
    """All similar pairs of many sets that share a word, from products of blocks of their incidence matrix. Words of one set
    only are left out. Sets come by size, so a block meets the later ones until they are too long for it."""
    group = group[np.argsort(size[group], kind="stable")]
    own = gather(word, at[group], size[group])
    known, column, times = np.unique(own, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row = np.repeat(np.arange(len(group)), size[group])[shared]
    column = place[column][shared]
    begin = np.searchsorted(row, np.arange(len(group) + 1))

    def block(a):
        z = min(a + BLOCK, len(group))
        out = np.zeros((z - a, int((times > 1).sum())), np.float32)
        out[row[begin[a]:begin[z]] - a, column[begin[a]:begin[z]]] = 1
        return out, group[a:z]
    for a in range(0, len(group), BLOCK):
        left, i = block(a)
        for b in range(a, len(group), BLOCK):
            if percent * size[group[b]] > 100 * size[i[-1]]:
                break
            right, j = block(b)
            x, y = np.nonzero(left @ right.T * (100 + percent) >= percent * (size[i][:, None] + size[j]))
            keep = i[x] != j[y]
            mark(i[x][keep], j[y][keep], size[i[x][keep]] + size[j[y][keep]])


def all_lines(docs: pa.Table):
    """Bytes, document row, start and end of all lines of a batch, numbered as in Lines, and each line's place."""
    data, offsets = buffers(docs.column("text"))
    made = [(*split(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]), a, offsets[a]) for a, z in slices(offsets)]
    row, start, end = np.concatenate([m[0] + m[3] for m in made]), np.concatenate([m[1] + m[4] for m in made]), np.concatenate([m[2] + m[4] for m in made])
    return data, row, start, end, np.arange(len(row)) - np.searchsorted(row, np.arange(docs.num_rows))[row]


def send_sets(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    if not docs.num_rows or not wanted.num_rows:
        return rows_table([], SETS)
    data, row, start, end, place = all_lines(docs)
    ids, asked = ids_of(docs), wanted.column("id").to_numpy()
    at = asked & 0xFFFFFFFF
    length, rows = end[at] - start[at], []
    cut = np.concatenate([[0], np.cumsum(length)])
    texts = LOWER[gather(data, start[at], length)]
    for a, z in slices(cut):
        h, line = distinct_words(texts[cut[a]:cut[z]], cut[a:z + 1] - cut[a], cut[a:z] - cut[a])
        edge = np.searchsorted(line, np.arange(z - a + 1))
        rows += [(asked[i], ids[row[at[i]]], place[at[i]], h[edge[i - a]:edge[i - a + 1]].tobytes()) for i in range(a, z)]
    return rows_table(rows, SETS)


def _confirmed(met: DataFrame, placed: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """(later, earlier) of every part: the sets are sent to the parts that want them, by ``width`` bytes a word."""
    sent = placed.join(sets.mapInArrow(_halved, sets.schema) if width == 4 else sets, "id")
    return met.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(confirm(percent, width), "later long, earlier long")


def _halved(batches):
    """Sets with the upper half of every word's hash."""
    for batch in batches:
        raw, offsets = buffers(batch.column("s"))
        half = np.frombuffer(raw.tobytes(), np.uint32)[1::2].tobytes()
        column = pa.array([half[a:b] for a, b in zip(offsets[:-1] // 2, offsets[1:] // 2)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], batch.schema.names)


def _equal_enough(percent: int):
    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("s", "t")]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                both = np.concatenate([np.frombuffer(c[i].as_py(), U64) for c in columns])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("later").filter(pa.array(keep))], ["id"])
    return run


def similar_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Ids of the later sets of the pairs (later, earlier) that are similar by whole hashes."""
    one, two = (sets.select(F.col("id").alias(x), F.col("s").alias(s)) for x, s in (("later", "s"), ("earlier", "t")))
    return pairs.join(one, "later").join(two, "earlier").select("later", "s", "t").mapInArrow(_equal_enough(percent), "id long").distinct()


def _ids(batches):
    """(part, id) of every set that a part wants."""
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist()):
            ids = np.unique(np.frombuffer(raw, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(ids)], ["part", "id"])


def _rebuild(names: list[str]):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([docs.schema.field(c) for c in names] + [("n_lines", pa.int64()), ("n_removed", pa.int64()), ("lines_removed", pa.list_(pa.int64()))])
        if not docs.num_rows:
            return rows_table([], schema)
        data, row, start, end, _ = all_lines(docs)
        removed = np.zeros(len(row), bool)
        removed[numbers(told, "gone", np.uint32)] = True
        removed[told.column("id").drop_null().to_numpy() & 0xFFFFFFFF] = True
        per_doc = np.searchsorted(row, np.arange(docs.num_rows + 1))
        texts, totals, dropped = docs.column("text").combine_chunks().to_pylist(), [], []
        for i in range(docs.num_rows):
            lo, hi = per_doc[i], per_doc[i + 1]
            drop = removed[lo:hi]
            totals.append(hi - lo)
            dropped.append(np.flatnonzero(drop))
            if drop.any():
                keep = lo + np.flatnonzero(~drop)
                texts[i] = b"\n".join(data[start[x]:end[x]].tobytes() for x in keep).decode()
        out = [pa.array(texts, pa.string()) if c == "text" else docs.column(c).combine_chunks() for c in names]
        return pa.table(out + [pa.array(totals, pa.int64()), pa.array([len(d) for d in dropped], pa.int64()), pa.array(dropped, pa.list_(pa.int64()))], schema=schema)
    return run


def deduplicate(docs: DataFrame, percent: int = 80, least: int = 1, carried: list[str] = ()) -> DataFrame:
    """doc_id, text without the removed lines, the columns carried along, n_lines, n_removed and the places removed."""
    batched, n = in_batches(docs, list(carried), BATCH_BYTES), parts(docs)
    by_batch = batched.groupBy(BATCH)
    answers = by_batch.applyInArrow(ask(n, least), ddl(ASKED)).groupBy("part").applyInArrow(answer, ddl(ANSWERED))
    sent = stored(by_batch.cogroup(answers.groupBy("batch")).applyInArrow(send_prefixes(n, least, percent), ddl(PREFIXES)))
    prefixes = sent.where("part IS NOT NULL").drop("batch", "gone")
    met, gone = stored(prefixes.groupBy("part").applyInArrow(meet(percent), ddl(MET))), stored(sent.where("part IS NULL").select("batch", "gone"))
    forget(sent)
    placed = stored(met.select("part", "ids").mapInArrow(_ids, "part int, id long"))
    wanted = placed.select("id").distinct().withColumn("batch", F.shiftright("id", 32))
    sets = stored(by_batch.cogroup(wanted.groupBy("batch")).applyInArrow(send_sets, ddl(SETS)))
    near = stored(_confirmed(met, placed, sets, percent, 4).groupBy("later").agg(F.min("earlier").alias("earlier")))
    sure = stored(similar_sets(near, sets, percent))
    # Where half of the hashes agreed by chance, all sets of the part are compared once more by whole hashes.
    unsure = near.select(F.col("later").alias("id")).join(sure, "id", "left_anti")
    again = placed.join(unsure, "id", "left_semi").select("part").distinct()
    rest = _confirmed(met.join(again, "part", "left_semi"), placed.join(again, "part", "left_semi"), sets, percent, 8)
    similar = stored(sure.unionByName(rest.select(F.col("later").alias("id"))).distinct())
    for spent in (met, placed, sets, near, sure):
        forget(spent)
    told = gone.select("batch", "gone", F.lit(None).cast("long").alias("id"))
    told = told.unionByName(similar.select(F.shiftright("id", 32).alias("batch"), F.lit(None).cast("binary").alias("gone"), "id"))
    names = ["doc_id", "text", *carried]
    schema = ", ".join(f"`{c}` {t}" for c, t in batched.dtypes if c in names) + ", n_lines long, n_removed long, lines_removed array<bigint>"
    return by_batch.cogroup(told.groupBy("batch")).applyInArrow(_rebuild(names), schema)
