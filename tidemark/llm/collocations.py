"""Phrase collocations counted in quotient filters.

1. *Shelves*: every task cuts its texts into pieces and words and keeps a few megabytes of one language as a shelf: word numbers
   of its own, -1 between pieces. The texts are read once and never shuffled.
2. *Words*: a shelf sends each of its words once, with its count, to the part that the word's hash names; a part adds up, gives an
   id to the words that are frequent enough and answers the shelves. A phrase is only as frequent as its rarest word, so other
   words end phrases from here on.
3. *Pairs*: a shelf counts its pairs of neighbouring ids in one quotient filter per shard; a shard merges its filters and answers
   which entries of each are frequent.
4. *Longer phrases* of up to ``longest`` words all of whose pairs are frequent are counted and merged in the same way.
5. *Scores* come from joins on the candidates alone. The lowest cut of each candidate counts, and a candidate goes if one with one
   more word is as frequent: any longer one that is has such a one between.

A word, or phrase, of every text costs one number per shelf, and no row is sent per occurrence. The size of a shelf grows with the
root of the corpus; parts and shards follow the amount counted. Filters are lossless, so nothing is approximate.

Defined cases: a null text is empty; a null language is ``und``; texts without words count for nothing; rows that repeat count each;
a language without candidates has no rows; an empty table gives no rows; columns besides ``text`` and ``lang`` are not looked at. A very
long text stands in a shelf of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import quotient
from tidemark.llm.blocks import gather, rows_table
from tidemark.llm.common import buffers, for_python, forget, shuffle_width, slices, span_hashes, stored

#: Bytes of text in a shelf: this many times the root of all bytes, within bounds that keep a task small.
SHELF_FACTOR, SHELF_LEAST, SHELF_MOST = 128, 4 << 20, 32 << 20
#: Bytes of words that a part adds up, and phrase places that a shard counts.
PART_BYTES, SHARD_PLACES = 8 << 20, 1 << 20
#: A-Z become small letters, ends of pieces become newlines, and blanks one kind of blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
SHELVES = pa.schema([("lang", pa.string()), ("codes", pa.binary()), ("words", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("n_bytes", pa.int64())])
WORDS = pa.schema([("shelf", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("number", pa.int64()), ("f", pa.int64()), ("places", pa.binary()), ("numbers", pa.binary())])
FILTERS = pa.schema([("size", pa.int32()), ("shard", pa.int64()), ("shelf", pa.int64()), ("filter", pa.binary())])
PHRASES = pa.schema([("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("f", pa.int64()), ("shelf", pa.int64()), ("shard", pa.int64()), ("frequent", pa.binary())])


class _Numbers(dict):
    """Numbers words in the order of their first use. Numbers 0 and 1 are the empty word and the end of a piece."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Shelf:
    def __init__(self):
        self.words, self.codes, self.size = _Numbers({b"": 0, b"\n": 1}), [], 0

    def add(self, raw: bytes):
        tokens = raw.translate(FOLDED).replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))
        self.codes.append(codes[codes > 0])
        self.size += len(raw)

    def row(self, lang: str) -> tuple | None:
        """Codes count from 0 for the first word; ends of pieces are -1."""
        codes = np.concatenate(self.codes) - 2
        words = list(self.words)[2:]
        if not words:
            return None
        counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype("<u4")
        small = np.uint16 if len(words) < 1 << 16 else np.uint32  # the highest number stands for -1
        return lang, codes.astype(small).tobytes(), b"".join(words), np.array(list(map(len, words)), "<u4").tobytes(), counts.tobytes(), int(counts.sum()), self.size


def _codes(raw: bytes, n_words: int) -> np.ndarray:
    small = np.uint16 if n_words < 1 << 16 else np.uint32
    codes = np.frombuffer(raw, small).astype(np.int64)
    codes[codes == np.iinfo(small).max] = -1
    return codes


def shelves(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per shelf with a number of its own."""
    docs = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    most = int(min(SHELF_MOST, max(SHELF_LEAST, SHELF_FACTOR * total ** 0.5)))

    def fill(batches):
        open_shelves: dict[str, _Shelf] = {}

        def emptied(names):
            rows = [open_shelves.pop(name).row(name) for name in names]
            return rows_table([r for r in rows if r], SHELVES).to_batches()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            langs = batch.column("lang")
            for a, z in slices(offsets):
                part = langs.slice(a, z - a).dictionary_encode()
                which = np.asarray(part.indices)
                for k, name in enumerate(part.dictionary.to_pylist()):
                    rows = np.flatnonzero(which == k) + a
                    shelf = open_shelves.setdefault(name, _Shelf())
                    shelf.add(b"".join(x for i in rows for x in (data[offsets[i]:offsets[i + 1]].tobytes(), b"\n")))
                while sum(s.size for s in open_shelves.values()) >= most:  # the fullest go first
                    yield from emptied([max(open_shelves, key=lambda name: open_shelves[name].size)])
        yield from emptied(list(open_shelves))
    rows = for_python(docs).mapInArrow(fill, "lang string, codes binary, words binary, lengths binary, counts binary, n long, n_bytes long")
    return stored(rows.withColumn("shelf", F.monotonically_increasing_id()))


def frequent_words(kept: DataFrame, least: int) -> DataFrame:
    """Rows of two kinds: (lang, word, number, f) of frequent words, and (shelf, places, numbers) as answers to the shelves."""
    total = kept.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first().n
    n_parts = max(shuffle_width(kept.sparkSession), -(-total // PART_BYTES))

    def ask(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                lengths, counts = np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["counts"], "<u4")
                data, ends = np.frombuffer(row["words"], np.uint8), np.cumsum(lengths)
                part = (span_hashes(data, ends - lengths, ends) >> np.uint64(24)) % np.uint64(n_parts)
                order = np.argsort(part, kind="stable")
                at = np.flatnonzero(np.diff(part[order], prepend=np.uint64(n_parts)))
                out = []
                for a, z in zip(at, np.append(at[1:], len(order))):
                    some = order[a:z]
                    out.append((int(part[some[0]]), row["shelf"], row["lang"], some.astype("<u4").tobytes(), gather(data, (ends - lengths)[some], lengths[some]).tobytes(), lengths[some].astype("<u4").tobytes(), counts[some].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["part", "shelf", "lang", "places", "words", "lengths", "counts"])

    def add_up(tbl: pa.Table) -> pa.Table:
        part, totals, asked = tbl.column("part")[0].as_py(), {}, []
        for row in sorted(tbl.to_pylist(), key=lambda r: r["shelf"]):
            ends = np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64)).tolist()
            raw, lang = row["words"], row["lang"]
            words = [(lang, raw[a:z]) for a, z in zip([0, *ends], ends)]
            for word, n in zip(words, np.frombuffer(row["counts"], "<u4").tolist()):
                totals[word] = totals.get(word, 0) + n
            asked.append((row["shelf"], np.frombuffer(row["places"], "<u4"), words))
        frequent = sorted(w for w, n in totals.items() if n >= least)
        numbers = {w: i * n_parts + part for i, w in enumerate(frequent)}
        out = [(None, lang, word, numbers[lang, word], totals[lang, word], None, None) for lang, word in frequent]
        for shelf, places, words in asked:
            got = np.array([numbers.get(w, -1) for w in words], np.int64)
            if (got >= 0).any():
                out.append((shelf, None, None, None, None, places[got >= 0].tobytes(), got[got >= 0].astype("<u4").tobytes()))
        return rows_table(out, WORDS)
    asked = kept.select("shelf", "lang", "words", "lengths", "counts").mapInArrow(ask, "part long, shelf long, lang string, places binary, words binary, lengths binary, counts binary")
    return stored(asked.groupBy("part").applyInArrow(add_up, "shelf long, lang string, word binary, number long, f long, places binary, numbers binary"))


def _ids_of(shelf: pa.Table, answers: pa.Table) -> np.ndarray:
    """Ids along the shelf's codes; -1 for rare words and ends of pieces."""
    row = shelf.to_pylist()[0]
    n_words = len(row["lengths"]) // 4
    number = np.full(n_words + 1, -1, np.int64)
    for r in answers.to_pylist():
        if r["places"] is not None:
            number[np.frombuffer(r["places"], "<u4")] = np.frombuffer(r["numbers"], "<u4")
    return number[_codes(row["codes"], n_words)]


def _runs_of(flags: np.ndarray, n: int) -> np.ndarray:
    """Places from which n flags in a row hold."""
    if len(flags) < n:
        return np.zeros(0, np.int64)
    out = flags[:len(flags) - n + 1].copy()
    for i in range(1, n):
        out &= flags[i:len(flags) - n + 1 + i]
    return np.flatnonzero(out)


def _counted_at(ids: np.ndarray, places: np.ndarray, layout: quotient.Layout):
    """Permuted distinct keys of the phrases at these places in order, their counts, and which of them each place has."""
    return quotient.counted(layout.permute(layout.pack([ids[places + i] for i in range(layout.n)])), places=True)


def _filters(lanes, counts, layout: quotient.Layout, shelf: int, n_shards: int) -> list[tuple]:
    s = layout.shard_bits(n_shards)
    shard = layout.shard(lanes, s)
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    return [(layout.n, int(shard[a]), shelf, quotient.dump(layout, [lane[a:z] for lane in lanes], counts[a:z], s)) for a, z in zip(at, np.append(at[1:], len(shard)))]


def _merging(bits: int, n_shards: int, least: int):
    def merge(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by("shelf")
        size, shard = tbl.column("size")[0].as_py(), tbl.column("shard")[0].as_py()
        layout = quotient.Layout(size, bits)
        s = layout.shard_bits(n_shards)
        loaded = [quotient.load(layout, x.as_py(), shard, s) for x in tbl.column("filter")]
        lanes, counts, where = quotient.merge(loaded, places=True)
        often = counts >= least
        ids = layout.unpack(layout.restore([lane[often] for lane in lanes]))
        out = [(size, row, n, None, None, None) for row, n in zip(ids.tolist(), counts[often].tolist())]
        if size == 2:  # answers for longer phrases
            at = np.cumsum([0] + [len(c) for _, c in loaded])
            for shelf, a, z in zip(tbl.column("shelf").to_pylist(), at[:-1], at[1:]):
                flags = often[where[a:z]]
                if flags.any():
                    out.append((size, None, None, shelf, shard, np.packbits(flags).tobytes()))
        return rows_table(out, PHRASES)
    return merge


def phrases(kept: DataFrame, words: DataFrame, least: int, longest: int) -> DataFrame:
    """size, ids and f of all phrases of two words and more that are frequent."""
    top = words.agg(F.max("number").alias("n")).first().n
    n_places = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    bits, n_shards = max(1, int(top or 0).bit_length()), max(1, -(-n_places // SHARD_PLACES))
    answers = words.where("shelf IS NOT NULL").select("shelf", "places", "numbers")
    codes = kept.select("shelf", "codes", "lengths")
    two = quotient.Layout(2, bits)
    schema = "size int, ids array<long>, f long, shelf long, shard long, frequent binary"
    filters = "size int, shard long, shelf long, filter binary"

    def count_pairs(shelf: pa.Table, known: pa.Table) -> pa.Table:
        if not shelf.num_rows or not known.num_rows:
            return rows_table([], FILTERS)
        ids = _ids_of(shelf, known)
        lanes, counts, _ = _counted_at(ids, _runs_of(ids >= 0, 2), two)
        return rows_table(_filters(lanes, counts, two, shelf.column("shelf")[0].as_py(), n_shards), FILTERS)

    def count_longer(shelf: pa.Table, known: pa.Table) -> pa.Table:
        if not shelf.num_rows or not known.num_rows:
            return rows_table([], FILTERS)
        ids, number = _ids_of(shelf, known), shelf.column("shelf")[0].as_py()
        places = _runs_of(ids >= 0, 2)
        lanes, _, where = _counted_at(ids, places, two)
        shard, often = two.shard(lanes, two.shard_bits(n_shards)), np.zeros(len(lanes[0]), bool)
        for r in known.to_pylist():
            if r["frequent"] is not None:
                a, z = np.searchsorted(shard, r["shard"]), np.searchsorted(shard, r["shard"], side="right")
                often[a:z] = np.unpackbits(np.frombuffer(r["frequent"], np.uint8), count=z - a).astype(bool)
        pair = np.zeros(len(ids), bool)
        pair[places] = often[where]
        out = []
        for n in range(3, longest + 1):
            layout = quotient.Layout(n, bits)
            lanes, counts, _ = _counted_at(ids, _runs_of(pair, n - 1), layout)
            out += _filters(lanes, counts, layout, number, n_shards)
        return rows_table(out, FILTERS)
    by_shelf = codes.groupBy("shelf")
    pairs = by_shelf.cogroup(answers.groupBy("shelf")).applyInArrow(count_pairs, filters)
    pairs = stored(pairs.groupBy("size", "shard").applyInArrow(_merging(bits, n_shards, least), schema))
    if longest < 3:
        return pairs.where("ids IS NOT NULL").select("size", "ids", "f")
    answers = answers.select("shelf", "places", "numbers", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("frequent"))
    flags = pairs.where("shelf IS NOT NULL").select("shelf", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("numbers"), "shard", "frequent")
    longer = by_shelf.cogroup(answers.unionByName(flags).groupBy("shelf")).applyInArrow(count_longer, filters)
    longer = stored(longer.groupBy("size", "shard").applyInArrow(_merging(bits, n_shards, least), schema))
    return pairs.unionByName(longer).where("ids IS NOT NULL").select("size", "ids", "f")


def ratio(a: str = "a", n: str = "n", left: str = "l", right: str = "r") -> Column:
    """floor(1000 * a * n / (l * r)) in whole numbers of up to 38 digits."""
    a, n, left, right = (f"CAST({x} AS DECIMAL(38, 0))" for x in (a, n, left, right))
    return F.expr(f"(CAST(1000 AS DECIMAL(38, 0)) * {a} * {n}) div ({left} * {right})")


def _first(rows: DataFrame, k: int, order: list[Column], ties: bool) -> DataFrame:
    """The first k rows of each language, cut in salted groups first. With ``ties`` all rows like the k-th stay."""
    place = F.rank() if ties else F.row_number()
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("ids"), F.lit(shuffle_width(rows.sparkSession)))).orderBy(*order)
    rows = rows.withColumn("rank", place.over(salted)).where(F.col("rank") <= k)
    return rows.withColumn("rank", place.over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= k)


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, its count a, the counts l and r of the two sides of its lowest cut, the language's words n, and score."""
    kept = shelves(docs, text, lang)
    words = frequent_words(kept, least)
    found = stored(phrases(kept, words, least, longest))
    sums = kept.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where("word IS NOT NULL").select("lang", "word", "number", "f")
    # Candidates that one with one more word repeats.
    covered = found.where("size > 2").select(F.explode(F.array(F.expr("slice(ids, 1, size - 1)"), F.expr("slice(ids, 2, size - 1)"))).alias("ids"), "f").distinct()
    left = found.join(covered, ["ids", "f"], "left_anti")
    counts = found.select("ids", "f").unionByName(words.select(F.array("number").alias("ids"), "f"))
    cuts = left.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select("ids", F.col("f").alias("a"), "k", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, size - k)").alias("tail"))
    cuts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    cuts = cuts.join(words.select(F.col("number").alias("first"), "lang"), F.col("ids")[0] == F.col("first")).join(sums, "lang")
    least_cut = cuts.withColumn("score", ratio()).groupBy("ids", "lang", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "lang", "n", "a", "cut.score", "cut.l", "cut.r")
    best = stored(_first(least_cut, top, [F.desc("score"), F.desc("a")], ties=True).drop("rank"))
    spelled = best.select("ids", F.posexplode("ids").alias("at", "number")).join(words.select("number", "word"), "number").groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = best.join(spelled, "ids").withColumn("phrase", F.array_join(F.transform("w", lambda x: x["word"].cast("string")), " "))
    out = _first(named, top, [F.desc("score"), F.desc("a"), F.asc("phrase")], ties=False)
    forget(kept)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
