"""Best-fit packing by minimum bin slack.

A plan depends on the counts of piece lengths alone, so the pieces are counted by length (at most ``capacity`` numbers),
the plan is made from those counts, and the pieces are then placed in parallel by their rank within their length.

The plan fills bin after bin: the longest length left opens it, and a subset-sum over the lengths still available, kept
as the bits of one integer, finds the fullest combination for the rest. The combination is used as often as the counts
allow and its pieces are removed.

Defined cases: a null or empty text is the closing id alone; a null ``doc_id`` is carried along; repeated rows are
packed each; a very long text is encoded whole, in a slice of its own, and then cut; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, for_python, shuffle_width, slices, stored

CAPACITY = 2048
#: Words whose ids a worker remembers; only time depends on it.
MEMORY = 400_000
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


#: A-Z become small letters and ASCII blanks one kind of blank, byte by byte.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\n\t\r" else b for b in range(256))
BLANKS = bytes(32 if b in b"\n\t\r" else b for b in range(256))
MARKS = b".,;:!?)\"'"


class WordIds:
    """Ids of a text as the tokenizer gives them, with the ids of each word between ASCII blanks remembered.

    The tokenizer splits at white space and drops it, so a text's ids are its words' ids in turn; blanks other than the
    ASCII ones stay within a word and reach the tokenizer unchanged. It also makes letters small and parts letters from what is
    neither letter nor digit, so words are remembered in small letters and without the marks behind their last letter. The names of
    special tokens in a text become their ids, as in a plain call; a word with ``<|`` reaches the tokenizer as it is."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        for first in range(0, len(new), 4096):
            part = new[first:first + 4096]
            for word, got in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[word] = array("I", got.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.translate(BLANKS if b"<|" in t else FOLDED).split(b" ") for t in texts]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        new = {w for row in split for w in row}.difference(known)
        marked = {}
        for w in new:
            stem = w.rstrip(MARKS)
            if len(stem) < len(w) and stem and b"<|" not in w and stem[-4:].decode(errors="ignore").lower()[-1:].isalpha():
                marked[w] = stem
        stems = {*marked.values(), *(w[len(stem):] for w, stem in marked.items())}.difference(known)
        self._learn(list((new - marked.keys()) | stems))
        for w, stem in marked.items():
            known[w] = known[stem] + known[w[len(stem):]]
        get = known.__getitem__
        return [b"".join(map(get, row)) for row in split]


_encoders: dict[str, WordIds] = {}


def encoder_of(path: str) -> WordIds:
    """The worker's encoder, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def tokenizer_path(file: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(file))


def _cutter(path: str, capacity: int, end: int):
    closing = np.array([end], "<u4").tobytes()

    def cut(batches):
        encoder = encoder_of(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = buffers(batch.column("text"))
            for a, z in slices(offsets):
                rows = []
                texts = [data[offsets[i]:offsets[i + 1]].tobytes() for i in range(a, z)]
                for doc_id, got in zip(ids[a:z], encoder.encode(texts)):
                    got += closing
                    n = len(got) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        part = got[4 * start:4 * (start + capacity)]
                        rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
    return cut


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Token pieces of every document: its ids and then ``end``, cut only where longer than ``capacity``."""
    docs = for_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(_cutter(path or tokenizer_path(), capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the sum is as near to ``room`` as the counts allow, longest lengths first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            more = (reach | reach << (times * length)) & mask
            if more != reach:
                steps.append((length, times, reach))
                reach = more
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= times * length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (length -> times, how many such bins)."""
    left, bins = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        bins.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def placements(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces of it per bin, first bin, offset of the first of them)."""
    rows, taken, base = [], {}, 0
    for used, times in bins:
        offset = 0
        for length in sorted(used, reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, first + used[length] * times - 1, used[length], base, offset))
            taken[length] = first + used[length] * times
            offset += used[length] * length
        base += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there. ``cut`` has doc_id, piece, start, length, ids_crc32.

    The rank within a length is taken in salted parts, so a length that a third of all pieces share is split."""
    spark = cut.sparkSession
    cut = stored(cut)
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(placements(plan(counts, capacity)), "length long, first long, last long, times long, base long, at long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_width(spark)))
    salted = cut.withColumn("salt", salt)
    part = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank).join(part, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # At most a few rows per length: the table is bounded by the capacity, whatever the corpus.
    placed = ranked.join(F.broadcast(table), "length").where("rank BETWEEN first AND last")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("base + (rank - first) DIV times").alias("sequence_id"),
                         F.expr("at + (rank - first) % times * length").alias("offset"))
