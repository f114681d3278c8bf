"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of ``shingle`` words, lower-cased in A-Z. Under each permutation both the
smallest and the largest value are kept, so 48 hash evaluations give 96 values, banded by four. Documents of one band
are candidates, and every candidate pair that counts is confirmed on the full sets.

1. Documents with equal sets form one class; only classes are compared, so exact copies cost nothing further.
2. In each band every class meets a hub, the class that shares bands with most others. Confirmed links give components.
3. Bands that still hold several components, joined into clusters where they share classes, are compared in pairs of blocks of classes by
   products of incidence matrices. No pair of classes is ever a row; only links that join two components come out.

At a similarity of 0.8 a pair shares none of the 24 bands with probability 3e-6.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; a shorter text is one shingle
of all its words; rows that repeat a doc_id are rows of their own, each in the component of its own set; a null doc_id
names no component, but its text links others as any text does; a very long text is one set, made in a slice of its own; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, U64, buffers, for_python, forget, mix, shingle_hashes, slices, span_hashes, stored, unsigned_crc, words
from tidemark.llm.components import components

PERMUTATIONS, ROWS, SEED = 48, 4, 20240611
#: Classes in a block of a cluster, and columns of an incidence matrix at a time.
BLOCK, COLUMNS = 512, 8192


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def document_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, end to end, with their bounds."""
    data = LOWER[data]
    starts, ends = words(data, offsets)
    hashes, at = shingle_hashes(span_hashes(data, starts, ends), np.searchsorted(starts, offsets), shingle)
    parts = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else hashes), bounds


def signatures(sets: np.ndarray, bounds: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Smallest and largest value of every non-empty set under each permutation, minima first."""
    out = np.empty((len(bounds) - 1, 2 * len(multipliers)), U64)
    at = bounds[:-1]
    for i, m in enumerate(multipliers):
        # Odd multiplication, fold and odd multiplication again permute the 64-bit numbers.
        v = sets * m
        v ^= v >> U64(32)
        v *= U64(0x9FB21C651E98DF25)
        out[:, i] = np.minimum.reduceat(v, at)
        out[:, len(multipliers) + i] = np.maximum.reduceat(v, at)
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    n, width = signature.shape
    bands = signature.reshape(n, width // rows, rows)
    key = np.broadcast_to(np.arange(width // rows, dtype=U64) * U64(0x9E3779B97F4A7C15), bands.shape[:2]).copy()
    for i in range(rows):
        key = mix(key ^ bands[:, :, i])
    return key


def digests(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    import hashlib
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]


def _describe(shingle: int):
    multipliers = permutations()

    def describe(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, z in slices(offsets):
                sets, bounds = document_sets(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a], shingle)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes > 0)
                keys: list = [None] * (z - a)
                if len(full):
                    found = band_keys(signatures(sets, np.append(bounds[:-1][full], len(sets)), multipliers)).view(np.int64)
                    for i, row in zip(full, found):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), batch.column("text_crc32").slice(a, z - a), batch.column("text_hash").slice(a, z - a), pa.array(sizes), pa.array(digests(sets, bounds), pa.binary()),
                                                  pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_crc32", "text_hash", "n", "class", "bands"])
    return describe


def _read_sets(shingle: int):
    def read(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            wanted = batch.column("class").to_pylist()
            for a, z in slices(offsets):
                sets, bounds = document_sets(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a], shingle)
                got = digests(sets, bounds)
                keep = [i for i in range(z - a) if got[i] == wanted[a + i]]
                yield pa.RecordBatch.from_arrays([pa.array([got[i] for i in keep], pa.binary()), pa.array([sets[bounds[i]:bounds[i + 1]].tobytes() for i in keep], pa.binary())], ["class", "s"])
    return read


def _confirm(numerator: int, denominator: int):
    def confirm(batches):
        for batch in batches:
            x, y = batch.column("s"), batch.column("t")
            keep = np.zeros(batch.num_rows, bool)
            last, left = None, None
            for i in range(batch.num_rows):
                raw = x[i].as_py()
                if raw is not last:
                    last, left = raw, np.frombuffer(raw, U64)
                right = np.frombuffer(y[i].as_py(), U64)
                both = np.concatenate([left, right])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = denominator * shared >= numerator * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])
    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub a, class b) whose full sets share at least ``percent`` of a hundred of their union.

    The set of b travels with its pair. That of a hub is sent once and meets its pairs in a join whose large keys are split."""
    first = sets.select(F.col("class").alias("a"), "s")
    second = sets.select(F.col("class").alias("b"), F.col("s").alias("t"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "s", "t").mapInArrow(_confirm(percent, 100), "a binary, b binary")


def text_hash() -> Column:
    """Tells the texts under one doc_id, or under none, apart; a null counts as an empty text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _star(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the classes of each band to its hub. An aggregation finds the hub, so a band of any size is dealt with in parts."""
    hubs = left.groupBy("band").agg(F.max(F.struct("weight", "class", "n")).alias("hub")).select("band", F.col("hub.class").alias("a"), F.col("hub.n").alias("an"))
    fits = F.greatest("n", "an") * percent <= F.least("n", "an") * 100
    pairs = stored(left.join(hubs, "band").where((F.col("class") != F.col("a")) & fits).select("a", F.col("class").alias("b")).distinct())
    links = stored(confirmed(pairs, sets, percent))
    forget(pairs)
    return links


def _moved(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(class, root) after the components that the links join are one. The links go between classes."""
    ends = [roots.select(F.col("class").alias(x), F.col("root").alias(f"{x}r")) for x in "ab"]
    joined = components(links.join(ends[0], "a").join(ends[1], "b").select(F.col("ar").alias("a"), F.col("br").alias("b")))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return stored(roots.join(moved, "root", "left").select("class", F.coalesce("to", "root").alias("root")))


def _shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many members each set of one block shares with each of another, by products of slices of their incidence matrices."""
    sides = []
    for sets in (one, two):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sides.append((row, np.concatenate(sets)))
    known = np.intersect1d(sides[0][1], sides[1][1])
    shared = np.zeros((len(one), len(two)), np.float32)
    places = [np.searchsorted(known, values) for _, values in sides]
    there = [np.minimum(p, max(len(known) - 1, 0)) for p in places]
    there = [known[p] == values if len(known) else np.zeros(len(values), bool) for p, (_, values) in zip(there, sides)]
    for first in range(0, len(known), COLUMNS):
        slabs = []
        for (row, _), place, ok, n in zip(sides, places, there, shared.shape):
            inside = ok & (place >= first) & (place < first + COLUMNS)
            slab = np.zeros((n, min(COLUMNS, len(known) - first)), np.float32)
            slab[row[inside], place[inside] - first] = 1
            slabs.append(slab)
        shared += slabs[0] @ slabs[1].T
    return shared


def _compare(percent: int):
    """Links between two blocks of classes of a cluster, as few as join what they join."""
    def run(tbl: pa.Table) -> pa.Table:
        first, last = tbl.column("i")[0].as_py(), tbl.column("j")[0].as_py()
        tbl = tbl.sort_by("class")
        names, own = np.array(tbl.column("class").to_pylist(), object), np.array(tbl.column("block").to_pylist())
        sets = [np.frombuffer(s.as_py(), U64) for s in tbl.column("s")]
        root = np.unique(np.array(tbl.column("root").to_pylist(), object), return_inverse=True)[1]
        sides = [np.flatnonzero(own == b) for b in (first, last)]
        out = []
        if all(len(side) for side in sides):
            size = [np.array([len(sets[i]) for i in side]) for side in sides]
            shared = _shared_counts(*([sets[i] for i in side] for side in sides))
            x, y = np.nonzero(shared * (100 + percent) >= percent * (size[0][:, None] + size[1]))
            ahead = list(range(root.max() + 1))

            def find(a):
                while ahead[a] != a:
                    ahead[a] = a = ahead[ahead[a]]
                return a
            x, y = sides[0][x], sides[1][y]
            new = root[x] != root[y]
            for i, j in zip(x[new], y[new]):
                a, b = find(root[i]), find(root[j])
                if a != b:
                    ahead[max(a, b)] = min(a, b)
                    out.append((names[i], names[j]))
        return pa.table([pa.array([o[k] for o in out], pa.binary()) for k in range(2)], ["a", "b"])
    return run


def _cluster_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the classes of bands that still hold several components.

    Bands that share classes are one cluster, whose classes are cut into blocks; every pair of blocks meets in a group of its own, which
    holds at most two blocks of sets. Pairs of classes are never rows, and a pair that met in several bands is compared once."""
    least = left.groupBy("band").agg(F.min("class").alias("b"))
    edges = left.join(least, "band").select(F.col("class").alias("a"), "b")
    cluster = components(edges).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    classes = stored(left.select("class", "root").distinct().join(cluster, "class"))
    sizes = classes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = classes.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    meeting = placed.join(sets, "class").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meeting = meeting.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "root", "s")
    found = stored(meeting.groupBy("cluster", "i", "j").applyInArrow(_compare(percent), "a binary, b binary"))
    forget(classes)
    return found


def _linked(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all classes that share a band. ``left``: band, class, n, weight.

    First every class meets its band's hub. Bands whose classes are then in one component are done; those of the others are compared
    in clusters."""
    roots = stored(left.select("class", F.col("class").alias("root")).distinct())
    links = _star(left, sets, percent)
    if links.limit(1).count():
        before, roots = roots, _moved(roots, links)
        forget(before)
    forget(links)
    rest = left.select("band", "class").join(roots, "class")
    several = rest.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("band")
    rest = stored(rest.join(several, "band", "left_semi"))
    forget(left)
    if rest.limit(1).count():
        links = _cluster_links(rest, sets, percent)
        if links.limit(1).count():
            before, roots = roots, _moved(roots, links)
            forget(before)
        forget(links)
    forget(rest)
    return roots.select(F.col("class").alias("node"), "root")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Every row with its class, the smallest doc_id of its component and the component's first row."""
    docs = for_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", unsigned_crc(F.col("text")).alias("text_crc32"), text_hash().alias("text_hash")))
    rows = stored(docs.mapInArrow(_describe(shingle), "doc_id long, text_crc32 long, text_hash long, n long, class binary, bands array<long>"))
    # A class's set is read from one of its rows: any that has its smallest doc_id, or any at all where none has an id.
    some = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash"))
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("rep"), some.alias("text_hash"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    members = classes.select(F.explode("bands").alias("band"), "class", "rep", "text_hash", "n")
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stored(members.join(shared, "band"))
    # A class that shares bands with many others is likely to be what they were copied from, so it is met first.
    weight = members.groupBy("class").agg(F.sum("c").alias("weight"))
    wanted = members.select("class", "rep", F.col("text_hash").alias("rep_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
    sets = stored(docs.join(wanted, same).select("text", "class").mapInArrow(_read_sets(shingle), "class binary, s binary").dropDuplicates(["class"]))
    left = stored(members.join(weight, "class").select("band", "class", "n", "weight"))
    forget(members)
    roots = _linked(left, sets, percent)
    forget(sets)
    named = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_crc32", "text_hash")).alias("first"))
    named = named.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"), F.min("first").alias("first"))
    named = named.select("class", "root").join(least, "root").select("class", "least", "first")
    return rows.drop("bands").join(named, "class", "left")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept, and the checksum of the text."""
    out = _grouped(docs, shingle, percent)
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_crc32")


def first_rows(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_crc32 and text_hash of every row, whether it has words, and whether it is its component's first by them,
    null ids last. Unlike ``kept`` this tells rows apart that share a doc_id or have none; exact copies of the first are first too."""
    out = _grouped(docs, shingle, percent)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_crc32", "text_hash")
    linked = F.col("class").isNotNull()
    return out.select("doc_id", "text_crc32", "text_hash", linked.alias("linked"), (~linked | own.eqNullSafe(F.col("first"))).alias("is_first"))
