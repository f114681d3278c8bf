"""Benchmark decontamination: short test items found inside long documents, with DataFrame functions only.

Containment is the share of an item's distinct shingles (five words, letters and digits lower-cased) that a document
holds. Items are partitioned by size into powers of two. A partition whose items have at most ``u`` shingles keeps of
each item its ``m = floor((1 - t) u) + 1`` smallest shingle hashes as MinHash sketch. A document that contains the share
``t`` of an item with ``n`` shingles lacks at most ``floor((1 - t) n)`` of them, so it holds at least ``m`` less that many of
the sketch: the search looks up every shingle of every document in the sketches, keeps the pairs with that many hits,
and loses none. The pairs left are verified on the exact shingle texts.

Defined cases: a text of fewer words is one shingle of all its words; texts without words, null texts and items with a
null id never match; rows that repeat a doc_id or an item_id count as one document or item; documents with a null doc_id
count as one document in ``leaks``, while ``clean`` judges each row by its own text; empty tables give no rows; columns besides the ids and
``text`` are not looked at, and are carried whatever their names. A very long text is one row of shingle hashes, exploded as it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import masked, restored

#: Rows of sketches that may be broadcast (24 bytes each); a larger benchmark is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: str, k: int) -> Column:
    """A 64-bit hash of every run of k words, chained from word hashes; needs the column ``words``."""
    n = F.size(words)
    each = F.transform(words, lambda w: F.xxhash64(w))
    chained = each
    for i in range(2, k + 1):
        length = F.greatest(n - (i - 1), F.lit(0))
        chained = F.zip_with(F.slice(chained, F.lit(1), length), F.slice(each, F.lit(i), length), lambda x, y: F.xxhash64(x, y))
    return F.when(n >= k, chained).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: str, k: int) -> Column:
    """The distinct runs of k words as text."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(k))))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(item_id, texts, n) per item, and (hash, item_id, needed) with the hits that a pair needs."""
    worded = items.where("item_id IS NOT NULL").select("item_id", word_list(F.col("text")).alias("words"))
    made = worded.select("item_id", shingle_hashes("words", k).alias("h"), shingle_texts("words", k).alias("s"))
    made = made.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("h"))).alias("h"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("texts"))
    made = made.where(F.size("h") > 0)
    missing = lambda size: F.floor(size * (100 - percent) / 100).cast("int")
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("h"))))
    made = made.withColumn("m", missing(upper) + 1)
    sketch = made.select("item_id", F.explode(F.slice(F.array_sort("h"), F.lit(1), F.col("m"))).alias("hash"),
                         (F.least("m", F.size("h")) - missing(F.size("h"))).alias("needed"))
    return made.select("item_id", "texts", F.size("texts").cast("long").alias("n")), sketch


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared and containment of every pair with at least ``percent`` contained."""
    made, sketch = sketches(items.select("item_id", "text"), k, percent)
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    worded = docs.select("doc_id", word_list(F.col("text")).alias("words"))
    looked = worded.select("doc_id", F.explode(shingle_hashes("words", k)).alias("hash"))
    hits = looked.join(sketch, "hash").groupBy("doc_id", "item_id", "needed").agg(F.count_distinct("hash").alias("hits"))
    pairs = hits.where("hits >= needed").select(F.col("doc_id").alias("d"), "item_id").join(made, "item_id")
    texts = docs.select("doc_id", "text").join(pairs, F.col("doc_id").eqNullSafe(F.col("d")))
    shared = texts.select("doc_id", "item_id", "n", "texts", word_list(F.col("text")).alias("words"))
    shared = shared.select("doc_id", "item_id", "n", F.array_intersect("texts", shingle_texts("words", k)).alias("found"))
    found = shared.groupBy("doc_id", "item_id", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("n_shared"))
    return (found.where(F.col("n_shared") * 100 >= F.col("n") * percent)
            .select("doc_id", "item_id", F.col("n").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")))


def row_key() -> Column:
    """Tells rows apart that share a doc_id or have none: the id, the checksum and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.crc32(text), F.xxhash64(text))


def clean(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that hold no item, with all their columns. A document is judged by its own text, whatever rows share its id."""
    hidden, names = masked(docs)
    found = leaks(hidden.select(row_key().alias("doc_id"), "text"), items, k, percent).select(F.col("doc_id").alias("row_key")).distinct()
    return restored(hidden.withColumn("own_key", row_key()).join(found, F.col("own_key") == F.col("row_key"), "left_anti"), names)
