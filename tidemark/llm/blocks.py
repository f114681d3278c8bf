"""Documents in batches that talk through a shuffle.

Documents are dealt by a hash into batches of a few megabytes. A batch sends what it needs to know about (hashes, strings)
as messages to parts, a part sees all messages on its hashes, and answers go back to the batches that asked. Within a
batch each hash is sent once, however many of its documents hold it, so a passage that a third of all documents share
costs one number per batch. Parts follow the session's shuffle width; a message holds all that one batch has for one part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, buffers, ship, shuffle_width

BATCH_BYTES = 4 << 20
#: Sorts behind every document id: rows without one never precede another.
LAST = np.iinfo(np.int64).max


#: The column that numbers a document's batch, named so that no column carried along is likely to clash.
BATCH = "__batch"


def in_batches(docs: DataFrame, carried: list[str] = (), most: int = BATCH_BYTES) -> DataFrame:
    """doc_id, text, the columns carried along, and the number of the batch."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n
    return docs.withColumn(BATCH, F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(max(1, -(-total // most)))))


def parts(docs: DataFrame) -> int:
    return 4 * shuffle_width(docs.sparkSession)


def number_of(docs: pa.Table) -> int:
    return docs.column(BATCH)[0].as_py()


def ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "binary": "binary", "string": "string", "list<item: int64>": "array<bigint>"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(33)) % U64(n)).astype(np.int32)


def ids_of(tbl: pa.Table) -> np.ndarray:
    return tbl.column("doc_id").fill_null(LAST).to_numpy()


def numbers(tbl: pa.Table, name: str, dtype=U64) -> np.ndarray:
    """All numbers of a binary column end to end."""
    return np.frombuffer(buffers(tbl.column(name))[0].tobytes(), dtype)


def counts(tbl: pa.Table, name: str, width: int = 8) -> np.ndarray:
    """How many numbers each row of a binary column holds."""
    return np.diff(buffers(tbl.column(name))[1]) // width


def grouped(key: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(key value, bytes of each column's rows with it) for every value."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
    columns = [c[order] for c in columns]
    return [(int(key[a]), *(c[a:b].tobytes() for c in columns)) for a, b in zip(at[:-1], at[1:])]


def rows_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(starts) else starts, lengths)
    return data[shift + np.arange(total)] if total else data[:0]


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x
