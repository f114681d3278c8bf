"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, normalised and turned by one random rotation; the index keeps the signs of its coordinates as
packed bits, its distance to the centre and its alignment with its own code. Inner products with a query are estimated
from the bits and these scalars, together with a bound on the error. Distances from the estimates give each candidate a
lower and an upper bound; all whose lower bound is within the k-th smallest upper bound are ranked again exactly.

Queries meet the index in blocks: a block of codes is joined with every block of queries, and each pair of blocks gives
at most k rows per query.

Defined cases: rows with a null id, and vectors that are null, zero, of another than the commonest length or that hold a
null or a non-finite number, take no part; rows that repeat an id are candidates each, but never of the query with that
id; a repeated query id asks once, with its smallest vector; fewer candidates than k are all returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored

BLOCK, QUERY_BLOCK, SEED = 8192, 512, 20240607
#: Standard deviations that the error bound spans.
EPSILON = 3.0


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and vector of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (common[0].d if common else -1))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), d)


def centre_of(rows: DataFrame, d: int) -> np.ndarray:
    def sums(batches):
        total = np.zeros(d)
        for batch in batches:
            total += matrix(batch.column("v"), d).astype(np.float64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total)], ["i", "s"])
    parts = rows.select("v").mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    n, out = rows.count(), np.zeros(d)
    for r in parts.collect():
        out[r.i] = r.s / n
    return out


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distance to the centre, and alignment of the turned unit vector with its code."""
    diff = x.astype(np.float64) - centre
    radius = np.linalg.norm(diff, axis=1)
    unit = (diff / np.maximum(radius, 1e-300)[:, None]) @ turn
    align = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    align[radius == 0] = 1.0
    return np.packbits(unit > 0, axis=1), radius, align


def build_index(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding"):
    """(index rows: id, v, code, radius, align; centre; rotation). Every usable row is indexed."""
    ship(vectors.sparkSession)
    rows = usable(vectors, id_column, column)
    first = rows.select(F.size("v").alias("d")).first()
    d = first.d if first else 1
    centre, turn = centre_of(rows, d) if first else np.zeros(1), rotation(d)

    def codes(batches):
        for batch in batches:
            code, radius, align = encode(matrix(batch.column("v"), d), centre, turn)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(radius), pa.array(align)], ["id", "v", "code", "radius", "align"])
    return rows.mapInArrow(codes, "id long, v array<float>, code binary, radius double, align double"), centre, turn


def exact(columns: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, given as one double array per component, to one query; squares added in the order of the components."""
    total, diff = np.zeros(columns.shape[1]), np.empty(columns.shape[1])
    for column, value in zip(columns, q.astype(np.float64)):
        np.subtract(column, value, out=diff)
        diff *= diff
        total += diff
    return np.sqrt(total)


def search_block(ids, x, code, radius, align, query_ids, q, centre, turn, k, at_once=64):
    """The k nearest found of one block for every query: (query row, candidate row, distance). Estimates are made for ``at_once`` queries at a
    time; the candidates of a query are then ranked alone."""
    d, n = x.shape[1], len(ids)
    qdiff = q.astype(np.float64) - centre
    qr = np.linalg.norm(qdiff, axis=1)
    qunit = ((qdiff / np.maximum(qr, 1e-300)[:, None]) @ turn).astype(np.float32)
    signs = np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1
    error = EPSILON * np.sqrt(np.maximum(1 - align ** 2, 0)) / align / np.sqrt(max(d - 1, 1))
    columns = np.ascontiguousarray(x.T, dtype=np.float64)
    out = []
    for a in range(0, len(q), at_once):
        part = slice(a, a + at_once)
        inner = (qunit[part] @ signs.T).astype(np.float64) / np.sqrt(d) / align
        base, cross = qr[part, None] ** 2 + radius ** 2, 2 * qr[part, None] * radius
        slack = 1e-6 * base
        low, high = base - cross * np.minimum(inner + error, 1) - slack, base - cross * np.maximum(inner - error, -1) + slack
        own = query_ids[part, None] == ids
        high[own] = np.inf
        kth = np.partition(high, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
        possible = (low <= kth[:, None]) & ~own
        for i in range(len(kth)):
            at = np.flatnonzero(possible[i])
            # Where most rows are candidates, measuring all of them is cheaper than picking their components out.
            dist = exact(columns, q[a + i])[at] if 2 * len(at) > n else exact(columns[:, at], q[a + i])
            if len(at) > k:
                near = dist <= np.partition(dist, k - 1)[k - 1]
                at, dist = at[near], dist[near]
            order = np.lexsort((ids[at], dist))[:k]
            out.append((np.full(len(order), a + i), at[order], dist[order]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _packed(rows: DataFrame, blocks: int, key: str, columns: list[str], d: int) -> DataFrame:
    """One row per block, each column as one binary value."""
    def join(tbl: pa.Table) -> pa.Table:
        tbl = tbl.combine_chunks()
        out = [tbl.column(key)[0].as_py()]
        for c in columns:
            col = tbl.column(c).combine_chunks() if tbl.num_rows else tbl.column(c)
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            out.append(b"".join(col.to_pylist()) if pa.types.is_binary(col.type) else matrix(col, d).tobytes() if pa.types.is_list(col.type) else np.asarray(col).tobytes())
        return pa.table({key: pa.array([out[0]], pa.int64())} | {c: pa.array([v], pa.binary()) for c, v in zip(columns, out[1:])})
    rows = rows.withColumn(key, F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return rows.groupBy(key).applyInArrow(join, f"{key} long, " + ", ".join(f"{c} binary" for c in columns))


def search(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and exact distance of the k nearest found, for every row whose id fulfils ``is_query``."""
    index, centre, turn = build_index(vectors, id_column, column)
    index = stored(index)
    n, d = index.count(), len(centre)
    asked = index.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    codes = _packed(index, blocks, "block", ["id", "v", "code", "radius", "align"], d)
    # The stated query set meets every block of the index once.
    asks = _packed(asked, query_blocks, "query_block", ["id", "v"], d).select("query_block", F.col("id").alias("query_ids"), F.col("v").alias("query_vectors"))
    pairs = codes.join(asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))), "block")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["id"], np.int64), np.frombuffer(row["v"], np.float32).reshape(-1, d)
                code = np.frombuffer(row["code"], np.uint8).reshape(len(ids), -1)
                radius, align = np.frombuffer(row["radius"]), np.frombuffer(row["align"])
                query_ids, q = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["query_vectors"], np.float32).reshape(-1, d)
                qi, ci, dist = search_block(ids, x, code, radius, align, query_ids, q, centre, turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[qi]), pa.array(ids[ci]), pa.array(dist)], ["query_id", "vec_id", "score"])
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
