"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed byte trigrams and a mark for every word that repeats the one before it. Weights (inverse document
frequency) and the latent space (a truncated singular value decomposition) are fitted on a bounded sample of labelled
rows, at most ``PER_LABEL`` of each label, taken by a hash of their id. That many labelled vectors are broadcast; every
document is compared with all of them by blocked matrix products, and its nearest ones vote with their similarity.

Only the text enters a score. Defined cases: a null text is an empty one; a text without terms, or like no
labelled one, gets the share of label 1 in the sample; rows with a null label teach nothing; a document labelled twice counts with its larger label; without any
labelled row every score is 0.5; repeated rows are scored each; a very long text is counted
whole, in a slice of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, buffers, for_python, slices, span_hashes, words

#: Labelled rows used of each label, hashed terms, latent dimensions and voters: the documented bounds of the fit.
PER_LABEL, TERMS, LATENT, VOTERS, REPEATED = 2000, 4096, 64, 25, 2.0


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed terms, one row per document; the first term counts words that repeat the one before."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    code = data.astype(np.uint32)
    if len(data) >= 3:
        gram = (code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA77) ^ code[2:] * np.uint32(0xC2B2AE3D))
        gram = (gram * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 12)
        same = doc[:-2] == doc[2:]
        cell = (doc[:-2] * TERMS + 1 + gram % (TERMS - 1))[same]
    else:
        cell = np.zeros(0, np.int64)
    starts, ends = words(data, offsets, SPACE)
    h = span_hashes(data, starts, ends)
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[starts[1:]] == doc[starts[:-1]])) + 1 if len(h) > 1 else np.zeros(0, np.int64)
    cell = np.concatenate([cell, doc[starts[again]] * TERMS if len(again) else np.zeros(0, np.int64)])
    return np.bincount(cell, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf, at unit length. Repetition is damped less: a trigram's tenth occurrence says little more
    than its first, a tenth repeated word does."""
    out = np.log1p(counts)
    out[:, 0] = REPEATED * np.sqrt(counts[:, 0])
    out *= idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _sparse_terms(batches):
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        rows = []
        for a, z in slices(offsets):
            for row in term_counts(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]):
                at = np.flatnonzero(row)
                rows.append((at.astype("<u2").tobytes(), row[at].astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["quality", "at", "n"])


class Model:
    """Weights, latent axes, and the labelled vectors with their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, latent: int = LATENT, seed: int = 7):
        df = (counts > 0).sum(axis=0)
        self.idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
        x = weighted(counts, self.idf)
        k = min(latent, *x.shape)
        basis = np.random.default_rng(seed).standard_normal((x.shape[1], k + 16)).astype(np.float32)
        for _ in range(3):
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = np.ascontiguousarray((basis @ vt.T)[:, :k]).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.vectors = self.latent(counts)
        self.prior = float(self.labels.mean())

    def latent(self, counts: np.ndarray) -> np.ndarray:
        out = weighted(counts, self.idf) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, voters: int = VOTERS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        out = np.full(len(counts), self.prior)
        near = self.latent(counts) @ self.vectors.T
        k = min(voters, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        some = (counts.sum(axis=1) > 0) & (total > 0)
        out[some] = (weight * self.labels[top]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id) -> F.Column:
    """True for the third of ids that teach nothing: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model from at most ``per_label`` rows of each label outside the held-out third."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    sample = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        sample = part if sample is None else sample.unionByName(part)
    ids = [(r.doc_id, r.quality) for r in sample.collect()]
    if not ids:
        return None
    sample = docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality")
    # A repeated doc_id would let one row teach more than once; the bound below keeps the sample bounded all the same.
    rows = for_python(texts).mapInArrow(_sparse_terms, "quality int, at binary, n binary").orderBy("at", "n", "quality").limit(2 * per_label).collect()
    if not rows:
        return None
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<f4")
    return Model(counts, np.array([r["quality"] for r in rows]))


def _scorer(shared, names: list[str], score_name: str):
    def score(batches):
        model = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out = np.empty(batch.num_rows)
            for a, z in slices(offsets):
                for lo in range(a, z, 256):  # many short documents would make a wide block of counts
                    hi = min(z, lo + 256)
                    counts = term_counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    out[lo:hi] = 0.5 if model is None else model.score(counts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(out)], names + [score_name])
    return score


def classify(docs: DataFrame, labels: DataFrame, keep_all: bool = False, name: str = "score") -> DataFrame:
    """doc_id (or all columns if ``keep_all``) and the score of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    source = docs if keep_all else docs.select("doc_id", "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    scored = for_python(source).mapInArrow(_scorer(model, source.columns, name), f"{schema}, `{name}` double")
    return scored if keep_all else scored.drop("text")
