"""Shared helpers: tables kept in the cluster's shared folder, text buffers without Python strings, and word hashes.

Arrow hands a column of texts over as one byte buffer with offsets. Everything here works on such buffers, a slice of
whole documents of about ``SLICE_BYTES`` at a time, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only a local session without that setting gets one under /tmp."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, unless PYTHONPATH already holds it."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "tidemark").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def stored(df: DataFrame) -> DataFrame:
    """The same rows read back from Parquet in the shared folder: cuts the lineage, and survives a lost executor.

    The shuffle files behind them are given back as soon as the table is written."""
    spark = df.sparkSession
    ship(spark)
    folder, before = shared_folder(spark), spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` returned and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_in)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked(docs: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The same rows with columns besides doc_id and text renamed by their place, so that none clashes with a name used inside, and
    the (inner, outer) names in order for ``restored``."""
    names = [(c if c in ("doc_id", "text") else f"carried_{i}", c) for i, c in enumerate(docs.columns)]
    return docs.toDF(*(inner for inner, _ in names)), names


def restored(docs: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """The columns that ``masked`` renamed, in their order and by their names."""
    return docs.select(*(F.col(inner) for inner, _ in names)).toDF(*(outer for _, outer in names))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets between them. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges [first, last) of whole documents that hold about ``most`` bytes; a longer document stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: One random 64-bit number per byte value, and the base of the positional sums; both follow from the seed.
BYTE_CODE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U64))


def _table(true: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(true)] = True
    return out


#: White space between words: the ASCII space and \x09 to \x0D.
SPACE = _table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space; no run crosses a document's edge."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~blank[data]
    begin = inside[1:-1] & ~inside[:-2]
    finish = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[1:-1][edges]
    finish[edges - 1] = inside[1:-1][edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def shingle_hashes(word: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the bounds of each document's. A shorter document gives one run of all its
    words, one without words none."""
    counts = np.diff(bounds)
    n = len(word)
    full = np.zeros(max(n - k + 1, 0), U64)
    step = powers(0xD6E8FEB86659FD93, k)
    for i in range(k if len(full) else 0):
        full += word[i:i + len(full)] * step[i]
    full = mix(full)
    keep = np.ones(len(full), bool)
    drop = (bounds[1:, None] - np.arange(1, k)[None, :]) if k > 1 else np.zeros((0, 0), np.int64)
    if drop.size:
        drop = drop[(drop >= bounds[:-1, None]) & (drop < len(full))]
        keep[drop] = False
    per_doc = np.where(counts >= k, counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return full[keep], np.concatenate([[0], np.cumsum(per_doc)])
    whole = np.zeros(len(short), U64)
    for i in range(k - 1):
        there = counts[short] > i
        whole[there] += word[bounds[short[there]] + i] * step[i]
    whole = mix(whole + counts[short].astype(U64) * U64(0xA24BAED4963EE407))
    sizes = per_doc.copy()
    sizes[short] = 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], U64)
    mask = np.ones(at[-1], bool)
    mask[at[short]] = False
    out[mask] = full[keep]
    out[at[short]] = whole
    return out, at


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def for_python(docs: DataFrame) -> DataFrame:
    """The same rows, with this package sent ahead to the workers that will read them."""
    ship(docs.sparkSession)
    return docs


def unsigned_crc(column) -> F.Column:
    return F.crc32(F.coalesce(column, F.lit("")))
