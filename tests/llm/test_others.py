"""Quality, neighbours, archives and the pipeline."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.conftest import frame
from tidemark.llm import decontaminate, lines, minhash, neighbours, packing, quality, warc
from tidemark.llm.common import buffers

SF = "/root/testdata/sf0.01"


def test_quality_on_the_held_out_third(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert len(scored) == docs.count() and all(0 <= s <= 1 for s in scored.values())
    assert sum((scored[i] >= 0.5) == bool(q) for i, q in truth.items()) / len(truth) >= 0.9


def test_quality_scores_equal_plain_votes(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, n % 2) for n, (i, _) in enumerate(rows[:60])] + [(rows[61][0], None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels, keep_all=True, name="__score").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {*docs.columns, "__score"}
    model = quality.fit(docs, labels)
    data, offsets = buffers(pa.array([t or "" for _, t in rows]))
    for n, (i, t) in enumerate(rows):
        raw = data[offsets[n]:offsets[n + 1]]
        counts = quality.term_counts(raw, np.array([0, len(raw)]))
        here = {round(r["__score"], 6) for r in got if (r.doc_id, r.text) == (i, t)}
        if not counts.sum():
            assert here == {round(model.prior, 6)}
            continue
        near = (model.latent(counts) @ model.vectors.T)[0]
        top = np.argsort(-near)[:quality.VOTERS]
        w = np.maximum(near[top], 0).astype(float) ** 4
        want = (w * model.labels[top]).sum() / w.sum() if w.sum() else model.prior
        assert len(here) == 1 and abs(here.pop() - want) < 2e-3
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, nothing).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_neighbours_against_all_distances(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(600, None, 1), (601, [0.0] * 24, 1), (602, [1.0] * 23 + [None], 1), (603, [float("nan")] + [1.0] * 23, 1), (604, [float("inf")] + [1.0] * 23, 1), (605, [1.0] * 5, 1), (None, rows[0][1], 1), rows[5], rows[0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(4)
    got = {}
    for r in neighbours.search(table, lambda i: i % 10 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, vectors = np.array([r[0] for r in rows[:600]] + [5, 0]), np.concatenate([x, x[[5, 0]]]).astype(np.float64)
    assert sorted(got) == list(range(0, 600, 10))
    hits = 0
    for q, found in got.items():
        others = np.flatnonzero(ids != q)
        dist = np.zeros(len(others))
        for j in range(24):
            diff = vectors[others, j] - float(x[q, j])
            dist += diff * diff
        dist = np.sqrt(dist)
        order = np.lexsort((ids[others], dist))[:10]
        want = [(k + 1, int(ids[others][o]), float(dist[o])) for k, o in enumerate(order)]
        hits += len({v for _, v, _ in want} & {v for _, v, _ in found})
        assert [k for k, *_ in sorted(found)] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((vectors[v] - x[q]) ** 2).sum())) < 1e-9 for _, v, s in found)
    assert hits >= 0.99 * 600
    assert neighbours.search(table.limit(0), lambda i: i % 10 == 0).count() == 0
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, id int")
    assert neighbours.search(few, lambda i: i % 10 == 0).count() == 3


@pytest.fixture(scope="module")
def pages(spark):
    long, short = "é long payload " * 100, "short"
    rows = [(i, f"http://x.example/{i}", f"page {i} " * (i + 1)) for i in range(1, 30)]
    rows += [(100 + i, "http://a.example/ü", long) for i in range(5)] + [(200, None, short), (201, "u", short), (202, "u", None), (203, "u", ""), (None, "u", long), (104, "again", long), (300, "big", "z" * 300_000)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, archive int, digest string").repartition(3)


def test_archives_read_back(spark, pages):
    rows, table = pages
    last = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        last[raw] = max(last.get(raw, -1), -1 if i is None else i)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 1000 and i != last[raw]
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[raw] if again else None, None if again else raw.decode()] += 1
    got = warc.round_trip(table).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got) == want
    assert warc.round_trip(table.limit(0)).count() == 0


def test_archives_are_gzip_members_of_warc_records(spark, pages, tmp_path):
    rows, table = pages
    manifest = warc.write_archives(table, str(tmp_path / "w"), archive_bytes=50_000).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows)
    for m in manifest:
        raw = Path(m.path).read_bytes()
        assert len(raw) == m.bytes and gzip.decompress(raw).count(b"WARC/1.1\r\n") == m.records + 1
        read = list(warc.Reader(io.BytesIO(raw), chunk=7).records())
        assert len(read) == m.records + 1
        for headers, block in read:
            assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    raw = Path(manifest[0].path).read_bytes()
    with pytest.raises((ValueError, zlib.error)):
        list(warc.Reader(io.BytesIO(raw[:-9])).records())
    broken = warc.page_record(1, "u", b"some payload", None)
    text = gzip.decompress(broken)
    for bad in (text.replace(b"some", b"same"), text.replace(b"Content-Length: 9", b"Content-Length: 8", 1), b"HTTP" + text[4:]):
        if bad != text:
            with pytest.raises(ValueError):
                list(warc.Reader(io.BytesIO(gzip.compress(bad))).records())


def test_pipeline_stages(spark, docs, rows, tmp_path):
    """Each stage against its operator's brute-force rule on what the stage before kept."""
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0 if n % 9 == 0 else 1) for n, (i, _) in enumerate(rows[:70])], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    words = rows[2][1].split()
    spark.createDataFrame([(1, " ".join(words[2:20]))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now, names = spark.read.parquet(f"{sf}/documents.parquet"), [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        stage(spark, now, sf).write.parquet(f"{sf}/{name}")
        made = spark.read.parquet(f"{sf}/{name}")
        after = made.collect()
        if name != "packing":
            assert made.columns == docs.columns
        if name == "quality":
            score = {(r.doc_id, r.text): r.score for r in quality.classify(now, spark.read.parquet(f"{sf}/labels.parquet"), keep_all=True).select("doc_id", "text", "score").collect()} if "score" not in now.columns else None
            assert 0 < len(after) <= len(before) and (score is None or len(after) == sum(s >= 0.5 for s in score.values()))
        elif name == "lines":
            made_lines = {r.doc_id: r for r in lines.deduplicate(now).collect() if r.doc_id is not None}
            assert all(r.text == made_lines[r.doc_id].text for r in after if r.doc_id is not None and [b.doc_id for b in before].count(r.doc_id) == 1)
        elif name == "near_duplicates":
            assert all(r.kept for r in minhash.near_duplicates(made).collect())
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            found = {r.doc_id: r for r in minhash.near_duplicates(now).collect()}
            assert all(found[i].component_id in {r.doc_id for r in after} for i in gone)
        elif name == "decontamination":
            leaked = {r.doc_id for r in decontaminate.leaks(now, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id not in leaked)
        else:
            assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
        now = made
    empty_sf = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{empty_sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{empty_sf}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty_sf).count() == 0


def test_a_word_list_at_a_clashing_column(spark):
    """A column named like a table of the operators is carried, not read."""
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "k l m n o p q r s t")]
    got = lines.deduplicate(frame(spark, rows), carried=["hash", "n", "rank"]).collect()
    assert {(r.doc_id, r.text, r.hash, r.n, r["rank"]) for r in got} == {(1, rows[0][1], "h", 3, 5), (2, "", "h", 3, 5), (3, rows[2][1], "h", 3, 5)}
    assert packing.pieces(frame(spark, rows)).count() == 3
