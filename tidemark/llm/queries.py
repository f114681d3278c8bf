"""Registered queries of the training-text operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, collocations, decontaminate, lines, minhash, negatives, neighbours, packing, quality, slots, substrings, warc, wordpieces
from tidemark.llm.common import table


def op1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated content-defined chunks removed from all documents."""
    out = chunks.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_chunks", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document by votes of its nearest labelled vectors."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, 10)


def op5_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    out = slots.shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on shingles of four words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("text_crc32")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that equal or resemble an earlier one removed from all documents."""
    out = lines.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token pieces in sequences of 2048."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat 50 bytes of a document before."""
    out = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by their score."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and its five positives."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, label)


def op13_wordpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, and the texts they decode to, as digests."""
    out = wordpieces.decode(wordpieces.encode(table(spark, sf_dir, "documents")))
    joined = F.array_join("ids", ",").cast("binary")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


JOBS = {f.__name__: f for f in (op1_chunks, op2_decontaminate, op3_quality, op4_neighbours, op5_slots, op6_warc, op7_minhash, op8_lines, op9_packing, op10_suffixes, op11_collocations, op12_negatives, op13_wordpieces)}

ORACLES = {
    "op2_decontaminate": r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL SELECT 1, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') FROM benchmark WHERE item_id IS NOT NULL),
runs AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT id AS item_id, count(*) AS n FROM runs WHERE kind = 1 GROUP BY 1),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM runs d JOIN runs i ON d.kind = 0 AND i.kind = 1 AND d.s = i.s GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(n_shared AS BIGINT) AS n_shared, n_shared / n AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared * 100 >= n * 80""",
    "op8_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, pos, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM l),
s AS (SELECT w, len(w) AS n, min((doc_id, pos)) AS head, row_number() OVER () AS id FROM t WHERE len(w) > 0 GROUP BY w),
e AS (SELECT id, n, unnest(w) AS g FROM s),
f AS (SELECT g, count(*) AS c FROM e GROUP BY g),
r AS (SELECT id, n, g, row_number() OVER (PARTITION BY id ORDER BY c, g) AS k FROM e JOIN f USING (g)),
p AS (SELECT id, n, g FROM r WHERE k <= n - CAST(ceil(80 * n / 100) AS BIGINT) + 1),
q AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id AND 80 * b.n <= 100 * a.n AND 80 * a.n <= 100 * b.n),
m AS (SELECT x FROM q JOIN s a ON a.id = x JOIN s b ON b.id = y WHERE a.head > b.head AND 100 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
k AS (SELECT t.doc_id, t.pos, t.line, s.id IS NOT NULL AND (s.head <> (t.doc_id, t.pos) OR s.id IN (SELECT x FROM m)) AS gone FROM t LEFT JOIN s ON s.w = t.w AND len(t.w) > 0)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id""",
    "op10_suffixes": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, x, n, unnest(range(n)) AS i FROM h),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN i + 50 <= n THEN hash(substr(x, 2 * i + 1, 100)) END AS s FROM b),
f AS (SELECT doc_id, i, byte, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS starts FROM w),
c AS (SELECT doc_id, i, byte, max(starts::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
r AS (SELECT doc_id, CAST(sum(gone::INT) AS BIGINT) AS n_removed, CAST(sum(opens::INT) AS BIGINT) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN r USING (doc_id)""",
    "op4_neighbours": """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
asked AS (SELECT vec_id AS query_id, v AS q FROM usable WHERE vec_id % 100 = 0),
ranked AS (
  SELECT query_id, vec_id, sqrt(list_reduce(list_transform(list_zip(q, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM asked JOIN usable ON vec_id <> query_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM ranked)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 10""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*) AS a FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 100),
covered AS (SELECT lang, p[1:k - 1] AS p, a FROM f WHERE k > 2 UNION SELECT lang, p[2:k] AS p, a FROM f WHERE k > 2),
cand AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = f.lang AND c.p = f.p AND c.a = f.a)),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
scored AS (
  SELECT cuts.lang, cuts.p, cuts.a, c, x.a AS l, y.a AS r, n, (1000 * cuts.a::HUGEINT * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN totals USING (lang) JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:c] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[c + 1:cuts.k]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
placed AS (SELECT *, array_to_string(p, ' ') AS phrase FROM lowest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM placed)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
    "op12_negatives": """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
met AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 3""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM l""",
    "op7_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM c WHERE 100 * common >= 80 * (na + nb - common)),
edges AS (SELECT x, y FROM k UNION SELECT y, x FROM k),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m USING (doc_id)""",
}
