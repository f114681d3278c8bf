"""Queries over chains of identities, hash trees, rank statistics and documents of open schema."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import view
from tidemark.functions import content_address
from tidemark.operators import closure, ranking
from tidemark.plans import hashtree
from tidemark.sources import documents as doc

# --- chains ----------------------------------------------------------------------------------------------------------

@view("renames", """
SELECT p_partkey AS old_id, CASE WHEN p_partkey % 8 = 7 AND p_partkey // 8 % 10 = 3 THEN p_partkey - 6 ELSE p_partkey + 1 END AS new_id FROM part WHERE p_partkey % 8 <> 0
UNION ALL SELECT p_partkey, p_partkey + 1000000 FROM part WHERE p_partkey % 8 = 4 AND p_partkey // 8 % 10 = 5 UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 8 = 0""")
def _renames(v):
    """Chains of eight; some end in a circle, some fork in their middle; a link to oneself says nothing."""
    k = F.col("p_partkey")
    p = v.table("part").select(k)
    circle = (k % 8 == 7) & (F.floor(k / 8) % 10 == 3)
    return (p.where(k % 8 != 0).select(k.alias("old_id"), F.when(circle, k - 6).otherwise(k + 1).alias("new_id"))
            .unionByName(p.where((k % 8 == 4) & (F.floor(k / 8) % 10 == 5)).select(k.alias("old_id"), (k + 1000000).alias("new_id")))
            .unionByName(p.where(k % 8 == 0).select(k.alias("old_id"), k.alias("new_id"))))


_WALK = """WITH RECURSIVE one AS (SELECT old_id, min(new_id) AS lo, max(new_id) AS hi FROM renames WHERE old_id <> new_id GROUP BY 1),
walk AS (SELECT old_id AS id, old_id AS place, 0 AS hops FROM one UNION ALL SELECT w.id, o.lo, w.hops + 1 FROM walk w JOIN one o ON o.old_id = w.place AND o.lo = o.hi WHERE w.hops < 20),
ends AS (SELECT id, arg_max(place, hops) AS last, max(hops) AS hops FROM walk GROUP BY 1)
"""


@query("identity_closure", "id:l last:l hops:l state:s", _WALK + """
SELECT id, CASE WHEN e.hops < 20 THEN last END AS last, CASE WHEN e.hops < 20 THEN e.hops END AS hops, CASE WHEN e.hops >= 20 THEN 'cycle' WHEN o.lo <> o.hi THEN 'fork' ELSE 'end' END AS state FROM ends e LEFT JOIN one o ON o.old_id = e.last""")
def _(v):
    return closure.chain_ends(v.renames)


@query("identity_chain", "id:l other:l hops:l", _WALK + """
SELECT w.id, w.place AS other, w.hops FROM walk w JOIN ends e ON e.id = w.id AND e.hops < 20""")
def _(v):
    sources = v.renames.where("old_id <> new_id").select(F.col("old_id").alias("id")).distinct()
    steady = closure.chain_ends(v.renames).where("state <> 'cycle'").select("id")
    return closure.chain_members(v.renames).join(sources, "id", "left_semi").join(steady, "id", "left_semi")


@query("follow_renamed", "ticker:s identity:s n:l first:d", """
SELECT o.ticker, w.identity, count(*) AS n, min(o.session_date) AS first FROM (SELECT CAST(k AS VARCHAR) AS identity, CAST(j AS VARCHAR) AS ticker FROM (SELECT s_suppkey AS k, unnest(range(s_suppkey, (s_suppkey // 4 + 1) * 4)) AS j FROM supplier WHERE s_suppkey % 2 = 0)) w JOIN bars o ON o.ticker = w.ticker GROUP BY 1, 2""")
def _(v):
    """Bars of every second security under its own name and the names it took later."""
    s = F.col("s_suppkey")
    links = v.table("supplier").where(s % 4 != 3).select(s.cast("string").alias("old_id"), (s + 1).cast("string").alias("new_id"))
    wanted = v.table("supplier").where(s % 2 == 0).select(s.cast("string").alias("ticker"))
    return closure.follow_renamed(v.bars, wanted, links, ident="ticker").groupBy("ticker", "identity").agg(F.count(F.lit(1)).alias("n"), F.min("session_date").alias("first"))


# --- hash trees ------------------------------------------------------------------------------------------------------

DEPTH = 2
_ROW = "sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus))"


@view("order_hashes", f"SELECT o_orderkey, {_ROW} AS digest FROM orders UNION ALL SELECT o_orderkey, {_ROW} FROM orders WHERE o_orderkey % 9 = 0")
def _order_hashes(v):
    """A ninth of the rows stands there twice."""
    o = v.table("orders").select("o_orderkey", content_address("o_orderkey", "o_custkey", "o_orderstatus").alias("digest"))
    return o.unionByName(o.where("o_orderkey % 9 = 0"))


_TREE = f"""leaf AS (SELECT digest, count(*) AS n FROM order_hashes GROUP BY 1),
t2 AS (SELECT substr(digest, 1, {DEPTH}) AS prefix, sha256(string_agg(digest || ':' || n, chr(10) ORDER BY digest || ':' || n)) AS hash, sum(n) AS rows FROM leaf GROUP BY 1),
t1 AS (SELECT substr(prefix, 1, 1) AS prefix, sha256(string_agg(prefix || ':' || hash, chr(10) ORDER BY prefix)) AS hash, sum(rows) AS rows FROM t2 GROUP BY 1),
t0 AS (SELECT '' AS prefix, sha256(string_agg(prefix || ':' || hash, chr(10) ORDER BY prefix)) AS hash, sum(rows) AS rows FROM t1)"""


@query("hash_tree", "level:l prefix:s hash:s rows:l", f"WITH {_TREE} SELECT 2 AS level, * FROM t2 UNION ALL SELECT 1, * FROM t1 UNION ALL SELECT 0, * FROM t0")
def _(v):
    return hashtree.hash_tree(v.order_hashes, "digest", DEPTH)


@query("audit_difference", "prefix:s", f"""
SELECT DISTINCT prefix FROM (SELECT substr(digest, 1, {DEPTH}) AS prefix FROM order_hashes WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT substr(sha256('altered'), 1, {DEPTH}))""")
def _(v):
    """Blocks in which a copy differs that has one altered row."""
    top = v.table("orders").agg(F.max("o_orderkey")).scalar()
    copy = v.order_hashes.withColumn("digest", F.when(F.col("o_orderkey") == top, F.sha2(F.lit("altered"), 256)).otherwise(F.col("digest"))).dropDuplicates(["o_orderkey", "digest"])
    copy = copy.unionByName(copy.where("o_orderkey % 9 = 0 AND digest <> sha2('altered', 256)"))
    one, two = (hashtree.hash_tree(rows, "digest", DEPTH) for rows in (v.order_hashes.where(F.col("o_orderkey") != top).unionByName(v.order_hashes.where(F.col("o_orderkey") == top).limit(1)), copy))
    return hashtree.differing_blocks(one, two, DEPTH)[0]


@query("audit_proofs", "digest:s proven:b", "SELECT DISTINCT digest, true AS proven FROM order_hashes WHERE o_orderkey % 100 = 0")
def _(v):
    depth = hashtree.depth_for(v.order_hashes.count())
    tree = hashtree.hash_tree(v.order_hashes, "digest", depth)
    root = hashtree.tree_root(tree).select("root").scalar()
    return hashtree.proven(hashtree.proofs(v.order_hashes, "digest", tree, v.order_hashes.where("o_orderkey % 100 = 0"), depth), root, depth)


# --- ranks -----------------------------------------------------------------------------------------------------------

_AVERAGE = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"


@query("rank_correlation", "n:l spearman:f", f"""
SELECT count(*) AS n, corr(a, b) AS spearman FROM (SELECT {_AVERAGE.format(c='l_quantity')} AS a, {_AVERAGE.format(c='l_extendedprice')} AS b FROM lineitem)""")
def _(v):
    return ranking.rank_correlation(v.table("lineitem"), "l_quantity", "l_extendedprice")


@query("average_ranks", "l_quantity:f2 rank:f2 n:l", f"SELECT l_quantity, r AS rank, count(*) AS n FROM (SELECT l_quantity, {_AVERAGE.format(c='l_quantity')} AS r FROM lineitem) GROUP BY 1, 2")
def _(v):
    return ranking.average_ranks(v.table("lineitem").select("l_quantity"), "l_quantity", "rank").groupBy("l_quantity", "rank").agg(F.count(F.lit(1)).alias("n"))


_CURVE = """SELECT p, sum(n) OVER w AS taken, sum(hits) OVER w AS found, sum(hits) OVER () AS total FROM (SELECT p, count(*) AS n, sum(label) AS hits FROM preds GROUP BY 1) WINDOW w AS (ORDER BY p DESC)"""


@query("precision_recall", "p:f2 taken:l found:l precision:f recall:f", f"SELECT p, taken, found, found / taken AS precision, found / total AS recall FROM ({_CURVE})")
def _(v):
    return ranking.precision_recall(v.preds, "p", "label")


@query("precision_recall_area", "area:f average_precision:f n:l positives:l", f"""
SELECT sum((recall - r0) * (precision + p0) / 2) AS area, sum((recall - r0) * precision) AS average_precision, max(taken) AS n, max(found) AS positives FROM (
SELECT *, lag(recall, 1, 0e0) OVER (ORDER BY p DESC) AS r0, lag(precision, 1, 1e0) OVER (ORDER BY p DESC) AS p0 FROM (SELECT *, found / taken AS precision, found / total AS recall FROM ({_CURVE})))""")
def _(v):
    return ranking.precision_recall_area(v.preds, "p", "label")


@query("precision_at", "session_date:d precision_1:f precision_3:f precision_5:f precision_10:f", """
SELECT session_date, avg(label) FILTER (WHERE r <= 1) AS precision_1, avg(label) FILTER (WHERE r <= 3) AS precision_3, avg(label) FILTER (WHERE r <= 5) AS precision_5, avg(label) FILTER (WHERE r <= 10) AS precision_10 FROM (
SELECT CAST(l_shipdate AS DATE) AS session_date, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_discount DESC, l_orderkey*10+l_linenumber) AS r
 FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1)) GROUP BY 1""")
def _(v):
    rows = v.table("lineitem").select(F.to_date("l_shipdate").alias("session_date"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    once = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return ranking.precision_at(rows.join(once, ["l_orderkey", "l_linenumber"]), ["session_date"], "score", "label", "tie")


# --- documents of open schema ----------------------------------------------------------------------------------------

@view("fact_docs", "SELECT 1 AS unused")
def _fact_docs(v):
    """A document per order; every taxonomy, tag and unit name is its own, and facts carry fields that no schema lists."""
    k = F.col("o_orderkey").cast("string")
    fact = F.concat(F.lit('{"end":"2020-03-31","val":'), F.when(F.col("o_orderkey") % 5 == 0, F.lit('"n/a"')).otherwise(F.floor("o_totalprice").cast("string")), F.lit(',"form":"10-Q","accn":"a'), k, F.lit('","frame":{"q":'), (F.col("o_orderkey") % 4).cast("string"), F.lit("}}"))
    tags = F.concat(F.lit('{"Tag'), (F.col("o_orderkey") % 50).cast("string"), F.lit('":{"label":"L'), k, F.lit('","units":{"USD":['), fact, F.lit(","), fact, F.lit('],"unit'), (F.col("o_orderkey") % 7).cast("string"), F.lit('":['), fact, F.lit("]}}}"))
    body = F.concat(F.lit('{"entity":"E'), k, F.lit('","facts":{"us-gaap":'), tags, F.lit(',"own'), (F.col("o_orderkey") % 3).cast("string"), F.lit('":'), tags, F.lit("}}"))
    return v.table("orders").select(F.when(F.col("o_orderkey") % 11 == 0, F.substring(body, 1, 40)).otherwise(body).alias("json"))


@query("explode_facts_variant", "entity:s tag:s label:s unit:s n:l val:f2 quarter:l", """
SELECT 'E' || o_orderkey AS entity, t || ':Tag' || o_orderkey % 50 AS tag, 'L' || o_orderkey AS label, u AS unit, CASE u WHEN 'USD' THEN 2 ELSE 1 END AS n, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice) END AS val, o_orderkey % 4 AS quarter
FROM (SELECT *, unnest(['us-gaap', 'own' || o_orderkey % 3]) AS t FROM orders WHERE o_orderkey % 11 <> 0), LATERAL (SELECT unnest(['USD', 'unit' || o_orderkey % 7]) AS u)""")
def _(v):
    f = doc.fact_fields(doc.explode_facts_variant(v.fact_docs)).withColumn("q", F.try_variant_get("fact", "$.frame.q", "int"))
    return f.groupBy("entity", "tag", "label", "unit").agg(F.count(F.lit(1)).alias("n"), F.max("val").alias("val"), F.max("q").alias("quarter"))
