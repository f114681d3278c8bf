"""Chains of identities, hash trees and rank statistics against plain versions."""

import random

from pyspark.sql import functions as F

from tidemark.operators import closure, ranking
from tidemark.plans import hashtree
from tidemark.sources import documents


def test_chains_are_followed_to_their_end_and_circles_refused(spark):
    links = [(i, i + 1) for i in range(37)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 201), (201, 202), (201, 203), (300, 300), (None, 5), (6, None), (5, 6)]
    df = spark.createDataFrame(links, "old_id long, new_id long")
    got = {r.id: (r.last, r.hops, r.state) for r in closure.chain_ends(df).collect()}
    assert all(got[i] == (37, 37 - i, "end") for i in range(37))
    assert {got[i] for i in (100, 101, 102, 103)} == {(None, None, "cycle")}
    assert got[200] == (201, 1, "fork") and got[201] == (201, 0, "fork") and 300 not in got
    members = {(r.id, r.other): r.hops for r in closure.chain_members(df).where("id < 50").collect()}
    assert members == {(i, j): j - i for i in range(38) for j in range(i, 38)}
    assert closure.chain_ends(df.limit(0)).count() == 0


def test_a_line_is_found_under_all_its_later_names(spark):
    obs = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("X", 4)], "security_id string, day int")
    links = spark.createDataFrame([("A", "B"), ("B", "C")], "old_id string, new_id string")
    wanted = spark.createDataFrame([("A",), ("C",), ("X",), ("Q",)], "security_id string")
    got = {(r.identity, r.day) for r in closure.follow_renamed(obs, wanted, links).collect()}
    assert got == {("A", 1), ("A", 2), ("A", 3), ("C", 3), ("X", 4)}


def digests(spark, n, partitions, altered=None):
    rows = spark.range(n, numPartitions=partitions).select(F.sha2(F.when(F.col("id") == F.lit(altered if altered is not None else -1), F.lit("other")).otherwise(F.col("id").cast("string")), 256).alias("digest"))
    return rows.unionByName(rows.where("substring(digest, 1, 1) = '0'"))


def test_one_altered_row_is_found_by_few_nodes(spark):
    depth = 3
    one = hashtree.hash_tree(digests(spark, 6000, 3), "digest", depth)
    same = hashtree.hash_tree(digests(spark, 6000, 11).repartition(5), "digest", depth)
    other = hashtree.hash_tree(digests(spark, 6000, 4, altered=1234), "digest", depth)
    root = [hashtree.tree_root(t).first().root for t in (one, same, other)]
    assert root[0] == root[1] != root[2]
    blocks, steps = hashtree.differing_blocks(one, other, depth)
    import hashlib
    want = {hashlib.sha256(x).hexdigest()[:depth] for x in (b"1234", b"other")}
    assert {r.prefix for r in blocks.collect()} == want
    looked = {r.level: r.nodes for r in steps.collect()}
    assert looked[0] == 1 and all(n <= 32 for n in looked.values()) and sum(looked.values()) <= 97
    assert hashtree.differing_blocks(one, same, depth)[0].count() == 0


def test_proofs_hold_for_rows_and_fail_for_others(spark):
    rows, depth = digests(spark, 3000, 3), 2
    tree = hashtree.hash_tree(rows, "digest", depth)
    root = hashtree.tree_root(tree).select("root").scalar()
    import hashlib
    known, foreign = (hashlib.sha256(x).hexdigest() for x in (b"77", b"nobody"))
    asked = spark.createDataFrame([(known,), (foreign,)], "digest string")
    proof = hashtree.proofs(rows, "digest", tree, asked, depth)
    assert {r.digest: r.proven for r in hashtree.proven(proof, root, depth).collect()} == {known: True, foreign: False}
    assert not hashtree.proven(proof.where(F.col("digest") == known), F.lit("0" * 64), depth).first().proven
    assert hashtree.depth_for(100) == 0 and hashtree.depth_for(129) == 1 and hashtree.depth_for(128 * 256 + 1) == 3


def test_ranks_and_curves_with_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9) if rng.random() > 0.1 else None, float(rng.randint(0, 5)), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "x int, y double, label int").repartition(7)

    def ranks(values):
        order = sorted(values)
        return [order.index(v) + 1 + (order.count(v) - 1) / 2 for v in values]
    pairs = [(x, y) for x, y, _ in rows if x is not None]
    a, b = ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    want = sum((i - ma) * (j - mb) for i, j in zip(a, b)) / (sum((i - ma) ** 2 for i in a) * sum((j - mb) ** 2 for j in b)) ** 0.5
    got = ranking.rank_correlation(df, "x", "y").first()
    assert got.n == len(pairs) and abs(got.spearman - want) < 1e-12
    assert ranking.rank_correlation(df.withColumn("c", F.lit(1)), "x", "c").first().spearman is None
    assert ranking.average_ranks(df, "x", "r").where("x IS NULL AND r IS NOT NULL").count() == 0
    area, last, found, taken, steps = 0.0, (0.0, 1.0), 0, 0, 0.0
    positives = sum(r[2] for r in rows)
    for level in sorted({r[1] for r in rows}, reverse=True):
        here = [r[2] for r in rows if r[1] == level]
        found, taken = found + sum(here), taken + len(here)
        recall, precision = found / positives, found / taken
        area, steps = area + (recall - last[0]) * (precision + last[1]) / 2, steps + (recall - last[0]) * precision
        last = recall, precision
    curve = ranking.precision_recall_area(df, "y", "label").first()
    assert abs(curve.area - area) < 1e-12 and abs(curve.average_precision - steps) < 1e-12 and (curve.n, curve.positives) == (300, positives)


def test_facts_outside_any_schema_are_kept(spark):
    docs = ['{"entity":"E","facts":{"us-gaap":{"Rev":{"label":"Revenue","units":{"USD":[{"val":1.5,"end":"2020-01-01","extra":{"deep":[7]}}],"boxes":[{"val":"many"}]}}},"own":{"Odd":{"units":{"x/y":[{"val":2}]}}}}}', "no json", '{"facts":5}', '{"entity":"F","facts":{"a":{"T":{"units":[1]}}}}', None]
    df = spark.createDataFrame([(d,) for d in docs], "json string")
    got = {(r.tag, r.unit): r for r in documents.fact_fields(documents.explode_facts_variant(df)).withColumn("deep", F.try_variant_get("fact", "$.extra.deep[0]", "int")).drop("fact").collect()}
    assert set(got) == {("us-gaap:Rev", "USD"), ("us-gaap:Rev", "boxes"), ("own:Odd", "x/y")}
    assert got["us-gaap:Rev", "USD"].val == 1.5 and got["us-gaap:Rev", "USD"].deep == 7 and str(got["us-gaap:Rev", "USD"].end) == "2020-01-01" and got["us-gaap:Rev", "boxes"].val is None
    assert "extra: OBJECT<deep: ARRAY<BIGINT>>" in documents.json_schema(df.where("json LIKE '%deep%'")).first().schema
