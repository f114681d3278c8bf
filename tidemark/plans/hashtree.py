"""A hash tree over the rows of a table: one root, proofs of single rows, and where two copies differ.

Rows are known by the SHA-256 of their content. The tree branches by the hex digits of these digests, so a row's place depends on
the row alone and the root on the set of rows alone, however they are partitioned. A leaf block holds the rows of one prefix, about ``BLOCK``
of them; equal rows are one entry with a count. A node above has up to sixteen children, so no group is ever large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import reliable_checkpoint

BLOCK = 128


def depth_for(rows: int) -> int:
    """Digits of the leaf prefixes for so many rows. Trees that are compared must have one depth."""
    depth = 0
    while BLOCK * 16 ** depth < rows:
        depth += 1
    return depth


def _sealed(entries: Column) -> Column:
    """Hash of a sorted list of entries."""
    return F.sha2(F.array_join(entries, "\n"), 256)


def _entry(digest: str, n: str) -> Column:
    return F.concat_ws(":", digest, F.col(n).cast("string"))


def hash_tree(digests: DataFrame, digest: str, depth: int) -> DataFrame:
    """(level, prefix, hash, rows) of all nodes: level 0 is the root, level ``depth`` the leaf blocks."""
    leaves = digests.groupBy(F.col(digest).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    level = leaves.groupBy(F.substring("digest", 1, depth).alias("prefix")).agg(_sealed(F.sort_array(F.collect_list(_entry("digest", "n")))).alias("hash"), F.sum("n").alias("rows"))
    level = tree = reliable_checkpoint(level.select(F.lit(depth).alias("level"), "prefix", "hash", "rows"))
    # Every level is computed from the one below it, once.
    for d in range(depth - 1, -1, -1):
        above = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(_sealed(F.sort_array(F.collect_list(_entry("prefix", "hash")))).alias("hash"), F.sum("rows").alias("rows"))
        level = reliable_checkpoint(above.select(F.lit(d).alias("level"), "prefix", "hash", "rows"))
        tree = tree.unionByName(level)
    return tree


def tree_root(tree: DataFrame) -> DataFrame:
    return tree.where("level = 0").select(F.col("hash").alias("root"), "rows")


def differing_blocks(one: DataFrame, two: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the leaf blocks in which two trees differ, and (level, nodes) compared on the way down.

    Only children of nodes that differ are looked at, so one changed row costs sixteen nodes a level."""
    both = one.select("level", "prefix", F.col("hash").alias("h1")).join(two.select("level", "prefix", F.col("hash").alias("h2")), ["level", "prefix"], "full_outer")
    changed, looked = None, []
    for d in range(depth + 1):
        nodes = both.where(F.col("level") == d)
        if changed is not None:
            nodes = nodes.join(changed.select(F.col("prefix").alias("_parent")), F.substring("prefix", 1, d - 1) == F.col("_parent"), "left_semi")
        nodes = reliable_checkpoint(nodes)
        looked.append(nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes")))
        changed = nodes.where(~F.col("h1").eqNullSafe(F.col("h2")))
    steps = looked[0]
    for more in looked[1:]:
        steps = steps.unionByName(more)
    return changed.select("prefix"), steps


def proofs(digests: DataFrame, digest: str, tree: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """(digest, level, prefix, entries) for every wanted digest: the entries of its leaf block, and of each node above it.

    Every wanted digest carries its lists, so they are short only in a tree of the depth that ``depth_for`` gives."""
    leaves = digests.groupBy(F.col(digest).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    asked = wanted.select(F.col(digest).alias("digest")).distinct()
    paths = asked.select("digest", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn("prefix", F.expr("substring(digest, 1, level)"))
    own = leaves.select(F.lit(depth).alias("level"), F.substring("digest", 1, depth).alias("prefix"), _entry("digest", "n").alias("entry"))
    inner = tree.where("level > 0").select((F.col("level") - 1).alias("level"), F.expr("substring(prefix, 1, level - 1)").alias("prefix"), _entry("prefix", "hash").alias("entry"))
    blocks = own.unionByName(inner).join(paths.select("level", "prefix").distinct(), ["level", "prefix"], "left_semi")
    lists = blocks.groupBy("level", "prefix").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return paths.join(lists, ["level", "prefix"]).select("digest", "level", "prefix", "entries")


def proven(proof: DataFrame, root: Column, depth: int) -> DataFrame:
    """(digest, proven): whether each list holds the hash of the list below it, the lowest one the digest, and the top one hashes to the root."""
    # A list is hashed and searched where it lies; only its hash and the entry on the way down go to where the levels meet.
    child = F.expr("substring(digest, 1, level + 1)")
    lowest = F.exists("entries", lambda e: F.substring_index(e, ":", 1) == F.col("digest"))
    step = F.filter("entries", lambda e: F.substring_index(e, ":", 1) == child)
    p = proof.select("digest", "level", "prefix", _sealed(F.col("entries")).alias("hash"), F.when(F.col("level") == depth, lowest).alias("lowest"), F.when(F.col("level") < depth, step).alias("step"))
    w = Window.partitionBy("digest").orderBy("level")
    below = p.withColumn("_next", F.concat_ws(":", F.lead("prefix").over(w), F.lead("hash").over(w)))
    ok = F.when(F.col("level") == depth, F.col("lowest")).otherwise(F.array_contains("step", F.col("_next"))) & ((F.col("level") > 0) | (F.col("hash") == root))
    return below.groupBy("digest").agg((F.min(ok.cast("int")) == 1).alias("whole"), F.count(F.lit(1)).alias("n")).select("digest", (F.col("whole") & (F.col("n") == depth + 1)).alias("proven"))
