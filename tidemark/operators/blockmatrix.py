"""Products of sparse portfolio weights with a long covariance table, in blocks.

Assets are numbered and cut into blocks of ``SIDE``, portfolios into slices. A task multiplies the weights of one slice in one block of
assets with one block of covariances; the partial products of a slice and block are added afterwards. There is no matrix of all assets
anywhere, no bound on their number, and a portfolio is as large as what it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sets import global_position
from tidemark.session import reliable_checkpoint

#: Assets in a block, and portfolios in a slice.
SIDE, SLICE = 128, 256


def _column(tbl: pa.Table, name: str) -> np.ndarray:
    return tbl.column(name).to_numpy()


def _dense(tbl: pa.Table, names: list[str], value: str = "w") -> np.ndarray:
    """Rows for the named portfolios, a column per asset of the block."""
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), SIDE))
    np.add.at(out, ([at[n] for n in tbl.column("p").to_pylist()], _column(tbl, "s")), _column(tbl, value))
    return out


def _one_block(tbl: pa.Table) -> pa.Table:
    out = np.zeros((SIDE, SIDE))
    np.add.at(out, (_column(tbl, "s"), _column(tbl, "t")), _column(tbl, "v"))
    return pa.table({"b": tbl.column("b")[:1], "c": tbl.column("c")[:1], "m": pa.array([out.tobytes()], pa.binary())})


def _packed(tbl: pa.Table) -> pa.Table:
    names = sorted(set(tbl.column("p").to_pylist()))
    return pa.table({"slice": tbl.column("slice")[:1], "c": tbl.column("b")[:1], "names": pa.array([names], pa.list_(pa.string())), "w": pa.array([_dense(tbl, names).tobytes()], pa.binary())})


def _multiply(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            w, m = np.frombuffer(row["w"]).reshape(-1, SIDE), np.frombuffer(row["m"]).reshape(SIDE, SIDE)
            yield pa.RecordBatch.from_arrays([pa.array([row["slice"]]), pa.array([row["b"]]), pa.array([row["c"]]), pa.array([row["names"]], pa.list_(pa.string())), pa.array([(w @ m.T).tobytes()], pa.binary())], ["slice", "b", "c", "names", "x"])


def _add(held: pa.Table, parts: pa.Table) -> pa.Table:
    """Weight and product of every asset held, the parts added in the order of their blocks."""
    total: dict[str, np.ndarray] = {}
    for row in sorted(parts.to_pylist(), key=lambda r: r["c"]):
        for name, x in zip(row["names"], np.frombuffer(row["x"]).reshape(-1, SIDE)):
            total[name] = total[name] + x if name in total else x
    none = np.zeros(SIDE)
    product = [float(total.get(p, none)[s]) for p, s in zip(held.column("p").to_pylist(), held.column("s").to_pylist())]
    return pa.table({"p": held.column("p"), "i": held.column("i"), "w": held.column("w"), "cw": pa.array(product, pa.float64())})


def held_products(weights: DataFrame, cov: DataFrame, portfolio="portfolio", key="symbol", value="weight") -> DataFrame:
    """(portfolio, asset, w, cw): for each asset held its weight as a fraction and the sum of covariance times weight over all held ones.
    Pairs without a covariance, and assets without any, add nothing. Entries of one asset are added."""
    table = cov.where(F.col("cov").isNotNull()).select(F.col("left").cast("string").alias("left"), F.col("right").cast("string").alias("right"), F.col("cov").alias("v"))
    own = weights.where(F.col(value) != 0).groupBy(F.col(portfolio).cast("string").alias("p"), F.col(key).cast("string").alias("k")).agg((F.sum(value) / 100).alias("w"))
    names = table.select(F.explode(F.array("left", "right")).alias("k")).unionByName(own.select("k")).distinct()
    at = reliable_checkpoint(global_position(names, ["k"], "i").select("k", F.col("i").cast("long").alias("i")))
    place = lambda side, b, s: at.select(F.col("k").alias(side), F.floor(F.col("i") / SIDE).cast("long").alias(b), (F.col("i") % SIDE).cast("long").alias(s))
    blocks = table.join(place("left", "b", "s"), "left").join(place("right", "c", "t"), "right").select("b", "c", "s", "t", "v").groupBy("b", "c").applyInArrow(_one_block, "b long, c long, m binary")
    slices = F.lit(max(1, -(-own.select("p").distinct().count() // SLICE)))
    held = reliable_checkpoint(own.join(at, "k").select("p", "i", F.floor(F.col("i") / SIDE).cast("long").alias("b"), (F.col("i") % SIDE).cast("long").alias("s"), "w", F.pmod(F.xxhash64("p"), slices).alias("slice")))
    packed = held.groupBy("slice", "b").applyInArrow(_packed, "slice long, c long, names array<string>, w binary")
    parts = packed.join(blocks, "c").mapInArrow(_multiply, "slice long, b long, c long, names array<string>, x binary")
    out = held.groupBy("slice", "b").cogroup(parts.groupBy("slice", "b")).applyInArrow(_add, "p string, i long, w double, cw double")
    return out.join(at, "i").select(F.col("p").alias(portfolio), F.col("k").alias(key), "w", "cw")


def variances(products: DataFrame, portfolio="portfolio") -> DataFrame:
    return products.groupBy(portfolio).agg(F.sum(F.col("w") * F.col("cw")).alias("variance"))


def contributions(products: DataFrame, portfolio="portfolio") -> DataFrame:
    """Share of the portfolio variance each held asset carries, in percent; portfolios without a positive variance have none."""
    j = products.where("w > 0").join(variances(products, portfolio).where("variance > 0"), portfolio)
    return j.withColumn("risk_contribution", F.col("w") * F.col("cw") / F.col("variance") * 100).drop("cw")
