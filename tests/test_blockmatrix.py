"""Portfolio variances over thousands of assets against a plain sum."""

import random

from tidemark.operators import blockmatrix


def test_five_thousand_assets_need_no_matrix(spark, monkeypatch):
    monkeypatch.setattr(blockmatrix, "SLICE", 4)
    rng, n = random.Random(8), 5000
    cov = {(i, j): rng.uniform(0.5, 2) if i == j else 0.1 * ((i * 7 + j * 7) % 5 - 2) for i in range(n) for j in (i - 1, i, i + 1, (i + 2500) % n) if 0 <= j < n}
    cov |= {(j, i): v for (i, j), v in cov.items()}
    held = {f"P{p}": {rng.randrange(n): rng.uniform(-5, 40) for _ in range(rng.choice([1, 30, 900]))} for p in range(11)}
    held["P0"] |= {17: 3.0, 18: 4.0, 2517: 5.0}
    weights = spark.createDataFrame([(p, f"A{i}", w) for p, own in held.items() for i, w in own.items()] + [("P0", "A17", 2.0), ("P1", "unknown", 9.0), ("P2", "A1", 0.0)], "portfolio string, symbol string, weight double")
    held["P0"][17] += 2.0
    table = spark.createDataFrame([(f"A{i}", f"A{j}", v) for (i, j), v in cov.items()] + [("A1", "A4", None)], "left string, right string, cov double")
    products = blockmatrix.held_products(weights, table).cache()
    want = {p: sum(w * own.get(j, 0.0) * cov[i, j] / 1e4 for i, w in own.items() for j in {i - 1, i, i + 1, (i + 2500) % n, (i - 2500) % n} if (i, j) in cov) for p, own in held.items()}
    got = {r.portfolio: r.variance for r in blockmatrix.variances(products).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    shares = blockmatrix.contributions(products).groupBy("portfolio").sum("risk_contribution").collect()
    assert len(shares) >= 1 and products.where("symbol = 'unknown'").first().cw == 0.0
    assert blockmatrix.held_products(weights.limit(0), table).count() == 0
