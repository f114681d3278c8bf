"""Models of one fold share their rows; sums over blocks equal sums in one place."""

import datetime as dt

import numpy as np

from tidemark.operators import scores
from tidemark.plans import research


def test_models_of_a_fold_share_prepared_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(1, "train" if i < 240 else "test", dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), f"T{i % 4}", *map(float, x), int(x[0] + rng.normal() > 0)) for i, x in enumerate(rng.normal(size=(320, 2)))]
    split = spark.createDataFrame(rows, "fold int, role string, session_date date, ticker string, a double, b double, y int").coalesce(1).cache()
    prepared = []
    monkeypatch.setattr(research, "calibration_part", lambda *x, whole=research.calibration_part: prepared.append(1) or whole(*x))
    both, alone = research.average_briers(split, "y", [["a", "b"], ["b"]])
    assert len(prepared) == 1 and both < alone
    model = research.Challenger(["b"], "y").fit(split.where("role = 'train'"))
    scored = model.predict(split.where("role = 'test'"), "p").withColumnRenamed("y", "label").select("p", "label").toPandas()
    assert abs(alone - ((scored.p - scored.label) ** 2).mean()) < 1e-9


def test_sums_over_blocks_equal_sums_in_one_place(spark):
    points = spark.range(2500).selectExpr("(id % 50) / 10.0D - 2 AS x", "CAST(id % 2 AS double) AS y", "id % 7 + 1 AS n").repartition(3)
    near, free_near = scores.logistic_sums(points, 2500)
    far, free_far = scores.logistic_sums(points, 2500, small=0)
    assert np.allclose(near(0.3, 1.2), far(0.3, 1.2), rtol=1e-12) and np.allclose(near(-1.0, 0.5), far(-1.0, 0.5), rtol=1e-12)
    free_near(), free_far()
