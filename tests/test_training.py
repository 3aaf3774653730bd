import random

import pytest
from pyspark.sql import functions as F

from prosewright.operators import training


def test_perceptron_learns(spark):
    r = random.Random(1)
    rows = [(i, "a" if i % 2 else "b", r.gauss(2 if i % 2 else -2, 1), 1.0, None) for i in range(200)] + [(999, None, 0.0, 1.0, None)]
    d = spark.createDataFrame(rows, "id long, label string, f double, constant double, nothing double")
    x, settings = training.prepared(d, ["f", "constant", "nothing"], "label", "id")
    assert settings["classes"] == ["a", "b"] and settings["feature_std"][1] == 1.0 and x.count() == 200
    m = training.train_perceptron(x.persist(), 3, 2, (4,), 30)
    v = training.validation_metrics(m, x)
    assert v["n"] == 40 and v["accuracy"] > 0.9 and v["focal_loss"] < 0.3


def test_focal_loss(spark):
    d = spark.createDataFrame([(0.5,), (1.0,)], "p double")
    a, b = [r[0] for r in d.select(training.focal_loss(F.col("p"))).collect()]
    assert a == pytest.approx(0.25 * 0.6931472, rel=1e-5) and b == pytest.approx(0, abs=1e-9)


def test_manifest(tmp_path):
    m = training.Manifest("r", "aa", 3, ["f"], model_sha256="bb")
    m.save(tmp_path / "m.json")
    n = training.Manifest.load(tmp_path / "m.json")
    assert n == m and n.drift(dataset_sha256="aa", model_sha256="cc", eval_clear_sha256="x") == ["model_sha256"]
