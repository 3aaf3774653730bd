"""Training on features inside Spark, and the manifest of a run.

The trainer is the multilayer perceptron of pyspark.ml (sigmoid hidden layers, softmax output): a different model from
one with batch normalisation and several heads, but trained and applied without leaving the cluster. Class weights enter
by resampling weights of the loss only where the estimator takes them, so they are offered as a column.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.operators.metrics import class_weights, feature_moments
from prosewright.operators.sampling import train_validation
from prosewright.operators.voting import manifest_drift


def focal_loss(probability: Column, gamma: float = 2.0, weight: Column | float = 1.0) -> Column:
    """Loss of a record whose right class got `probability`: cross-entropy, less for those already sure."""
    p = F.greatest(probability, F.lit(1e-12))
    return -(weight if isinstance(weight, Column) else F.lit(weight)) * F.pow(1 - p, F.lit(gamma)) * F.log(p)


def prepared(df: DataFrame, features: list[str], label: str, id_col: str, fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, dict]:
    """(df with standardised vector `x`, index `y`, `weight` and `split`; the settings to apply it again). Moments and weights are of the training split; records without a label are left out, null features are 0."""
    d = train_validation(df.where(F.col(label).isNotNull()), label, id_col, fraction, seed)
    train = d.where("split = 'train'")
    m = {r["feature"]: (r["mean"], r["std"]) for r in feature_moments(train.fillna(0, features), features).collect()}
    w = {r[label]: r["weight"] for r in class_weights(train, label).collect()}
    classes = sorted(w)
    z = [(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - m[f][0]) / m[f][1] for f in features]
    table = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    weights = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(w[c]))])
    from pyspark.ml.functions import array_to_vector

    d = d.withColumn("x", array_to_vector(F.array(*z))).withColumn("y", F.try_element_at(table, F.col(label))).withColumn("weight", F.try_element_at(weights, F.col(label)))
    settings = {"feature_names": features, "feature_mean": [m[f][0] for f in features], "feature_std": [m[f][1] for f in features], "classes": classes}
    return d.where("y IS NOT NULL"), settings


def export_settings(settings: dict, path: str, **more) -> None:
    """The settings of `prepared` as the JSON that stands beside a model (api.ModelConfig reads it)."""
    sub_types = {c: i for i, c in enumerate(settings["classes"])}
    with open(path, "w") as f:
        json.dump({**{k: settings[k] for k in ("feature_names", "feature_mean", "feature_std")}, "sub_type_map": sub_types, **more}, f, indent=2)


def train_perceptron(d: DataFrame, n_features: int, n_classes: int, hidden: tuple[int, ...] = (64, 32), iterations: int = 100, seed: int = 42):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    est = MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], featuresCol="x", labelCol="y", predictionCol="predicted", maxIter=iterations, seed=seed)
    return est.fit(d.where("split = 'train'"))


def validation_metrics(model, d: DataFrame) -> dict:
    """Accuracy and mean focal loss on the validation split."""
    from pyspark.ml.functions import vector_to_array

    v = model.transform(d.where("split = 'validation'")).withColumn("p", F.get(vector_to_array("probability"), F.col("y").cast("int")))
    r = v.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("accuracy"), F.avg(focal_loss(F.col("p"))).alias("focal_loss")).first()
    return r.asDict()


@dataclass
class Manifest:
    """Checksums and sizes of a training run."""

    run_id: str
    dataset_sha256: str | None
    dataset_rows: int
    feature_names: list[str]
    model_sha256: str | None = None
    eval_clear_sha256: str | None = None
    eval_boundary_sha256: str | None = None
    timestamp: str | None = None

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    @classmethod
    def load(cls, path: str) -> "Manifest":
        with open(path) as f:
            return cls(**json.load(f))

    def drift(self, **current: str | None) -> list[str]:
        return manifest_drift(asdict(self), current)
