"""Scoring arithmetic round a model: normalisation, softmax, marginalisation, detections.

Scores are arrays of double in the order of a label list. The model itself is pluggable: `score_with` runs any batch
function in Arrow batches, one instance a worker.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions.labels import CATEGORIES, CATEGORY_OF

# Fixed value: the threshold of detections where none is given.
DETECTION_THRESHOLD = 0.3


def standardised(features: Column, mean: list[float], std: list[float]) -> Column:
    """z-scores; a standard deviation of 0 gives 0; as many as there are means."""
    m, d = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    one = lambda v, i: F.when(F.get(d, i) == 0, F.lit(0.0)).otherwise((v.cast("double") - F.get(m, i)) / F.nullif(F.get(d, i), F.lit(0.0)))
    return F.transform(F.slice(features, 1, len(mean)), one)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax(values: Column, last: bool = True) -> Column:
    """Position (from 0) of the greatest value; of equal ones the last, or the first."""
    idx = F.transform(values, lambda v, i: F.struct(v.alias("v"), (i if last else -i).alias("i")))
    return F.abs(F.array_max(idx)["i"])


def marginalised(probs: Column, labels: list[str]) -> Column:
    """Struct (category, probability, by_category): sub-type probabilities summed by category, and the greatest; of equal ones the first category."""
    sums = [F.aggregate(F.transform(probs, lambda p, i: F.when(F.array_contains(F.array(*([F.lit(k) for k, s in enumerate(labels) if CATEGORY_OF.get(s, "prose") == c] or [F.lit(-1)])), i), p).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) for c in CATEGORIES]
    best = F.array_max(F.array(*[F.struct(s.alias("p"), F.lit(-k).alias("o"), F.lit(c).alias("c")) for k, (c, s) in enumerate(zip(CATEGORIES, sums))]))
    return F.struct(best["c"].alias("category"), best["p"].alias("probability"), F.create_map(*[x for c, s in zip(CATEGORIES, sums) for x in (F.lit(c), s)]).alias("by_category"))


def scored(values: Column, labels: list[str], threshold: float | None = None) -> Column:
    """Array of (sub_type, score), greatest score first, ties in label order; from `threshold` up, if given."""
    names = F.array(*map(F.lit, labels))
    rows = F.transform(values, lambda v, i: F.struct((-v).alias("order"), i.alias("i"), F.get(names, i).alias("sub_type"), v.alias("score")))
    rows = F.array_sort(rows if threshold is None else F.filter(rows, lambda r: r["score"] >= threshold))
    return F.transform(rows, lambda r: F.struct(r["sub_type"], r["score"]))


def by_category(rows: Column) -> Column:
    """Map of category to its (sub_type, score) entries, in their order; categories without any are left out."""
    def of(c: str) -> Column:
        own = F.array(*[F.lit(s) for s, k in CATEGORY_OF.items() if k == c])
        return F.filter(rows, lambda r: F.array_contains(own, r["sub_type"]))

    m = F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), of(c))])
    return F.map_filter(m, lambda _, v: F.size(v) > 0)


def at_least(groups: Column, threshold: float) -> Column:
    """The same map with scores under the threshold, and emptied categories, left out."""
    cut = F.transform_values(groups, lambda _, v: F.filter(v, lambda d: d["score"] >= threshold))
    return F.map_filter(cut, lambda _, v: F.size(v) > 0)


def score_with(df: DataFrame, features: Column, make: Callable[[], Callable], into: str = "logits", failures: str = "null") -> DataFrame:
    """df plus model outputs. make() is called once a worker and returns a function from a 2-d array of features to one of outputs.

    failures: "null" gives null outputs to the rows of a batch the model (or its making) fails on, so that a fallback can
    stand in; "raise" ends the job.
    """
    held: dict = {}
    if failures not in ("null", "raise"):
        raise ValueError(f"failures must be null or raise, not {failures}")

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        import numpy as np

        try:
            if "f" not in held:
                held["f"] = make()
            return pd.Series(list(np.asarray(held["f"](np.array(x.tolist(), np.float32)), float)))
        except Exception:  # noqa: BLE001 - whatever a foreign model raises
            if failures == "raise":
                raise
            return pd.Series([None] * len(x), dtype=object)

    return df.withColumn(into, run(features.cast("array<double>")))


def onnx_model(path: str, output: int = 1) -> Callable[[], Callable]:
    """A maker for score_with from an ONNX file at a path all workers have."""

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[output]

    return make
