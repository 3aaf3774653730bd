"""A classifier object for single texts, lists and DataFrames: the same rules and scoring behind one face."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.functions.features import FEATURES, with_features
from prosewright.operators import rules, scoring
from prosewright.sources.documents import inline


@dataclass
class ModelConfig:
    """What a model file needs beside it: feature names, moments, label maps, detection labels and threshold."""

    feature_names: list[str]
    feature_mean: list[float]
    feature_std: list[float]
    sub_types: list[str]
    detections: list[str]
    detection_threshold: float = scoring.DETECTION_THRESHOLD

    @classmethod
    def load(cls, path: str) -> "ModelConfig":
        """From JSON with feature_names, feature_mean, feature_std, sub_type_map and, if there are any, detection_map and detection_threshold."""
        with open(path) as f:
            d = json.load(f)
        order = lambda m: [k for k, _ in sorted((m or {}).items(), key=lambda x: x[1])]
        return cls(d["feature_names"], d["feature_mean"], d["feature_std"], order(d["sub_type_map"]), order(d.get("detection_map")), d.get("detection_threshold") or scoring.DETECTION_THRESHOLD)


class Classifier:
    """Rules, or rules with a model for what they defer.

    model: a maker of a batch function from feature rows to sub-type logits followed by detection logits (scoring.score_with);
    min_score: scores and detections below are left out of the result. Without a model every answer is the rules'; where
    the model fails on a batch, the fallback's, unless failures is "raise". sample_bytes: how much of a text is looked at,
    None for all of it.
    """

    def __init__(self, spark: SparkSession | None = None, config: ModelConfig | None = None, model: Callable[[], Callable] | None = None, min_score: float | None = None, wordlist: list[str] | None = None, sample_bytes: int | None = 10_000, failures: str = "null"):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.config, self.model, self.min_score, self.wordlist = config, model, min_score, wordlist
        self.sample_bytes, self.failures = sample_bytes, failures

    def with_min_score(self, threshold: float) -> "Classifier":
        return Classifier(self.spark, self.config, self.model, threshold, self.wordlist, self.sample_bytes, self.failures)

    def transform(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """df plus `classification`, and with a model also `detections` and `sub_type_scores` (maps of category to scored sub-types)."""
        if self.model is None or self.config is None:
            return rules.classify(df, text_col, sample_bytes=self.sample_bytes)
        c = self.config
        d = with_features(df, text_col, sample_bytes=self.sample_bytes, wordlist=self.wordlist)
        x = scoring.standardised(F.array(*[F.col(f).cast("double") for f in c.feature_names]), c.feature_mean, c.feature_std)
        d = scoring.score_with(d, x, self.model, "_logits", self.failures)
        probs = scoring.softmax(F.slice("_logits", 1, len(c.sub_types)))
        m = scoring.marginalised(probs, c.sub_types)
        scores = scoring.by_category(scoring.scored(probs, c.sub_types))
        found = F.transform(F.slice("_logits", len(c.sub_types) + 1, max(1, len(c.detections))), scoring.sigmoid)
        det = scoring.by_category(scoring.scored(found, c.detections or ["plain"], c.detection_threshold if c.detections else 2.0))
        if self.min_score is not None:
            scores, det = scoring.at_least(scores, self.min_score), scoring.at_least(det, self.min_score)
        names = F.array(*map(F.lit, c.sub_types))
        answer = F.struct(m["category"].alias("category"), F.get(names, scoring.argmax(probs).cast("int")).alias("sub_type"), m["probability"].cast("float").alias("confidence"), F.lit("model").alias("reason"), F.lit("model").alias("tier"))
        guard = rules.is_empty(F.col(text_col)) | rules.is_too_short(F.col(text_col))
        short = rules._answer("prose", 0.5, "too short to classify")
        empty = rules._answer("prose", 0.0, "empty or no content")
        d = d.withColumn("classification", F.when(rules.is_empty(F.col(text_col)), empty).when(guard, short).when(F.col("_logits").isNull(), rules.fallback()).otherwise(answer))
        return d.withColumn("detections", F.when(~guard, det)).withColumn("sub_type_scores", F.when(~guard, scores)).drop("_logits", *FEATURES, "line_count")

    def classify(self, text: str) -> dict:
        return self.classify_batch([text])[0]

    def classify_batch(self, texts: list[str]) -> list[dict]:
        """In the order of the texts."""
        d = self.spark.createDataFrame(list(enumerate(texts)), "i long, text string")
        return [r["classification"].asDict() for r in self.transform(d).orderBy("i").collect()]

    def extract_features(self, text: str) -> dict[str, float]:
        r = with_features(inline(self.spark, text), sample_bytes=self.sample_bytes, wordlist=self.wordlist).first().asDict()
        r.pop("text")
        return r


def classify(text: str, **settings) -> dict:
    """One text's classification, by the session there is or a new one."""
    return Classifier(**settings).classify(text)


def classify_batch(texts: list[str], **settings) -> list[dict]:
    return Classifier(**settings).classify_batch(texts)


def human_with_detections(classification: Column, detections: Column, above: float = 0.5) -> Column:
    """The one-line form with detections above a threshold, greatest first."""
    flat = F.flatten(F.transform(F.map_entries(detections), lambda e: F.transform(F.filter(e["value"], lambda d: d["score"] > above), lambda d: F.struct((-d["score"]).alias("o"), F.concat_ws("/", e["key"], d["sub_type"]).alias("n"), d["score"].alias("s")))))
    parts = F.transform(F.array_sort(flat), lambda x: F.format_string("%s(%.2f)", x["n"], x["s"].cast("double")))
    base = rules.human(classification)
    return F.when(F.size(parts) > 0, F.concat(base, F.lit(" [detections: "), F.array_join(parts, ", "), F.lit("]"))).otherwise(base)
