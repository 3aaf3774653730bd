"""The command-line verbs: python -m prosewright VERB INPUT -o OUTPUT [options]."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.api import Classifier, ModelConfig, human_with_detections
from prosewright.functions.features import FEATURES, with_features
from prosewright.operators import metrics, scoring
from prosewright.operators.filters import label_column
from prosewright.operators.routing import FIELDS, LEAST_CONFIDENCE, field_categories, route
from prosewright.operators.rules import human
from prosewright.session import clean_up
from prosewright.sources import documents as docs


def classify_file(spark: SparkSession, source: str, target: str, field: str = "text", classifier: Classifier | None = None) -> None:
    """JSON Lines with _classification added, and with a model _detections; documents without the field pass through."""
    d = docs.read_json_lines(spark, source).withColumn("text", docs.json_text(F.col("doc"), field))
    d = (classifier or Classifier(spark)).transform(d)
    line = docs.with_field(F.col("doc"), F.col("line"), "_classification", F.col("classification"))
    if "detections" in d.columns:
        line = F.when(F.coalesce(F.size("detections"), F.lit(0)) > 0, docs.with_field(F.col("doc"), line, "_detections", F.col("detections"))).otherwise(line)
    docs.write_json_lines(d, F.when(F.col("text").isNull(), F.col("line")).otherwise(line), target)


def filter_file(spark: SparkSession, source: str, prose: str, skipped: str, fields: tuple[str, ...] = FIELDS, least: float = LEAST_CONFIDENCE, sample_bytes: int | None = 10_000) -> DataFrame:
    """Two outputs by route; returns the field counts by category."""
    d = docs.read_json_lines(spark, source)
    names = tuple(f.replace(".", "_") for f in fields)
    d = route(d.withColumns({n: docs.json_text(F.col("doc"), f) for n, f in zip(names, fields)}), names, least, sample_bytes).persist()
    line = docs.with_field(F.col("doc"), F.col("line"), "_field_classifications", F.col("fields"))
    docs.write_json_lines(d.where("route = 'prose'"), line, prose)
    docs.write_json_lines(d.where("route = 'skipped'"), line, skipped)
    return field_categories(d)


def features_file(spark: SparkSession, source: str, target: str, field: str = "text", wordlist: list[str] | None = None, sample_bytes: int | None = 10_000) -> None:
    d = docs.read_json_lines(spark, source).select(docs.json_text(F.col("doc"), field).alias("text")).where("text IS NOT NULL")
    docs.write_feature_csv(with_features(d, sample_bytes=sample_bytes, wordlist=wordlist), list(FEATURES), target)


def label_corpus(spark: SparkSession, source: str, target: str, field: str = "text", features: bool = False, classifier: Classifier | None = None) -> None:
    """text, label, sub_type, confidence, tier, reason and, if asked for, the features."""
    c = classifier or Classifier(spark)
    d = c.transform(docs.read_json_lines(spark, source).select(docs.json_text(F.col("doc"), field).alias("text")).where("text IS NOT NULL"))
    cols = ["text", F.col("classification.category").alias("label"), "classification.sub_type", "classification.confidence", "classification.tier", "classification.reason"]
    if features:
        d = with_features(d, sample_bytes=c.sample_bytes, wordlist=c.wordlist, line_count=False)
        cols.append(F.struct(*FEATURES).alias("features"))
    d.select(*cols).write.mode("overwrite").json(target)


def validate(spark: SparkSession, source: str, field: str = "text", classifier: Classifier | None = None) -> dict:
    """Accuracy, tiers, per-category metrics and confusion of labelled documents. Documents without text or label are not counted."""
    d = docs.read_json_lines(spark, source)
    d = d.select(docs.json_text(F.col("doc"), field).alias("text"), docs.json_text(F.col("doc"), "label").alias("label"), docs.json_text(F.col("doc"), "expected_category").alias("expected_category"))
    d = (classifier or Classifier(spark)).transform(d.withColumn("truth", label_column(d, ("label", "expected_category"))).where("text IS NOT NULL AND truth IS NOT NULL")).withColumn("pred", F.col("classification.category")).persist()
    tiers = {r["tier"]: r["n"] for r in d.groupBy("classification.tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        **metrics.accuracy(d, "truth", "pred").first().asDict(),
        "tier_1_count": tiers.get("structural", 0),
        "tier_2_count": tiers.get("model", 0),
        "per_category": [r.asDict() for r in metrics.per_category(d, "truth", "pred").where("support > 0").orderBy("label").collect()],
        "confusion": [r.asDict() for r in metrics.confusion(d, "truth", "pred").collect()],
    }


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="prosewright")
    p.add_argument("verb", choices=["text", "file", "filter", "features", "label-corpus", "validate"])
    p.add_argument("input", help="a path, a text for the verb text, or - for standard input")
    p.add_argument("-o", "--output")
    p.add_argument("--skipped")
    p.add_argument("--field", action="append")
    p.add_argument("--min-confidence", type=float, default=LEAST_CONFIDENCE)
    p.add_argument("--with-features", action="store_true")
    p.add_argument("--human", action="store_true", help="one line for people instead of JSON")
    p.add_argument("--model", help="an ONNX file at a path all workers have")
    p.add_argument("--config", help="the JSON that stands beside the model")
    p.add_argument("--min-score", type=float)
    p.add_argument("--wordlist", help="a text file of one word a line")
    p.add_argument("--sample-bytes", type=int, default=10_000, help="how much of a text is looked at; 0 for all")
    a = p.parse_args(argv)
    if bool(a.model) != bool(a.config):
        p.error("--model and --config go together")
    spark = SparkSession.builder.appName("prosewright").getOrCreate()
    field, sample = (a.field or ["text"])[0], a.sample_bytes or None
    words = docs.read_words(spark, a.wordlist) if a.wordlist else None
    config = ModelConfig.load(a.config) if a.config else None
    c = Classifier(spark, config, scoring.onnx_model(a.model) if a.model else None, a.min_score, words, sample)
    source = a.input
    if source == "-":
        source = docs.from_stream(spark, sys.stdin) if a.verb != "text" else sys.stdin.read()
    if a.verb == "text":
        d = c.transform(docs.inline(spark, source))
        line = human_with_detections(F.col("classification"), F.col("detections")) if "detections" in d.columns else human(F.col("classification"))
        print(d.select(line if a.human else F.to_json("classification")).first()[0])
    elif a.verb == "file":
        classify_file(spark, source, a.output, field, c)
    elif a.verb == "filter":
        filter_file(spark, source, a.output, a.skipped or f"{a.output}-skipped", tuple(a.field or FIELDS), a.min_confidence, sample).show(truncate=False)
    elif a.verb == "features":
        features_file(spark, source, a.output, field, words, sample)
    elif a.verb == "label-corpus":
        label_corpus(spark, source, a.output, field, a.with_features, c)
    else:
        print(json.dumps(validate(spark, source, field, c), indent=2))
    clean_up(spark)
