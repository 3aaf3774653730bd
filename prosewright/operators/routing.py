"""Routing of multi-field documents: prose in any field lets the document through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.operators.rules import classify

# Default fields, least confidence, and the bytes under which a field is taken as prose.
FIELDS = ("bodytext", "summarytext", "title")
LEAST_CONFIDENCE = 0.6
SHORT_BYTES = 50


def passes(category: Column, confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Prose, or not sure enough of anything else."""
    return (category == "prose") | (confidence < F.lit(least).cast("float"))


def route(df: DataFrame, fields: tuple[str, ...] = FIELDS, least: float = LEAST_CONFIDENCE, sample_bytes: int | None = 10_000) -> DataFrame:
    """df plus `fields` (map of field to classification) and `route` ('prose' or 'skipped').

    Null fields are missing: they are not classified. A document without any of the fields is skipped.
    """
    d = df
    entries = []
    short = F.struct(F.lit("prose").alias("category"), F.lit(None).cast("string").alias("sub_type"), F.lit(1.0).cast("float").alias("confidence"), F.lit("short field").alias("reason"), F.lit(None).cast("string").alias("tier"))
    for f in fields:
        d = classify(d, f, f"_c_{f}", sample_bytes)
        entries.append(F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.when(F.octet_length(f) < SHORT_BYTES, short).otherwise(F.col(f"_c_{f}")).alias("value"))))
    d = d.withColumn("_all", F.array_compact(F.array(*entries)))
    hit = F.exists("_all", lambda x: passes(x["value"]["category"], x["value"]["confidence"], least))
    d = d.withColumn("fields", F.map_from_entries("_all")).withColumn("route", F.when(hit, "prose").otherwise("skipped"))
    return d.drop("_all", *[f"_c_{f}" for f in fields])


def field_categories(routed: DataFrame) -> DataFrame:
    """(category, n): classified fields by category, most first."""
    return routed.select(F.explode("fields").alias("field", "c")).groupBy("c.category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")
