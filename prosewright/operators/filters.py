"""Predicates and small projections over documents and samples, as boolean Columns (null texts give false)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions.features import with_features
from prosewright.functions.labels import CATEGORIES, CATEGORY_OVERRIDES, lookup
from prosewright.functions.textprims import WS, trim

# Size limits in bytes and characters, and the schema's value sets.
SIZE_BYTES = (50, 50_000)
SIZE_CHARS = (50, 10_000)
BOUNDARY_PAIRS = [f"{a}_{b}" for i, a in enumerate(CATEGORIES) for b in CATEGORIES[i + 1 :]]
LENGTH_BUCKETS = ["short", "medium", "long"]
SYNTHETIC_SOURCE = "unknown"

# How the first line of a generated file begins, letter case ignored.
GENERATED = [
    r"^//\s*Code generated",
    r"^#\s*AUTO[- ]GENERATED",
    r"^/\*\s*AUTO\s+GENERATED",
    r"^#\s*This file is auto-generated",
    r"^//\s*DO NOT EDIT",
    r"^#\s*DO NOT EDIT",
    r"^/\*\s*DO NOT EDIT",
    r"^<!--\s*AUTO[- ]GENERATED",
]
_GENERATED = "(?i)" + "|".join(GENERATED)


def _full_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))


def size_ok(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).between(*SIZE_BYTES), F.lit(False))


def length_ok(text: Column) -> Column:
    """Trimmed length in characters."""
    return F.coalesce(F.length(trim(text)).between(*SIZE_CHARS), F.lit(False))


def quality_ok(text: Column) -> Column:
    """At least 5 full lines, at most 500 lines, not marked as generated, at most 10 % characters that don't print."""
    full = _full_lines(text)
    dark = F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ \n\r\t]]")) / F.greatest(F.length(text), F.lit(1))
    ok = (F.size(full) >= 5) & (F.size(F.split(text, "\n")) <= 500) & ~F.coalesce(trim(F.get(full, F.lit(0))).rlike(_GENERATED), F.lit(False)) & (dark <= 0.10)
    return F.coalesce(ok, F.lit(False))


def length_bucket(text: Column) -> Column:
    n = F.size(_full_lines(F.coalesce(text, F.lit(""))))
    return F.when(n < 10, "short").when(n <= 50, "medium").otherwise("long")


def licence_ok(path: Column, content: Column, keywords: list[str]) -> Column:
    """A keyword (upper case) in the path or the first 500 characters."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.upper(F.coalesce(path, F.lit(""))), F.lit(k)) | F.contains(F.upper(F.substring(F.coalesce(content, F.lit("")), 1, 500)), F.lit(k))
    return hit


def sample_ok(text: Column, category: Column, pair: Column, categories: list[str] | None = None) -> Column:
    """A sample fits the schema: text, a known category, and a boundary pair that is null or known and names the category."""
    cats = categories or CATEGORIES
    pairs = [f"{a}_{b}" for a in cats for b in cats if a != b]
    ok = (F.length(text) > 0) & category.isin(*cats) & (pair.isNull() | (pair.isin(*pairs) & F.array_contains(F.split(pair, "_"), category)))
    return F.coalesce(ok, F.lit(False))


def provenance_ok() -> Column:
    """All provenance columns are there: non-empty texts, a temperature from 0 to 2, a known length bucket, a flag."""
    ok = F.lit(True)
    for c in ("model", "prompt_template", "content_domain", "sub_type"):
        ok = ok & (F.length(c) > 0)
    ok = ok & F.col("temperature").between(0.0, 2.0) & F.col("length_bucket").isin(*LENGTH_BUCKETS) & F.col("reasoning_mode").isNotNull()
    return F.coalesce(ok, F.lit(False))


def override_category(category: Column, sub_type: Column) -> Column:
    return lookup(CATEGORY_OVERRIDES, sub_type, category)


def reclassify(df: DataFrame, text: str = "text", into: str = "reclassified", wordlist: list[str] | None = None) -> DataFrame:
    """A category from content, for rows labelled artifact or skip: six features of the whole text, five rules in order."""
    names = ["sentence_coherence_score", "dictionary_word_ratio", "alpha_ratio", "key_value_ratio", "comment_ratio", "delimiter_consistency"]
    d = with_features(df.withColumn("_text", F.replace(F.col(text), F.lit("\\n"), F.lit("\\ n"))), "_text", names, None, wordlist, line_count=False)
    c = {n: F.col(n) for n in names}
    rule = (  # Fixed values: the bounds.
        F.when((c["sentence_coherence_score"] > 0.3) & (c["dictionary_word_ratio"] > 0.5), "prose")
        .when((c["key_value_ratio"] > 0.3) | (c["delimiter_consistency"] > 0.5), "structured")
        .when(c["comment_ratio"] > 0.2, "code")
        .when((c["dictionary_word_ratio"] > 0.5) & (c["alpha_ratio"] > 0.8), "prose")
        .otherwise("structured")
    )
    return d.withColumn(into, rule).drop("_text", *names)


def split_synthetic(df: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(kept, archived): rows of the synthetic source are archived; a null source is kept."""
    synthetic = F.coalesce(F.col(source) == SYNTHETIC_SOURCE, F.lit(False))
    return df.where(~synthetic), df.where(synthetic)


def clear_and_boundary(df: DataFrame, pair: str = "boundary_pair") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(pair).isNull()), df.where(F.col(pair).isNotNull())


def label_column(df: DataFrame, order: tuple[str, ...] = ("expected_category", "category", "label")) -> Column:
    """The first label column there is, row by row the first that isn't null."""
    there = [F.col(c) for c in order if c in df.columns]
    if not there:
        raise ValueError(f"none of {order} is a column")
    return F.coalesce(*there)


def kept_columns(all_: list[str], drop: list[str]) -> list[str]:
    """Feature columns without some; unknown names and an empty rest are errors. Entries may hold several names, by commas."""
    names = [x.strip() for d in drop for x in d.split(",") if x.strip()]
    odd = sorted(set(names) - set(all_))
    if odd:
        raise ValueError(f"unknown features: {', '.join(odd)}")
    rest = [c for c in all_ if c not in names]
    if not rest:
        raise ValueError("no feature is left")
    return rest


def prediction_record(df: DataFrame, predicted: Column) -> DataFrame:
    """The columns of a sample a prediction keeps, and the prediction."""
    keep = ["text", "expected_category", "boundary_pair", "source", "model", "temperature", "prompt_template", "content_domain", "length_bucket", "reasoning_mode", "sub_type"]
    return df.withColumn("predicted_category", predicted).select(*[c for c in keep if c in df.columns], "predicted_category")
