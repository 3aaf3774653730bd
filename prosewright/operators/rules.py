"""Guards and the rule tier: features to category, confidence and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions.features import with_features
from prosewright.functions.textprims import WS, tokens

# Features the rules read, and the confidence from which a rule's answer stands.
RULE_FEATURES = ["line_length_cv", "leading_whitespace_ratio", "tab_density", "sentence_punctuation_rate", "alpha_ratio", "symbol_ratio"]
MIN_CONFIDENCE = 0.95


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def _answer(category: str, confidence: float, reason: Column | str, tier: str = "structural") -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(None).cast("string").alias("sub_type"), _f(confidence).alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(tier).alias("tier")
    )


def rule_tier() -> Column:
    """Classification struct from the columns RULE_FEATURES and line_count; the first rule that holds wins."""
    cv, lead, tab, punct, alpha, symbol = (F.col(c) for c in RULE_FEATURES)
    n = F.col("line_count")
    says = lambda text, *cols: F.format_string(text, *[c.cast("double") for c in cols])
    return (  # Fixed values: bounds and confidences.
        F.when((alpha == 0) & (punct == 0), _answer("prose", 0.0, "empty or no content"))
        .when((n >= 5) & (cv < _f(0.15)) & (symbol < _f(0.10)) & ((tab > _f(0.03)) | (punct < _f(0.01))), _answer("structured", 0.98, says("even lines: cv=%.2f symbols=%.2f", cv, symbol)))
        .when((lead > _f(0.3)) & (symbol > _f(0.08)) & (punct < _f(0.02)), _answer("code", 0.98, says("indented: lead=%.2f symbols=%.2f", lead, symbol)))
        .when((punct > _f(0.06)) & (alpha > _f(0.85)) & (symbol < _f(0.03)) & (lead < _f(0.1)), _answer("prose", 0.95, says("sentences: punct=%.2f alpha=%.2f", punct, alpha)))
        .otherwise(_answer("prose", 0.40, "deferring to model"))
    )


def is_empty(text: Column) -> Column:
    return F.coalesce(~text.rlike(f"[^{WS}]"), F.lit(True))


def is_too_short(text: Column) -> Column:
    """Fewer than 5 tokens and fewer than 20 characters, of the whole text."""
    return (F.size(tokens(text)) < 5) & (F.length(text) < 20)


def classify(df: DataFrame, text_col: str = "text", into: str = "classification", sample_bytes: int | None = 10_000, keep_features: bool = False) -> DataFrame:
    """df plus a struct (category, sub_type, confidence, reason, tier). Null and blank texts are prose with confidence 0."""
    d = with_features(df, text_col, RULE_FEATURES, sample_bytes)
    c = F.when(is_empty(F.col(text_col)), _answer("prose", 0.0, "empty or no content")).when(is_too_short(F.col(text_col)), _answer("prose", 0.5, "too short to classify")).otherwise(rule_tier())
    d = d.withColumn(into, c)
    return d if keep_features else d.drop(*RULE_FEATURES, "line_count")


def fallback() -> Column:
    """What stands in for a model that fails: prose, more surely with sentences and letters."""
    sure = (F.col("sentence_punctuation_rate") > _f(0.02)) & (F.col("alpha_ratio") > _f(0.55))
    return F.when(sure, _answer("prose", 0.5, "no model: looks like prose", "model")).otherwise(_answer("prose", 0.3, "no model: uncertain", "model"))


def human(classification: Column) -> Column:
    """One line for people: category/sub_type (confidence, tier)."""
    c = classification
    name = F.when(c["sub_type"].isNotNull(), F.concat_ws("/", c["category"], c["sub_type"])).otherwise(c["category"])
    return F.concat(name, F.format_string(" (confidence: %.2f, tier: %s)", c["confidence"].cast("double"), c["tier"]))
