"""Decisions from several opinions, and their application to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.labels import DETECTOR_SUB_TYPE, VALID_SUB_TYPES, lookup
from prosewright.operators.parsing import canonical_vote


def tiered_decision(tier1: Column, tier2: Column, relabel: Column, valid: list[str] | None = None) -> Column:
    """Struct (action, new_sub_type): keep if a tier agrees; relabel to a valid sub-type the second tier names; else drop. A null second tier was not asked."""
    ok = F.coalesce(relabel.isin(*(valid or VALID_SUB_TYPES)), F.lit(False))
    agrees = F.coalesce(tier1, F.lit(False)) | F.coalesce(tier2, F.lit(False))
    action = F.when(agrees, "keep").when(tier2.isNull(), "drop").when(ok, "relabel").otherwise("drop")
    return F.struct(action.alias("action"), F.when(action == "relabel", relabel).alias("new_sub_type"))


def vote3(a: Column, b: Column, c: Column) -> Column:
    """Struct (label, method): unanimous, majority of two, or tie (manual_review). Nulls agree with nobody."""
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    return (
        F.when(same(a, b) & same(b, c), F.struct(a.alias("label"), F.lit("unanimous").alias("method")))
        .when(same(a, b) | same(a, c), F.struct(a.alias("label"), F.lit("majority").alias("method")))
        .when(same(b, c), F.struct(b.alias("label"), F.lit("majority").alias("method")))
        .otherwise(F.struct(F.lit("manual_review").alias("label"), F.lit("tie").alias("method")))
    )


def vote4(label: Column, model: Column, third: Column, fourth: Column) -> Column:
    """Struct (verdict, winner): the most frequent opinion, the first voter's among equals; exactly two opinions of two votes each are a TIE."""
    votes = F.array(label, model, third, fourth)
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct(F.size(F.filter(votes, lambda x: x.eqNullSafe(v))).alias("n"), (-F.array_position(votes, v)).alias("first"), v.alias("v")))
    best = F.array_max(counted)
    tie = (best["n"] < 3) & (F.size(counted) == 2)
    verdict = F.when(tie, "TIE").when(best["v"] == label, "KEEP_LABEL").otherwise("FIX_LABEL")
    return F.struct(verdict.alias("verdict"), best["v"].alias("winner"))


def error_verdict(label: Column, model: Column, judge: Column) -> Column:
    """For a wrong prediction: is the label at fault, the model, or neither for sure?"""
    return F.when((judge == model) & (judge != label), "FIX_LABEL").when((judge != label) & (judge != model), "AMBIGUOUS").otherwise("MODEL_WRONG")


def label_verdict(label: Column, detector: Column, judge: Column) -> Column:
    """For a label a detector disputes: CORRECT it, KEEP it, or AMBIGUOUS."""
    return F.when((detector == judge) & (detector != label), "CORRECT").when((detector != judge) & (judge != label), "AMBIGUOUS").otherwise("KEEP")


def detector_verdict(label: Column, model: Column, detector: Column) -> Column:
    """Null where prediction and label agree."""
    return F.when(label != model, F.when(detector == model, "LIKELY_MISLABEL").when(detector == label, "REAL_MODEL_ERROR").otherwise("AMBIGUOUS"))


def disputed(df: DataFrame, label: str, detector: str, score: str, least: float = 0.5) -> DataFrame:
    """Rows whose detector category is known, differs from the label and is sure enough."""
    return df.where((F.col(detector) != "unknown") & (F.col(detector) != F.col(label)) & (F.col(score) >= least))


def flag_agrees(df: DataFrame, sub_type: str = "sub_type", labels: list[str] | None = None, prefix: str = "det_", alias: dict[str, str] | None = None) -> Column:
    """Is the flag of the row's own sub-type set? Sub-types without a flag never agree; alias maps sub-types to other flags first."""
    labels = labels or [c[len(prefix) :] for c in df.columns if c.startswith(prefix)]
    own = lookup(alias, F.col(sub_type), F.col(sub_type)) if alias else F.col(sub_type)
    out = F.lit(False)
    for x in labels:
        out = F.when(own == x, F.coalesce(F.col(prefix + x) == 1, F.lit(False))).otherwise(out)
    return out


def real_sub_type(current: Column, ghosts: list[str], detected: Column, group: Column) -> Column:
    """Sub-types that are no longer labels become what a detector says, or plain for text, else unknown."""
    new = lookup(DETECTOR_SUB_TYPE, detected, F.when(group == "text", "plain").otherwise(F.lit("unknown")))
    return F.when(current.isin(*ghosts), new).otherwise(current)


def last_corrections(votes: DataFrame, key: str = "index", order: str = "line_no", category: str = "detector_category") -> DataFrame:
    """(key, category) of the last CORRECT verdict per key."""
    v = votes.where(F.col("verdict") == "CORRECT")
    return v.groupBy(key).agg(F.max_by(category, order).alias("corrected"))


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str, category: str = "category") -> DataFrame:
    """df with corrected categories where there are any."""
    c = corrections.select(F.col(key).alias("_k"), "corrected")
    return df.join(c, F.col(key) == F.col("_k"), "left").withColumn(category, F.coalesce("corrected", category)).drop("_k", "corrected")


# What a voted label makes of a row.
_VOTED = {"c_cpp": ("code", "c_cpp"), "objc": ("code", "objc"), "prose": ("prose", "plain")}


def apply_voted(df: DataFrame, voted: DataFrame, key: str, label: str = "label") -> DataFrame:
    """df with voted labels: `drop` removes the row, `manual_review` and `unknown` leave it, others set category and sub_type."""
    v = voted.select(F.col(key).alias("_k"), canonical_vote(F.col(label)).alias("_v"))
    d = df.join(v, F.col(key) == F.col("_k"), "left").where(~F.coalesce(F.col("_v") == "drop", F.lit(False)))
    sets = F.col("_v").isNotNull() & ~F.col("_v").isin("manual_review", "unknown")
    cat = lookup({k: c for k, (c, _) in _VOTED.items()}, F.col("_v"), F.lit("unknown"))
    sub = lookup({k: s for k, (_, s) in _VOTED.items()}, F.col("_v"), F.col("_v"))
    return d.withColumn("category", F.when(sets, cat).otherwise(F.col("category"))).withColumn("sub_type", F.when(sets, sub).otherwise(F.col("sub_type"))).drop("_k", "_v")


def relabel_bulk(df: DataFrame, drop_sources: list[str], prose_sources: list[str]) -> DataFrame:
    """Rows of unknown sub-type: those of drop_sources go, those of prose_sources become prose/plain."""
    unknown = F.coalesce(F.col("sub_type") == "unknown", F.lit(False))
    d = df.where(~(unknown & F.coalesce(F.col("source").isin(*drop_sources), F.lit(False))))
    hit = unknown & F.coalesce(F.col("source").isin(*prose_sources), F.lit(False))
    return d.withColumn("category", F.when(hit, "prose").otherwise(F.col("category"))).withColumn("sub_type", F.when(hit, "plain").otherwise(F.col("sub_type")))


def corrected_and_ties(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two outputs: decided votes, FIX_LABEL written as CORRECT, and ties."""
    done = votes.where("verdict <> 'TIE'").withColumn("verdict", F.when(F.col("verdict") == "FIX_LABEL", "CORRECT").otherwise(F.col("verdict")))
    return done, votes.where("verdict = 'TIE'")


def tally(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share): how often each outcome came out; null is one of them."""
    every = Window.partitionBy(F.lit(1))  # one row for each outcome
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(every))


def all_resolved(df: DataFrame, sub_type: str = "sub_type", unresolved: tuple[str, ...] = ("unknown", "manual_review")) -> DataFrame:
    """df itself; rows whose label is still open are an error that says how many there are."""
    open_ = df.where(F.col(sub_type).isin(*unresolved)).count()
    if open_:
        raise ValueError(f"{open_} rows are still unresolved")
    return df


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet (resume after a checkpoint)."""
    return df.join(done.select(key), key, "left_anti")


def escalated(votes: DataFrame, routing: DataFrame, sub_type: str = "sub_type") -> DataFrame:
    """Votes the first tier disagreed on whose sub-type has a second-tier annotator."""
    return votes.where("NOT tier1_agrees").join(F.broadcast(routing.select(sub_type)), sub_type, "left_semi")


def routed(df: DataFrame, routing: DataFrame, default: str, sub_type: str = "sub_type", model: str = "model") -> DataFrame:
    """df plus `annotator`: the annotator of the row's sub-type, or the default. routing is a small table of settings."""
    r = routing.select(F.col(sub_type).alias("_s"), F.col(model).alias("_a"))
    return df.join(F.broadcast(r), F.col(sub_type) == F.col("_s"), "left").withColumn("annotator", F.coalesce("_a", F.lit(default))).drop("_s", "_a")


def merge_tiers(tier1: DataFrame, tier2: DataFrame, key: str) -> DataFrame:
    """First-tier results with second-tier columns, null where that tier was not asked."""
    return tier1.join(tier2, key, "left")


def manifest_drift(saved: dict[str, str | None], current: dict[str, str | None]) -> list[str]:
    """Names whose saved and current checksums differ; empty values are not compared."""
    return [k for k, v in current.items() if v and saved.get(k) and saved[k] != v]
