"""Metrics of predictions and annotators, as grouped aggregations. Empty denominators give 0 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.labels import SEMANTIC_LABELS, category_order


def _per(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _hits(truth: str, pred: str) -> Column:
    return F.count_if(F.col(truth) == F.col(pred))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(total, correct, accuracy) of one row."""
    n = df.agg(F.count(F.lit(1)).alias("total"), _hits(truth, pred).alias("correct"))
    return n.withColumn("accuracy", _per(F.col("correct"), F.col("total")))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(actual, predicted, n), in category order then by name. Null labels are no pair."""
    c = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(category_order(F.col("actual")), "actual", category_order(F.col("predicted")), "predicted")


def confusion_table(df: DataFrame, truth: str, pred: str, labels: list[str] | None = None) -> DataFrame:
    """(actual, n, one column for each predicted label): all labels that occur on either side, in the given order first, then by name; rows without a pair are 0.

    The labels become columns, so they must be few: more than 1,000 are an error.
    """
    c = confusion(df, truth, pred)
    there = [r[0] for r in c.select("actual").union(c.select("predicted")).distinct().limit(1001).collect()]
    if len(there) > 1000:
        raise ValueError("too many labels for a table")
    order = [x for x in labels or [] if x in there]
    order += sorted(set(there) - set(order))
    rows = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], "actual string, place int")
    wide = c.groupBy("actual").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("predicted") == x, F.col("n"))), F.lit(0)).alias(x) for x in order])
    return rows.join(wide, "actual", "left").fillna(0).orderBy("place").drop("place")


def aligned(tables: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """One row a record with a struct of `columns` from each annotator's table, by name.

    Tables of other columns, other numbers of rows, repeated keys or other keys are an error.
    """
    names = list(tables)
    for name, df in tables.items():
        lacking = {key, *columns} - set(df.columns)
        if lacking:
            raise ValueError(f"{name} has no {', '.join(sorted(lacking))}")
    parts = [df.select(F.col(key), F.lit(i).alias("_t"), F.struct(*columns).alias("_v")) for i, df in enumerate(tables.values())]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    one = d.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("_t") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)], *[F.count_if(F.col("_t") == i).alias(f"_c{i}") for i in range(len(names))])
    odd = one.where(" OR ".join(f"_c{i} <> 1" for i in range(len(names))))
    bad = odd.select(key).limit(5).collect()
    if bad:
        raise ValueError(f"tables don't hold the same records: {[r[0] for r in bad]}")
    return one.select(key, *names)


def per_category(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support) for every label that occurs on either side: one pass, from the confusion pairs."""
    pairs = df.groupBy(F.col(truth).alias("a"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit("a").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("x"), "n", (F.col("a") == F.col("p")).alias("hit"))
    g = sides.where("x.label IS NOT NULL").groupBy("x.label").agg(
        F.sum(F.when((F.col("x.side") == "a") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.side") == "a", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.side") == "p", F.col("n")).otherwise(0)).alias("found"),
    )
    g = g.withColumn("precision", _per(F.col("tp"), F.col("found"))).withColumn("recall", _per(F.col("tp"), F.col("support")))
    f1 = _per(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return g.select("label", "precision", "recall", f1.alias("f1"), F.col("support").cast("long").alias("support"))


def slice_accuracy(df: DataFrame, field: str, truth: str, pred: str) -> DataFrame:
    """(value, total, correct, accuracy) by a field; nulls are left out."""
    g = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("total"), _hits(truth, pred).alias("correct"))
    return g.withColumn("accuracy", _per(F.col("correct"), F.col("total")))


def slice_report(df: DataFrame, fields: list[str], truth: str, pred: str) -> DataFrame:
    """(field, value, total, correct, accuracy) for all fields in one pass: grouping sets of one field each."""
    packed = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"), truth, pred)
    g = packed.where("x.value IS NOT NULL").groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("total"), _hits(truth, pred).alias("correct"))
    return g.withColumn("accuracy", _per(F.col("correct"), F.col("total")))


def top_confusions(df: DataFrame, truth: str, pred: str, id_col: str, field: str | None = None, k: int = 10) -> DataFrame:
    """The k most frequent wrong (truth, prediction[, field]); ties to the one first seen (least id). A report of k rows."""
    d = df.where(F.col(truth) != F.col(pred))
    keys = [F.col(truth).alias("expected"), F.col(pred).alias("predicted")]
    if field:
        d = d.where(F.col(field).isNotNull())
        keys.append(F.col(field).cast("string").alias("value"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first")).orderBy(F.desc("n"), "first").limit(k).drop("first")


def long_flags(df: DataFrame, labels: list[str], prefix: str = "det_", keep: list[str] | None = None) -> DataFrame:
    """One row per record and label: (keep..., label, flag)."""
    keep = keep or []
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.coalesce(F.col(prefix + x).cast("int"), F.lit(0)).alias("flag")) for x in labels])
    return df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.label", "_x.flag")


def detection_metrics(df: DataFrame, labels: list[str], truth_prefix: str, pred_prefix: str) -> DataFrame:
    """(label, precision, recall, f1, support) per label and, as label `micro`, over all; macro is the mean of f1, and Hamming loss the share of wrong slots: both stand in every row."""
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.coalesce(F.col(truth_prefix + x).cast("int"), F.lit(0)).alias("t"), F.coalesce(F.col(pred_prefix + x).cast("int"), F.lit(0)).alias("p")) for x in labels])
    d = df.select(F.explode(pairs).alias("x")).select("x.*")
    g = d.rollup("label").agg(
        F.count_if((F.col("t") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if((F.col("t") == 0) & (F.col("p") == 1)).alias("fp"), F.count_if((F.col("t") == 1) & (F.col("p") == 0)).alias("fn"), F.count(F.lit(1)).alias("slots"), F.grouping("label").alias("_all")
    )
    g = g.withColumn("label", F.when(F.col("_all") == 1, "micro").otherwise(F.col("label")))
    g = g.withColumn("precision", _per(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _per(F.col("tp"), F.col("tp") + F.col("fn")))
    g = g.withColumn("f1", _per(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    whole = Window.partitionBy(F.lit(1))  # one row per label
    g = g.withColumn("macro_f1", F.coalesce(F.avg(F.when(F.col("_all") == 0, F.col("f1"))).over(whole), F.lit(0.0)))
    g = g.withColumn("hamming_loss", F.max(F.when(F.col("_all") == 1, _per(F.col("fp") + F.col("fn"), F.col("slots")))).over(whole))
    return g.select("label", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"), "macro_f1", "hamming_loss")


def diversity(df: DataFrame, by: str = "sub_type") -> DataFrame:
    """Per sub-type: records, distinct temperatures, templates and domains, the buckets seen, and records per model."""
    models = df.where(F.col(by).isNotNull() & F.col("model").isNotNull()).groupBy(by, "model").agg(F.count(F.lit(1)).alias("n"))
    models = models.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("models"))
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("temperature").alias("temperatures"), F.count_distinct("prompt_template").alias("templates"), F.count_distinct("content_domain").alias("domains"), F.array_sort(F.collect_set("length_bucket")).alias("buckets")
    )
    return g.join(models, by, "left")


def diversity_warnings(df: DataFrame, by: str = "sub_type", most: float = 0.15) -> DataFrame:
    """(sub_type, model, n, share) of models with more than `most` of a sub-type's records."""
    g = df.where(F.col(by).isNotNull() & F.col("model").isNotNull()).groupBy(by, "model").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    return g.where(F.col("share") > most)


def escalation(df: DataFrame, by: str = "sub_type", agrees: str = "tier1_agrees") -> DataFrame:
    """(sub_type, n, agreement_rate, escalation_rate); null agreement counts neither way."""
    rate = F.avg(F.col(agrees).cast("double"))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), rate.alias("agreement_rate"), (1 - rate).alias("escalation_rate"))


def annotator_agreement(votes: DataFrame, key: str, label: str, flag: str) -> DataFrame:
    """Per label over rows several annotators flagged (long table, one row per record, annotator and label): mean share of the majority, share of unanimous rows, share of split ones."""
    rows = votes.groupBy(key, label).agg(F.count_if(F.col(flag) == 1).alias("_ones"), F.count(F.lit(1)).alias("_k"))
    share = F.greatest(F.col("_ones"), F.col("_k") - F.col("_ones")) / F.col("_k")
    return rows.groupBy(label).agg(F.avg(share).alias("mean_agreement"), F.avg((share == 1).cast("double")).alias("unanimous_rate"), F.avg((share < 1).cast("double")).alias("split_rate"))


def injected_recall(votes: DataFrame, key: str, source: str = "audit_source", majority: int = 2) -> DataFrame:
    """(label, recall) over injected rows: share with at least `majority` annotators' flag for the injected label; null where nothing was injected. votes: (key, annotator, source, label, flag)."""
    inj = votes.where(F.col(source) == F.concat(F.lit("inject_"), F.col("label")))
    rows = inj.groupBy("label", key).agg(F.count_if(F.col("flag") == 1).alias("ones"))
    found = rows.groupBy("label").agg(F.avg((F.col("ones") >= majority).cast("double")).alias("recall"))
    labels = votes.sparkSession.createDataFrame([(x,) for x in SEMANTIC_LABELS], "label string")
    return labels.join(found, "label", "left")


# The gate's least agreement and recall.
LEAST_AGREEMENT, LEAST_RECALL = 0.995, 0.90


def gate(agreement: DataFrame, recall: DataFrame, least_agreement: float = LEAST_AGREEMENT, least_recall: float = LEAST_RECALL) -> DataFrame:
    """(label, passes): agreement is enough or missing, and recall is enough; missing recall fails."""
    j = recall.join(agreement, "label", "left")
    ok = F.coalesce((F.col("mean_agreement") >= least_agreement) | F.isnan("mean_agreement"), F.lit(True)) & F.coalesce(F.col("recall") >= least_recall, F.lit(False))
    return j.select("label", ok.alias("passes"))


def fire_stats(df: DataFrame, labels: list[str], sub_type: str = "sub_type", prefix: str = "det_") -> DataFrame:
    """(label, total_fires, self_match, cross_fire, fire_rate, cross_fire_ratio)."""
    d = long_flags(df, labels, prefix, [sub_type])
    g = d.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("flag") == 1).alias("total_fires"), F.count_if((F.col("flag") == 1) & F.coalesce(F.col(sub_type) == F.col("label"), F.lit(False))).alias("self_match"))
    g = g.withColumn("cross_fire", F.col("total_fires") - F.col("self_match"))
    return g.select("label", "total_fires", "self_match", "cross_fire", _per(F.col("total_fires"), F.col("_n")).alias("fire_rate"), _per(F.col("cross_fire"), F.col("total_fires")).alias("cross_fire_ratio"))


# Thresholds of label buckets.
WEAK_RATE, WEAK_CROSS, LOW_AGREEMENT = 0.01, 10, 0.9


def label_buckets(stats: DataFrame, agreement: DataFrame) -> DataFrame:
    """fire_stats plus booleans strong, weak, low_agreement, suspicious."""
    j = stats.join(agreement.select("label", "mean_agreement"), "label", "left")
    weak = (F.col("fire_rate") < WEAK_RATE) | (F.col("cross_fire") < WEAK_CROSS)
    return j.withColumns(
        {
            "weak": weak,
            "strong": ~weak & (F.col("cross_fire") >= 100),
            "low_agreement": F.coalesce(F.col("mean_agreement") < LOW_AGREEMENT, F.lit(False)),
            "suspicious": (F.col("fire_rate") < 0.02) & (F.col("total_fires") > 0) & (F.col("cross_fire_ratio") < 0.3),
        }
    )


def cooccurrence(df: DataFrame, labels: list[str], prefix: str = "det_") -> DataFrame:
    """(a, b, n), a < b: how often two labels fire on one record. A record's pairs are bounded by the label list."""
    fired = F.array_sort(F.array_compact(F.array(*[F.when(F.col(prefix + x) == 1, F.lit(x)) for x in labels])))
    d = df.select(fired.alias("f")).where(F.size("f") > 1)
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice(F.col("f"), i + 2, len(labels)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return d.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("n"))


def sub_type_detections(df: DataFrame, labels: list[str], k: int = 5, prefix: str = "det_") -> DataFrame:
    """(sub_type, label, n, rank): the k labels that fire most on each sub-type; ties by name. A top-k report."""
    g = long_flags(df, labels, prefix, ["sub_type"]).where("flag = 1 AND sub_type IS NOT NULL").groupBy("sub_type", "label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("sub_type").orderBy(F.desc("n"), "label"))).where(F.col("rank") <= k)


def divergence(a: DataFrame, b: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(feature, mean_abs_error, max_abs_error, mean_a, mean_b) of two feature tables of the same records."""
    pack = lambda d, n: d.select(key, F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.col(f).cast("double") for f in features])).alias(n))
    j = pack(a, "x").join(pack(b, "y"), key).select(F.explode(F.array(*map(F.lit, features))).alias("feature"), "x", "y")
    j = j.select("feature", F.col("x")[F.col("feature")].alias("p"), F.col("y")[F.col("feature")].alias("q"))
    return j.groupBy("feature").agg(F.avg(F.abs(F.col("p") - F.col("q"))).alias("mean_abs_error"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_abs_error"), F.avg("p").alias("mean_a"), F.avg("q").alias("mean_b"))


def detector_summary(df: DataFrame, label: str, predicted: str, detector: str) -> DataFrame:
    """One row of counts that hold labels, predictions and a third opinion against each other, with the accuracy if label errors the detector confirms were right."""
    wrong = F.col(label) != F.col(predicted)
    n = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(wrong).alias("errors"),
        F.count_if(F.col(detector) == F.col(label)).alias("agrees_with_label"),
        F.count_if(F.col(detector) == F.col(predicted)).alias("agrees_with_prediction"),
        F.count_if((F.col(detector) != F.col(label)) & (F.col(detector) != F.col(predicted))).alias("disagrees_with_both"),
        F.count_if(wrong & (F.col(detector) == F.col(predicted))).alias("mislabel_candidates"),
        F.count_if(wrong & (F.col(detector) == F.col(label))).alias("model_errors"),
    )
    n = n.withColumn("ambiguous", F.col("errors") - F.col("mislabel_candidates") - F.col("model_errors"))
    return n.withColumn("estimated_accuracy", F.round(_per(F.col("total") - F.col("errors") + F.col("mislabel_candidates"), F.col("total")), 4))


def plan_summary(plan: DataFrame) -> DataFrame:
    """(entries, target, synthetic_target, real_target) of a source plan's distinct entries."""
    t = F.coalesce("target_count", F.lit(0))
    return plan.distinct().agg(F.count(F.lit(1)).alias("entries"), F.sum(t).alias("target"), F.coalesce(F.sum(F.when(F.col("synthetic"), t)), F.lit(0)).alias("synthetic_target"), F.coalesce(F.sum(F.when(~F.col("synthetic"), t)), F.lit(0)).alias("real_target"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): inverse frequency, n_total / (classes x n)."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))  # one row per class
    return g.withColumn("weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")))


def feature_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std): population moments; a standard deviation of 0 is given as 1."""
    d = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.*")
    s = F.stddev_pop("v")
    return d.groupBy("feature").agg(F.avg("v").alias("mean"), F.when(s == 0, F.lit(1.0)).otherwise(s).alias("std"))
