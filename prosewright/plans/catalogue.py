"""The core's queries and their SQL twins, by name. Every query runs over its whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.functions import labels
from prosewright.functions.features import FEATURES, dictionary_tokens, with_features
from prosewright.functions.textprims import tokens, unescape_newlines
from prosewright.functions.words import clean_name, is_blank
from prosewright.operators import dedup, filters, metrics, parsing, rules, sampling, scoring, validators, voting
from prosewright.operators.routing import field_categories, route
from prosewright.plans import feature_sql as fs
from prosewright.session import table
from prosewright.sources import generators

WHOLE = None  # no sample: features of whole texts
MOST_WORDS = 500_000

CHARS = ["tab_density", "sentence_punctuation_rate", "paragraph_break_rate", "alpha_ratio", "symbol_ratio", "json_brace_depth", "encoding_error_ratio", "operator_density", "inline_markup_count", "parenthesis_density", "shebang_present"]
LINES = [
    "line_length_cv", "leading_whitespace_ratio", "line_uniqueness", "short_line_ratio", "key_value_ratio", "xml_tag_ratio", "log_line_ratio", "comment_ratio", "hyphenated_line_break_ratio", "page_number_density", "table_fragment_score",
    "uppercase_header_ratio", "sentence_coherence_score", "avg_words_per_line", "markup_heading_ratio", "semicolon_line_ending_ratio", "list_item_ratio", "section_header_ratio",
]
SHAPES = ["delimiter_consistency", "numeric_field_ratio", "repetitive_structure_score", "short_repeated_line_ratio", "indentation_consistency"]


def _r4(c: str) -> Column:
    return F.round(F.col(c).cast("double"), 4).alias(c)


def _features(names: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = with_features(table(spark, d, "documents"), names=names, sample_bytes=WHOLE, line_count=False)
        return f.select("doc_id", *[_r4(n) for n in names])

    return run


def feat_entropy(spark, d):
    f = with_features(table(spark, d, "documents"), names=["char_entropy"], sample_bytes=WHOLE, line_count=False)
    return f.select("doc_id", _r4("char_entropy"))


def feat_ngrams(spark, d):
    f = with_features(table(spark, d, "documents"), names=["repeated_ngram_ratio"], sample_bytes=WHOLE, line_count=False)
    return f.select("doc_id", _r4("repeated_ngram_ratio"))


def feat_runs(spark, d):
    names = ["prose_paragraph_ratio", "code_fence_density"]
    f = with_features(table(spark, d, "documents"), names=names, sample_bytes=WHOLE, line_count=False)
    return f.select("doc_id", *[_r4(n) for n in names])


def feat_json_lines(spark, d):
    names = ["json_lines_ratio", "label_value_line_ratio"]
    f = with_features(table(spark, d, "documents"), names=names, sample_bytes=WHOLE, line_count=True)
    return f.select("doc_id", _r4("json_lines_ratio"), _r4("label_value_line_ratio"), "line_count")


def feat_dictionary(spark, d):
    """dictionary_word_ratio by a join with the word list: the form for lists too long for a literal."""
    words = table(spark, d, "wordlist").select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()
    docs = table(spark, d, "documents").select("doc_id", F.explode_outer(dictionary_tokens(tokens(unescape_newlines(F.coalesce("text", F.lit("")))))).alias("word"))
    hit = docs.join(words.withColumn("known", F.lit(1)), "word", "left")
    g = hit.groupBy("doc_id").agg(F.count("word").alias("n"), F.count("known").alias("k"))
    return g.select("doc_id", F.round(F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).cast("float").cast("double"), 4).alias("dictionary_word_ratio"))


def features_all(spark, d):
    """All 41 features of every document, the dictionary from the word list."""
    words = [r[0] for r in table(spark, d, "wordlist").select(F.lower(F.trim("word"))).where("word IS NOT NULL").distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError("the word list is too long for every worker to hold; feat_dictionary joins it")
    return with_features(table(spark, d, "documents"), sample_bytes=WHOLE, wordlist=words).select("doc_id", *[_r4(n) for n in FEATURES], "line_count")


def tier1_classify(spark, d):
    c = rules.classify(table(spark, d, "documents"), sample_bytes=WHOLE)
    return c.select("doc_id", "classification.category", F.round(F.col("classification.confidence").cast("double"), 4).alias("confidence"))


def tier1_summary(spark, d):
    c = rules.classify(table(spark, d, "documents"), sample_bytes=WHOLE)
    return c.groupBy("lang", "classification.category", F.round(F.col("classification.confidence").cast("double"), 4).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def filter_categories(spark, d):
    e = table(spark, d, "eval_samples").select("sample_id", F.col("text").alias("bodytext"), F.col("prompt_template").alias("summarytext"))
    return field_categories(route(e, ("bodytext", "summarytext"), sample_bytes=WHOLE))


def _eval(spark, d):
    """eval_samples with clean labels: truth, and the category of the sub-type as prediction."""
    e = table(spark, d, "eval_samples")
    return e.withColumns({"truth": clean_name("expected_category"), "sub": clean_name("sub_type")}).withColumn("pred", F.when(F.col("sub").isNotNull(), labels.category_of(F.col("sub"))))


def metric_accuracy(spark, d):
    return metrics.accuracy(_eval(spark, d), "truth", "pred").select("total", "correct", F.round("accuracy", 6).alias("accuracy"))


def confusion_matrix(spark, d):
    return metrics.confusion(_eval(spark, d), "truth", "pred")


def per_category_metrics(spark, d):
    m = metrics.per_category(_eval(spark, d), "truth", "pred")
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def slice_grouping(spark, d):
    r = metrics.slice_report(_eval(spark, d), ["sub", "boundary_pair", "length_bucket", "split"], "truth", "pred")
    return r.select("field", "value", "total", "correct", F.round("accuracy", 6).alias("accuracy"))


def top_confusions(spark, d):
    return metrics.top_confusions(_eval(spark, d), "truth", "pred", "sample_id", "length_bucket")


def diversity_report(spark, d):
    return metrics.diversity(_eval(spark, d).drop("sub_type").withColumnRenamed("sub", "sub_type")).select("sub_type", "n", "temperatures", "templates", "domains", F.concat_ws(",", "buckets").alias("buckets"))


def diversity_warnings(spark, d):
    w = metrics.diversity_warnings(_eval(spark, d).drop("sub_type").withColumnRenamed("sub", "sub_type"), most=0.10)
    return w.select("sub_type", "model", "n", F.round("share", 6).alias("share"))


FLAGS = ["python", "sql", "shell", "markdown", "yaml"]


def _flags(spark, d):
    """golden rows with det_* (label says so) and pred_* (heuristic says so)."""
    g = table(spark, d, "golden_train").select("row_id", "text", clean_name("sub_type").alias("sub_type"), "source")
    text = F.coalesce("text", F.lit(""))
    return g.withColumns({f"det_{x}": F.coalesce((F.col("sub_type") == x).cast("int"), F.lit(0)) for x in FLAGS} | {f"pred_{x}": F.coalesce(validators.HEURISTICS[x](text).cast("int"), F.lit(0)) for x in FLAGS})


def detection_metrics(spark, d):
    m = metrics.detection_metrics(_flags(spark, d), FLAGS, "det_", "pred_")
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support", F.round("macro_f1", 6).alias("macro_f1"), F.round("hamming_loss", 6).alias("hamming_loss"))


def fire_stats(spark, d):
    s = metrics.fire_stats(_flags(spark, d), FLAGS, prefix="pred_")
    return s.select("label", "total_fires", "self_match", "cross_fire", F.round("fire_rate", 6).alias("fire_rate"), F.round("cross_fire_ratio", 6).alias("cross_fire_ratio"))


def label_cooccurrence(spark, d):
    return metrics.cooccurrence(_flags(spark, d), FLAGS, "pred_")


def sub_type_detections(spark, d):
    return metrics.sub_type_detections(_flags(spark, d), FLAGS, 3, "pred_")


def heuristic_audit(spark, d):
    """Share of texts that look like their label, per sub-type; all heuristics, JSON and quoted CSV included."""
    g = table(spark, d, "golden_train").where(F.col("text").isNotNull()).select("text", clean_name("sub_type").alias("sub_type"))
    return g.withColumn("ok", validators.plausible(F.col("text"), F.col("sub_type"))).groupBy("sub_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("pass_rate"))


def heuristic_flags(spark, d):
    names = [n for n in validators.HEURISTICS if n not in ("csv", "tsv", "json", "jsonl", "fixed_width")]
    text = F.coalesce("text", F.lit(""))
    g = table(spark, d, "golden_train").select("row_id", *[validators.HEURISTICS[n](text).alias(f"is_{n}") for n in names])
    return g.select("row_id", *[F.coalesce(F.col(f"is_{n}"), F.lit(False)).alias(f"is_{n}") for n in names])


def validate_json(spark, d):
    g = table(spark, d, "golden_train").where(F.col("text").isNotNull())
    return g.select("row_id", validators.is_json(F.col("text")).alias("is_json"), validators.is_jsonl(F.col("text")).alias("is_jsonl"))


def sample_filters(spark, d):
    g = table(spark, d, "golden_train")
    t = F.col("text")
    return g.select("row_id", filters.size_ok(t).alias("size_ok"), filters.length_ok(t).alias("length_ok"), filters.length_bucket(t).alias("bucket"), is_blank(t).alias("blank"))


def sample_schema(spark, d):
    e = table(spark, d, "eval_samples")
    cats = ["prose", "code", "structured", "artifact"]
    return e.select("sample_id", filters.sample_ok(F.col("text"), F.col("expected_category"), F.col("boundary_pair"), cats).alias("sample_ok"), filters.provenance_ok().alias("provenance_ok"))


def drop_synthetic(spark, d):
    kept, archived = filters.split_synthetic(table(spark, d, "golden_train").withColumn("source", clean_name("source")))
    count = lambda df, name: df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    return count(kept, "kept").unionByName(count(archived, "archived"))


def stratified_round_robin(spark, d):
    return sampling.stratified(_eval(spark, d).where("truth IS NOT NULL"), "truth", 25, "sample_id").select("sample_id", "truth")


def cap_two_level(spark, d):
    g = table(spark, d, "golden_train").select("row_id", clean_name("category").alias("cat"), clean_name("sub_type").alias("sub"))
    return sampling.capped(g, [("cat", 400), ("sub", 60)], "row_id")


def floor_allocation(spark, d):
    g = table(spark, d, "golden_train").select(clean_name("sub_type").alias("sub"))
    return sampling.floor_allocation(g.groupBy("sub").agg(F.count(F.lit(1)).alias("n_rows")), "sub", 600, 15)


def stratified_floor_sample(spark, d):
    g = table(spark, d, "golden_train").select("row_id", clean_name("sub_type").alias("sub"))
    return sampling.stratified_with_floor(g, "sub", 600, "row_id", 15)


def equal_share_sample(spark, d):
    g = table(spark, d, "golden_train").select("row_id", clean_name("sub_type").alias("sub"))
    return sampling.equal_shares(g, "sub", 500, "row_id")


def injected_logs(spark, d):
    return sampling.injected(table(spark, d, "golden_train").select("row_id", "text"), "log_content", 40, "row_id").select("row_id", "audit_source")


def train_validation(spark, d):
    g = table(spark, d, "golden_train").select("row_id", clean_name("category").alias("cat"))
    return sampling.train_validation(g, "cat", "row_id").select("row_id", "split")


def tiered_decide(spark, d):
    v = table(spark, d, "voting_log")
    x = voting.tiered_decision(F.col("tier1_agrees"), F.col("tier2_agrees"), clean_name("new_sub_type"))
    return v.select("vote_id", x["action"].alias("action"), x["new_sub_type"].alias("new_label"))


def vote_three(spark, d):
    v = table(spark, d, "voting_log")
    x = voting.vote3(clean_name("original_sub_type"), clean_name("sub_type"), clean_name("new_sub_type"))
    return v.select("vote_id", x["label"].alias("label"), x["method"].alias("method"))


def vote_four(spark, d):
    v = table(spark, d, "voting_log")
    x = voting.vote4(clean_name("original_sub_type"), clean_name("sub_type"), clean_name("new_sub_type"), F.coalesce(clean_name("sub_type"), F.lit("unknown")))
    return v.select("vote_id", x["verdict"].alias("verdict"), x["winner"].alias("winner"))


def verdicts(spark, d):
    v = table(spark, d, "voting_log").select("vote_id", labels.category_of(clean_name("original_sub_type")).alias("a"), labels.category_of(clean_name("sub_type")).alias("b"), labels.category_of(clean_name("new_sub_type")).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return v.select("vote_id", voting.error_verdict(a, b, c).alias("error"), voting.label_verdict(a, b, c).alias("label"), voting.detector_verdict(a, b, c).alias("detector"))


def escalation_rates(spark, d):
    v = table(spark, d, "voting_log").select(clean_name("original_sub_type").alias("sub_type"), "tier1_agrees")
    return metrics.escalation(v).select("sub_type", "n", F.round("agreement_rate", 6).alias("agreement_rate"), F.round("escalation_rate", 6).alias("escalation_rate"))


def annotator_agreement(spark, d):
    """Agreement per label over the flags each vote implies: does it keep the label?"""
    v = table(spark, d, "voting_log").select("row_id", clean_name("annotator").alias("annotator"), clean_name("original_sub_type").alias("label"), F.col("tier1_agrees").cast("int").alias("flag")).distinct()
    m = metrics.annotator_agreement(v, "row_id", "label", "flag")
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("mean_agreement", "unanimous_rate", "split_rate")])


def apply_relabels(spark, d):
    """golden rows after the last relabel of each is applied."""
    v = table(spark, d, "voting_log").where("action = 'relabel' AND new_sub_type IS NOT NULL")
    last = v.groupBy("row_id").agg(F.max_by(clean_name("new_sub_type"), F.struct("voted_at", "received_at", "vote_id")).alias("corrected"))
    g = table(spark, d, "golden_train").select("row_id", clean_name("sub_type").alias("sub"))
    return voting.apply_corrections(g, last, "row_id", "sub")


def resume_pending(spark, d):
    return voting.pending(table(spark, d, "golden_train").select("row_id"), table(spark, d, "voting_log").select("row_id").distinct(), "row_id")


def detector_crosscheck(spark, d):
    return metrics.detector_summary(_eval(spark, d).where("truth IS NOT NULL AND pred IS NOT NULL").withColumn("det", labels.category_of(F.col("boundary_pair"))), "truth", "pred", "det")


def class_weights(spark, d):
    w = metrics.class_weights(table(spark, d, "golden_train").select(clean_name("sub_type").alias("sub_type")), "sub_type")
    return w.select("sub_type", "n", F.round("weight", 6).alias("weight"))


def feature_moments(spark, d):
    cols = ["alpha_ratio", "sentence_punctuation_rate", "dictionary_word_ratio", "line_count"]
    f = table(spark, d, "feature_vector").where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in cols[:3]))
    m = metrics.feature_moments(f, cols)
    return m.select("feature", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


def plan_summary(spark, d):
    return metrics.plan_summary(table(spark, d, "source_plan"))


def nearest_cosine(spark, d):
    n = dedup.nearest(table(spark, d, "embeddings"), "vec_id", "embedding")
    return n.select(F.col("id").alias("vec_id"), "nn", F.round("d", 4).alias("distance"))


def cosine_dedup(spark, d):
    return dedup.vector_dedup(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3).select("vec_id")


def marginalised_scores(spark, d):
    """Softmax over eight made-up sub-type scores of each vector, summed by category."""
    subs = ["plain", "markdown", "python", "sql", "shell", "csv", "json", "yaml"]
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("x"))
    m = scoring.marginalised(scoring.softmax(F.col("x")), subs)
    e = e.withColumn("m", m).withColumn("top", F.get(scoring.scored(scoring.softmax(F.col("x")), subs), F.lit(0)))
    return e.select("vec_id", F.col("m.category").alias("category"), F.round("m.probability", 6).alias("probability"), F.col("top.sub_type").alias("sub_type"), F.round("top.score", 6).alias("score"))


def json_path(spark, d):
    from prosewright.sources.documents import json_text

    e = table(spark, d, "events").select("event_id", F.parse_json("props").alias("doc"), "props")
    return e.select("event_id", json_text(F.col("doc"), "k").alias("as_text"), F.try_variant_get("doc", "$.k", "double").alias("as_number"))


def reply_labels(spark, d):
    e = table(spark, d, "eval_samples")
    r = F.concat(F.lit("I would say: "), F.coalesce("sub_type", F.lit("none")), F.lit("."))
    return e.select("sample_id", parsing.reply_sub_type(r).alias("sub_type"), parsing.reply_category(F.col("boundary_pair")).alias("category"), labels.canonical_sub_type(clean_name("sub_type")).alias("canonical"))


def heuristic_votes(spark, d):
    return table(spark, d, "golden_train").select("row_id", parsing.heuristic_vote(F.col("text")).alias("vote"))


def source_counts(spark, d):
    return table(spark, d, "golden_train").groupBy(clean_name("source").alias("source"), clean_name("category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def generated_documents(spark, d):
    """Twenty documents of every kind, classified by the rules."""
    out = None
    for kind in generators.KINDS:
        g = generators.generate(spark, kind, 20)
        out = g if out is None else out.unionByName(g)
    return rules.classify(out, sample_bytes=WHOLE).select("id", "source", "sub_type", "classification.category")


def stream_categories(spark, d):
    """Documents read as a stream, classified, and counted by week of fetching."""
    import uuid

    from prosewright.streaming.classify import windowed_categories

    path, name = f"{d}/documents.parquet", f"stream_{uuid.uuid4().hex}"
    # a stream reads folders or patterns: a table of one file is named by a pattern that only it fits
    source = path if _is_folder(spark, path) else f"{d}/[d]ocuments.parquet"
    stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(source)
    # times without a zone are read as UTC, whatever the session's zone
    stream = stream.select("doc_id", "text", F.concat(F.col("fetched_at").cast("string"), F.lit("Z")).cast("timestamp").alias("fetched_at"))
    q = windowed_categories(stream, "fetched_at", "7 days", sample_bytes=WHOLE).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_from_unix_date(F.floor(F.col("window.start").cast("long") / 86400).cast("int")).cast("string").alias("start"), "category", "n")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


_QUERIES = [
    feat_entropy, feat_ngrams, feat_runs, feat_json_lines, feat_dictionary, features_all, tier1_classify, tier1_summary, filter_categories, metric_accuracy, confusion_matrix, per_category_metrics, slice_grouping, top_confusions,
    diversity_report, diversity_warnings, detection_metrics, fire_stats, label_cooccurrence, sub_type_detections, heuristic_audit, heuristic_flags, validate_json, sample_filters, sample_schema, drop_synthetic,
    stratified_round_robin, cap_two_level, floor_allocation, stratified_floor_sample, equal_share_sample, injected_logs, train_validation, tiered_decide, vote_three, vote_four, verdicts, escalation_rates, annotator_agreement, apply_relabels,
    resume_pending, detector_crosscheck, class_weights, feature_moments, plan_summary, nearest_cosine, cosine_dedup, marginalised_scores, json_path, reply_labels, heuristic_votes, source_counts, generated_documents, stream_categories,
]


def queries():
    from prosewright.plans import more

    return {"feat_chars": _features(CHARS), "feat_lines": _features(LINES), "feat_shapes": _features(SHAPES)} | {f.__name__: f for f in _QUERIES} | more.queries()


def oracle_sql():
    from prosewright.plans.more_sql import SQL as more
    from prosewright.plans.oracle import SQL

    return SQL | more
