"""More of the core's queries: sources and sinks, parsing, scoring, voting and sampling operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.functions import labels
from prosewright.functions.features import with_features
from prosewright.functions.words import clean_name, is_blank
from prosewright.operators import filters, metrics, parsing, pulls, routing, rules, sampling, scoring, validators, voting
from prosewright.plans.catalogue import FLAGS, WHOLE, _eval, _flags
from prosewright.session import shared_path, table
from prosewright.sources import documents as docs

LICENCES = ["MIT", "LICENSE", "APACHE"]
SUBS = ["plain", "markdown", "python", "sql", "shell", "csv", "json", "yaml"]
DROP_SOURCES, PROSE_SOURCES = ["generate_sql_reports"], ["pull_pdf_forms"]


def _gold(spark, d):
    return table(spark, d, "golden_train").select("row_id", "text", clean_name("category").alias("category"), clean_name("sub_type").alias("sub_type"), clean_name("source").alias("source"), "model")


# sources and sinks: written to the shared folder and read again
def _lines(spark, d):
    return table(spark, d, "eval_samples").select(F.to_json(F.struct("sample_id", F.struct("text", "split").alias("doc"))).alias("value"))


def _fields(df: DataFrame) -> DataFrame:
    return df.select(F.try_variant_get("doc", "$.sample_id", "long").alias("sample_id"), docs.json_text(F.col("doc"), "doc.text").alias("text"), docs.json_text(F.col("doc"), "doc.split").alias("split"))


def json_lines_read(spark, d):
    path = shared_path(spark, "lines")
    _lines(spark, d).write.text(path)
    return _fields(docs.read_json_lines(spark, path))


def json_lines_gzip(spark, d):
    path = shared_path(spark, "lines")
    _lines(spark, d).write.option("compression", "gzip").text(path)
    return _fields(docs.read_json_lines(spark, path))


def json_lines_tolerant(spark, d):
    """Two folders read together; the second holds broken and blank lines too."""
    a, b = shared_path(spark, "lines"), shared_path(spark, "lines")
    _lines(spark, d).write.text(a)
    bad = spark.createDataFrame([("{",), ("",), ("no json",), ('{"sample_id": -1, "doc": {"text": "x", "split": null}}',)], "value string")
    _lines(spark, d).unionByName(bad).write.text(b)
    return _fields(docs.read_json_lines(spark, a, b, strict=False)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("least"))


def json_lines_classified(spark, d):
    """Documents with a field added; those without text keep their lines."""
    path, out = shared_path(spark, "lines"), shared_path(spark, "out")
    _lines(spark, d).write.text(path)
    j = docs.read_json_lines(spark, path).withColumn("text", docs.json_text(F.col("doc"), "doc.text"))
    added = docs.with_field(F.col("doc"), F.col("line"), "_size", F.struct(F.length("text").alias("chars")))
    docs.write_json_lines(j, F.when(F.col("text").isNull(), F.col("line")).otherwise(added), out)
    r = docs.read_json_lines(spark, out)
    return _fields(r).select("sample_id", "split").join(r.select(F.try_variant_get("doc", "$.sample_id", "long").alias("k"), F.try_variant_get("doc", "$._size.chars", "int").alias("chars")), F.col("sample_id") == F.col("k")).drop("k")


def csv_read(spark, d):
    """Quoted fields with line ends, delimiters and quotes in them; a null and an empty text are the same in CSV."""
    path = shared_path(spark, "csv")
    t = table(spark, d, "holdout_items").select("item_id", "text", "split")
    t.write.options(header=True, quote='"', escape='"').csv(path)
    return docs.read_csv(spark, path, t.schema)


def parquet_renamed(spark, d):
    path = shared_path(spark, "parquet")
    table(spark, d, "wordlist").write.parquet(path)
    return docs.read_parquet_as(spark, path, word="token", freq_rank="rank").select("token", "rank")


def first_available(spark, d):
    path = shared_path(spark, "parquet")
    table(spark, d, "wordlist").write.parquet(path)
    return docs.first_available(spark, [shared_path(spark, "nowhere"), path]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def parquet_appended(spark, d):
    """Rows with fewer columns appended to a table, then the table replaced by a part of itself."""
    path = shared_path(spark, "parquet")
    w = table(spark, d, "wordlist")
    w.write.parquet(path)
    docs.append_parquet(w.select("word", F.lit("xx").alias("lang")), path)
    docs.replace_parquet(spark.read.parquet(path).where("lang IN ('xx', 'de')"), path)
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("freq_rank").alias("ranked"))


def union_frames(spark, d):
    """Tables of different columns one below the other."""
    g = table(spark, d, "golden_train").select(F.col("row_id").alias("id"), clean_name("category").alias("label"))
    e = table(spark, d, "eval_samples").select(F.col("sample_id").alias("id"), "split")
    return docs.union_all(g, e).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def line_errors(spark, d):
    """Numbered lines of a JSON Lines file that aren't JSON or fail a test."""
    path = shared_path(spark, "lines")
    t = table(spark, d, "holdout_items").select("item_id", F.when(F.col("item_id") % 7 == 0, "{").otherwise(F.to_json(F.struct("item_id", "split"))).alias("value"))
    t.coalesce(1).sortWithinPartitions("item_id").select("value").write.text(path)
    return docs.file_errors(spark, path, F.try_variant_get("doc", "$.item_id", "long") % 5 != 0)


def feature_csv(spark, d):
    path = shared_path(spark, "csv")
    cols = ["alpha_ratio", "symbol_ratio"]
    f = table(spark, d, "feature_vector").where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in cols))
    docs.write_feature_csv(f, cols, path)
    return docs.read_csv(spark, path, "alpha_ratio double, symbol_ratio double").groupBy(F.round("alpha_ratio", 1).alias("alpha")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("symbol_ratio"), 4).alias("most"))


# filters and labels
def filter_route(spark, d):
    e = table(spark, d, "eval_samples").select("sample_id", F.col("text").alias("bodytext"), F.col("prompt_template").alias("summarytext"))
    r = routing.route(e, ("bodytext", "summarytext"), sample_bytes=WHOLE)
    return r.select("sample_id", "route", F.size("fields").alias("n_fields"))


def quality_filter(spark, d):
    g = table(spark, d, "golden_train")
    return g.select("row_id", filters.quality_ok(F.col("text")).alias("quality_ok"))


def content_filters(spark, d):
    """Licence words, boundary or clear, size, and the category after overrides."""
    g = _gold(spark, d)
    return g.select("row_id", filters.licence_ok(F.col("source"), F.col("text"), LICENCES).alias("licence_ok"), filters.override_category(F.col("category"), F.col("sub_type")).alias("category"), labels.detector_category(F.col("sub_type")).alias("detector"), labels.category_order(F.col("category")).alias("place"))


def clear_boundary(spark, d):
    clear, boundary = filters.clear_and_boundary(table(spark, d, "eval_samples"))
    return clear.select("sample_id", F.lit("clear").alias("side")).unionByName(boundary.select("sample_id", F.lit("boundary").alias("side")))


def label_columns(spark, d):
    """The first label there is, and the columns a prediction keeps."""
    e = table(spark, d, "eval_samples").withColumn("category", clean_name("sub_type"))
    return filters.prediction_record(e.withColumn("truth", filters.label_column(e)), F.col("truth")).select("source", "length_bucket", "predicted_category").groupBy("source", "length_bucket", "predicted_category").agg(F.count(F.lit(1)).alias("n"))


def reclassify_artifacts(spark, d):
    g = _gold(spark, d).where("category IN ('artifact', 'skip') AND text IS NOT NULL").select("row_id", "text")
    return filters.reclassify(g, wordlist=["the", "and", "of", "was"]).select("row_id", "reclassified")


def feature_divergence(spark, d):
    """Stored features against our own: the last stored row of each document; equal times go to the greater values."""
    cols = ["alpha_ratio", "sentence_punctuation_rate"]
    f = table(spark, d, "feature_vector").where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in cols))
    last = f.groupBy("doc_id").agg(F.max_by(F.struct(*cols), F.struct("featurized_at", *cols)).alias("x")).select("doc_id", *[F.col(f"x.{c}").alias(c) for c in cols])
    own = with_features(table(spark, d, "documents"), names=cols, sample_bytes=WHOLE, line_count=False).select("doc_id", *cols)
    m = metrics.divergence(own, last, "doc_id", cols)
    return m.select("feature", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def json_texts(spark, d):
    """Texts that are JSON, or lines of it; others are made of the log's fields."""
    v = table(spark, d, "voting_log").select("vote_id", F.to_json(F.struct("row_id", "action")).alias("j"))
    n = F.col("vote_id") % 4
    t = F.when(n == 0, F.col("j")).when(n == 1, F.concat("j", F.lit("\n\n "), "j", F.lit(" \n"))).when(n == 2, F.concat("j", F.lit("\n{"))).otherwise(F.substring("j", 2, 1000))
    return v.select("vote_id", validators.is_json(t).alias("is_json"), validators.is_jsonl(t).alias("is_jsonl"))


def delimited_texts(spark, d):
    """Texts that are delimited tables: quoted fields hold delimiters and line ends, and one line in five is short of a field."""
    w = table(spark, d, "wordlist").where("word IS NOT NULL AND lang IS NOT NULL").select("word", "lang").distinct()
    row = lambda c: F.concat(F.lit('"'), F.col("word"), F.lit(c), F.col("lang"), F.lit('\n"'), F.lit(c), F.col("lang"))
    short = F.length("word") % 5 == 0
    text = lambda c: F.concat(row(c), F.lit("\n"), F.when(short, F.lit("x")).otherwise(row(c)))
    return w.select("word", "lang", validators.is_csv(text(",")).alias("is_csv"), validators.is_tsv(text("\t")).alias("is_tsv"), validators.is_tsv(text(",")).alias("other"))


# scoring
def _scores(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("x"))


def standard_scores(spark, d):
    z = scoring.standardised(F.col("x"), [0.1, 0.0, -0.1], [2.0, 0.0, 0.5])
    return _scores(spark, d).select("vec_id", *[F.round(F.get(z, F.lit(i)), 6).alias(f"z{i}") for i in range(3)], scoring.argmax(F.col("x")).alias("top"), F.round(scoring.sigmoid(F.get("x", F.lit(0))), 6).alias("s0"))


def detections(spark, d):
    """Sub-types with a sigmoid of at least 0.55, by category."""
    rows = scoring.scored(F.transform("x", scoring.sigmoid), SUBS, 0.55)
    return _scores(spark, d).select("vec_id", F.explode(scoring.by_category(rows)).alias("category", "found")).select("vec_id", "category", F.posexplode("found").alias("place", "f")).select("vec_id", "category", "place", "f.sub_type", F.round("f.score", 6).alias("score"))


def score_filter(spark, d):
    """Of those, what scores at least 0.6."""
    rows = scoring.scored(F.transform("x", scoring.sigmoid), SUBS, 0.55)
    kept = scoring.at_least(scoring.by_category(rows), 0.6)
    return _scores(spark, d).select("vec_id", F.explode(kept).alias("category", "found")).select("vec_id", "category", F.size("found").alias("n"))


# parsing
def reply_flags(spark, d):
    """Flags from noisy replies: bare, fenced and wordy JSON."""
    v = table(spark, d, "voting_log").select("vote_id", "tier1_agrees", "tier2_agrees")
    body = F.to_json(F.struct(F.col("tier1_agrees").cast("int").alias("log_content"), F.col("tier2_agrees").cast("double").alias("stack_trace")))
    reply = F.when(F.col("vote_id") % 3 == 0, body).when(F.col("vote_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" as asked")))
    f = parsing.flags(reply, labels.SEMANTIC_LABELS)
    return v.select("vote_id", *[f[x].alias(x) for x in labels.SEMANTIC_LABELS])


def reply_arrays(spark, d):
    """JSON arrays in replies, also in prose, cut short, or a single object."""
    e = table(spark, d, "events").select("event_id", "props")
    n = F.col("event_id") % 4
    reply = F.when(n == 0, F.concat(F.lit("["), F.col("props"), F.lit(", "), F.col("props"), F.lit("]"))).when(n == 1, F.concat(F.lit("Sure: ["), F.col("props"), F.lit("] done"))).when(n == 2, F.concat(F.lit("["), F.col("props"), F.lit(", {\"cut\": "))).otherwise(F.lit("nothing"))
    return e.select("event_id", F.size(parsing.array_items(reply)).alias("items"))


def text_pieces(spark, d):
    """Previews, prompts and voter labels."""
    g = table(spark, d, "golden_train")
    return g.select("row_id", parsing.preview(F.col("text"), 40).alias("preview"), parsing.prompt("Label {label} of {n}: {label}", label=F.col("sub_type"), n=F.col("row_id")).alias("prompt"), parsing.canonical_vote(parsing.reply_voter_label(F.coalesce("category", F.lit("")))).alias("vote"))


# voting
def voted_labels(spark, d):
    """golden rows after the votes of the log's last word on each."""
    v = table(spark, d, "voting_log").groupBy("row_id").agg(F.max_by(F.when(F.col("action") == "drop", "drop").otherwise(clean_name("new_sub_type")), F.struct("voted_at", "received_at", "vote_id")).alias("label"))
    return voting.apply_voted(_gold(spark, d).drop("text"), v, "row_id").select("row_id", "category", "sub_type")


def bulk_relabels(spark, d):
    return voting.relabel_bulk(_gold(spark, d).drop("text"), DROP_SOURCES, PROSE_SOURCES).select("row_id", "category", "sub_type")


def flag_agreement(spark, d):
    """Does the flag of the row's own sub-type say so?"""
    f = _flags(spark, d)
    return f.select("row_id", voting.flag_agrees(f, labels=FLAGS, prefix="pred_").alias("agrees"))


def ghost_sub_types(spark, d):
    g = _gold(spark, d)
    return g.select("row_id", voting.real_sub_type(F.col("sub_type"), ["ocr_garbage", "pdf_dump"], F.col("category"), F.when(F.col("source").startswith("pull"), "text").otherwise("code")).alias("sub_type"))


def corrected_votes(spark, d):
    v = table(spark, d, "voting_log").select("vote_id", F.when(F.col("tier2_agrees"), "TIE").when(F.col("tier1_agrees"), "KEEP_LABEL").otherwise("FIX_LABEL").alias("verdict"))
    done, ties = voting.corrected_and_ties(v)
    return done.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).unionByName(ties.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")))


def last_corrections(spark, d):
    v = table(spark, d, "voting_log").select("row_id", "vote_id", F.when(F.col("tier1_agrees"), "KEEP").otherwise("CORRECT").alias("verdict"), clean_name("new_sub_type").alias("detector_category"))
    return voting.last_corrections(v.where("detector_category IS NOT NULL"), "row_id", "vote_id")


def disputed_labels(spark, d):
    e = _eval(spark, d).withColumn("score", F.coalesce("temperature", F.lit(0.0)))
    return voting.disputed(e.where("truth IS NOT NULL AND pred IS NOT NULL"), "truth", "pred", "score").select("sample_id")


def second_tier(spark, d):
    """Votes that go on, to whom, and both tiers side by side."""
    v = table(spark, d, "voting_log").select("vote_id", clean_name("original_sub_type").alias("sub_type"), "tier1_agrees", "tier2_agrees")
    routing_ = spark.createDataFrame([("python", "one"), ("sql", "two"), ("plain", "three")], "sub_type string, model string")
    up = voting.routed(voting.escalated(v, routing_), routing_.where("model <> 'three'"), "default")
    return voting.merge_tiers(v.select("vote_id"), up.select("vote_id", "annotator"), "vote_id")


# sampling
def stratified_rest(spark, d):
    e = _eval(spark, d).where("truth IS NOT NULL")
    return sampling.stratified(e, "truth", 25, "sample_id", remainder=True).select("sample_id", "truth")


def uniform_sample(spark, d):
    return sampling.uniform(table(spark, d, "golden_train").select("row_id"), 300, "row_id")


def first_passing(spark, d):
    """Of the whole table, however many rows are skipped; null ids last."""
    g = _gold(spark, d)
    return sampling.first_passing(g, (F.col("category") == "code") & ~is_blank(F.col("text")), 40, F.struct(F.col("row_id").isNull(), "row_id"), None).select("row_id")


def injected_samples(spark, d):
    g = table(spark, d, "golden_train").select("row_id", "text")
    return sampling.injected(g, "stack_trace", 40, "row_id").unionByName(sampling.injected(g, "diff_patch", 40, "row_id")).select("row_id", "audit_source")


def grouped_validation(spark, d):
    """Whole sources on one side; how far their rows are from a fifth is as little as any choice of sources allows."""
    g = _gold(spark, d).select("row_id", "source", "sub_type")
    s = sampling.grouped_split(g, "source", "sub_type")
    per = s.where("source IS NOT NULL").groupBy("source").agg(F.count_distinct("split").alias("sides"), F.count(F.lit(1)).alias("n"), F.max("split").alias("split"))
    return per.agg(F.max("sides").cast("int").alias("sides"), (F.abs(F.sum(F.when(F.col("split") == "validation", F.col("n"))) / F.sum("n") - 0.2) < 0.02).alias("close"))


def plan_pull(spark, d):
    """The source plan run over the training rows: what each source gives and what is missing."""
    p = pulls.planned(table(spark, d, "source_plan").withColumn("name", clean_name("name")))
    g = _gold(spark, d)
    return pulls.shortfall(pulls.pulled(g, p, "source", "row_id", ~is_blank(F.col("text"))), p, "source")


def plan_pull_rows(spark, d):
    p = pulls.planned(table(spark, d, "source_plan").withColumn("name", clean_name("name")).withColumn("target_count", F.floor(F.col("target_count") / 50)))
    return pulls.pulled(_gold(spark, d), p, "source", "row_id", ~is_blank(F.col("text"))).select("row_id", "source")


# metrics
def vote_tally(spark, d):
    v = table(spark, d, "voting_log")
    t = voting.tally(v.select(voting.vote3(clean_name("original_sub_type"), clean_name("sub_type"), clean_name("new_sub_type"))["method"].alias("method")), "method")
    return t.select("method", "n", F.round("share", 6).alias("share"))


def confusion_wide(spark, d):
    return metrics.confusion_table(_eval(spark, d).where("truth IN ('prose', 'code', 'structured')"), "truth", "pred", ["prose", "code", "structured"])


def aligned_tables(spark, d):
    """Three annotators' tables side by side, by record."""
    g = _gold(spark, d).where("sub_type IS NOT NULL")
    mine = {x: g.select("row_id", F.coalesce(validators.HEURISTICS[x](F.coalesce("text", F.lit(""))), F.lit(False)).alias("flag")) for x in ("python", "sql", "shell")}
    return metrics.aligned(mine, "row_id", ["flag"]).select("row_id", *[F.col(f"{x}.flag").alias(x) for x in mine])


def tier_counts(spark, d):
    c = rules.classify(table(spark, d, "documents"), sample_bytes=WHOLE)
    return c.groupBy("classification.tier", (F.col("classification.confidence") >= 0.9).alias("sure")).agg(F.count(F.lit(1)).alias("n"))


def _votes_of_flags(spark, d):
    """(row_id, annotator, audit_source, label, flag), as three annotators might have flagged the rows: tiers, and the label itself."""
    v = table(spark, d, "voting_log").groupBy("row_id").agg(F.max(F.col("tier1_agrees").cast("int")).alias("a"), F.max(F.col("tier2_agrees").cast("int")).alias("b"))
    names = labels.SEMANTIC_LABELS
    v = v.select("row_id", F.explode(F.array(*map(F.lit, names))).alias("label"), F.concat(F.lit("inject_"), F.get(F.array(*map(F.lit, names)), F.pmod("row_id", F.lit(3)).cast("int"))).alias("audit_source"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return v.select("row_id", "label", "audit_source", F.explode(F.array(F.struct(F.lit("x").alias("annotator"), F.col("a").alias("flag")), F.struct(F.lit("y").alias("annotator"), F.col("b").alias("flag")), F.struct(F.lit("z").alias("annotator"), F.lit(1).alias("flag")))).alias("f")).select("row_id", "label", "audit_source", "f.annotator", "f.flag")


def injected_recall(spark, d):
    return metrics.injected_recall(_votes_of_flags(spark, d), "row_id").select("label", F.round("recall", 6).alias("recall"))


def audit_gate(spark, d):
    v = _votes_of_flags(spark, d)
    return metrics.gate(metrics.annotator_agreement(v, "row_id", "label", "flag"), metrics.injected_recall(v, "row_id"), 0.6, 0.5)


def label_buckets(spark, d):
    stats = metrics.fire_stats(_flags(spark, d), FLAGS, prefix="pred_")
    agreement = metrics.annotator_agreement(_votes_of_flags(spark, d).withColumn("label", F.when(F.col("label") == "log_content", "python").when(F.col("label") == "diff_patch", "sql").otherwise("shell")), "row_id", "label", "flag")
    return metrics.label_buckets(stats, agreement).select("label", "weak", "strong", "low_agreement", "suspicious")


def heuristic_pass_rates(spark, d):
    """Share of texts that look like their label, for sub-types whose test is a plain pattern."""
    g = _gold(spark, d).where(F.col("text").isNotNull() & F.col("sub_type").isin("python", "sql", "shell", "yaml", "markdown", "pipe_table"))
    return g.withColumn("ok", validators.plausible(F.col("text"), F.col("sub_type"))).groupBy("sub_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"))


_QUERIES = [
    json_lines_read, json_lines_gzip, json_lines_tolerant, json_lines_classified, csv_read, parquet_renamed, first_available, parquet_appended, union_frames, line_errors, feature_csv, filter_route, quality_filter, content_filters, clear_boundary,
    label_columns, reclassify_artifacts, json_texts, delimited_texts, feature_divergence, standard_scores, detections, score_filter, reply_flags, reply_arrays, text_pieces, voted_labels, bulk_relabels, flag_agreement, ghost_sub_types, corrected_votes, last_corrections,
    disputed_labels, second_tier, stratified_rest, uniform_sample, first_passing, injected_samples, grouped_validation, plan_pull, plan_pull_rows, vote_tally, confusion_wide, aligned_tables, tier_counts, injected_recall, audit_gate, label_buckets, heuristic_pass_rates,
]


def queries():
    return {f.__name__: f for f in _QUERIES}
