"""Queries of this package, by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm import consensus as cons
from prosewright.llm import cube, group_split, leakage, mix, near_dup, overlap, profiles, residue, token_ids
from prosewright.session import cut, cut_by, table


def _mix_inputs(spark, d, weight=None):
    plan = mix.distinct_plan(table(spark, d, "source_plan"))
    return cut(mix.usable_rows(table(spark, d, "golden_train"), plan, weight=weight)), plan


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.row_pairs(*near_dup.near_duplicates(table(spark, d, "golden_train")))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, d, "golden_train")).withColumnRenamed("id", "row_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_report(*_mix_inputs(spark, d)).where("short").select("name")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_report(*_mix_inputs(spark, d))


def p2_mix(spark: SparkSession, d: str) -> DataFrame:
    rows, plan = _mix_inputs(spark, d, mix.words_weight())
    return mix.mix_sources(rows, plan, block=1024)


def p2_slots(spark: SparkSession, d: str) -> DataFrame:
    """Filled slots of each source in the mix by words; none for sources that fill none."""
    return p2_mix(spark, d).groupBy("name").agg(F.count_distinct("slot").alias("slots"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    g = group_split.related_groups(table(spark, d, "eval_samples"))
    return g.where("root < id").select(F.col("root").alias("first_id"), F.col("id").alias("sample_id"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return group_split.group_split(table(spark, d, "eval_samples")).select(F.col("id").alias("sample_id"), "root", "split")


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Records of each split, and how many groups stand in more than one."""
    s = cut(p3_split(spark, d))
    torn = s.groupBy("root").agg(F.count_distinct("split").alias("k")).where("k > 1").count()
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("torn", F.lit(torn).cast("int"))


def _cube_inputs(spark, d):
    cells = cut(cube.plan_cells(table(spark, d, "source_plan")))
    rows = cut(cube.cell_rows(table(spark, d, "golden_train"), cells))
    return rows, cut(cube.cell_targets(rows, cells))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows, targets = _cube_inputs(spark, d)
    return cube.cube_report(cube.cube_sample(rows, targets), targets).where("short").select("category", "sub_type")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    rows, targets = _cube_inputs(spark, d)
    return cube.cube_report(cube.cube_sample(rows, targets), targets)


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    """Whether each cell's sampled rows are within 1 of what is expected of it."""
    r = p4_report(spark, d)
    return r.select("category", "sub_type", "n_rows", "target", "short", (F.abs("residual") < 1).alias("balanced"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    rows, targets = _cube_inputs(spark, d)
    return cube.cube_sample(rows, targets).withColumnRenamed("id", "row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_overlaps(table(spark, d, "eval_samples"), table(spark, d, "golden_train")).select("sample_id", "row_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    evals, train = table(spark, d, "eval_samples"), table(spark, d, "golden_train")
    return overlap.overlap_report(overlap.cross_split_overlaps(evals, train), evals, train)


def _consensus(spark, d):
    votes = cut_by(cons.last_votes(table(spark, d, "voting_log")), "row_id")
    trust, wrong = cons.trust(votes)
    return cons.consensus(votes, trust, votes.select("label").distinct().count(), wrong), trust


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    c, _ = _consensus(spark, d)
    return c.where("label <> coalesce(original, '')").select("row_id", F.col("label").alias("sub_type"))


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0]


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[1]


def _structure(spark, d, statistics=False):
    words = profiles.dictionary(table(spark, d, "wordlist"))
    fitted = profiles.fit_profiles(table(spark, d, "golden_train"), words)
    return profiles.structure(table(spark, d, "documents"), fitted, words, statistics=statistics)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    odd = _structure(spark, d).where("prose_share < 0.5").select(F.col("id").alias("doc_id"))
    return odd.join(p10_found(spark, d), "doc_id", "left_anti")


def p7_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profile and statistics of every document, also of null and blank ones."""
    return _structure(spark, d, statistics=True).withColumnRenamed("id", "doc_id")


def p7_stats(spark: SparkSession, d: str) -> DataFrame:
    """Basic counts of every document."""
    p = p7_profiles(spark, d)
    return p.select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("line_end_ratio", 6).alias("line_end_ratio"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids.encode_column(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "holdout_items")).select("item_id", "doc_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Also passages of which up to two characters differ."""
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "holdout_items"), edits=2, exact=False)


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents, and their longest passage."""
    items = table(spark, d, "holdout_items").select("item_id", "split", "content_domain")
    hits = leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "holdout_items"))
    return items.join(hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("n_words").alias("longest")), "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.template_residue(table(spark, d, "documents")).select(F.col("id").alias("doc_id"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("p") and k[1:2].isdigit()}


def _sql() -> dict[str, str]:
    from prosewright.llm.oracle import SQL as sql

    return dict(sql)


SQL = _sql()
