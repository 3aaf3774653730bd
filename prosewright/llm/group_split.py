"""Splits that keep related records together.

Two records are related when they share the template and, besides it, the model or the domain; relation passes on.
Record pairs are never formed. Every (template, model) and every (template, domain) is a key; records that agree in
both keys are one row of a pre-aggregated table, a key is named by the least record that has it, and components are
found over those names by hooking and shortcutting (operators.components). A key that a third of all rows share is a
single vertex.

Component sizes are then reduced to multiplicities (how many components have each size): their subset sums, held as
bits of one integer, give the totals closest to the wanted split sizes, and components of equal size are dealt out in
hashed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.operators.components import connected_components
from prosewright.operators.ranking import running_total, salted_join
from prosewright.operators.subsets import closest_counts
from prosewright.session import stored

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def key_text(c: Column) -> Column:
    """Letters and digits only, letter case ignored; null where none is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def model_text(c: Column) -> Column:
    """Only what stands after the last `/` and before the first `:` of a model's name."""
    return key_text(F.regexp_extract(F.regexp_replace(c, r"(?s)^.*/", ""), r"(?s)^[^:]*", 0))


def related_groups(df: DataFrame, id_col: str = "sample_id", template: str = "prompt_template", model: str = "model", domain: str = "content_domain") -> DataFrame:
    """(id, root): root is the least id of the record's group.

    Nulls and values without letters or digits relate nothing; such records are groups of their own. Null ids are left
    out, repeated ids count once, other columns are ignored.
    """
    keyed = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), key_text(F.col(template)).alias("t"), model_text(F.col(model)).alias("m"), key_text(F.col(domain)).alias("d")
    )
    keyed = keyed.select(
        "id",
        F.when(F.col("m").isNotNull() & F.col("t").isNotNull(), F.concat_ws("\x1f", F.lit("m"), "t", "m")).alias("km"),
        F.when(F.col("d").isNotNull() & F.col("t").isNotNull(), F.concat_ws("\x1f", F.lit("d"), "t", "d")).alias("kd"),
    )
    linked = stored(keyed.where("km IS NOT NULL OR kd IS NOT NULL").groupBy("km", "kd").agg(F.min("id").alias("least")), "keypairs")
    keys = linked.select(F.explode(F.array_compact(F.array("km", "kd"))).alias("k"), "least").groupBy("k").agg(F.min("least").alias("rep"))
    km, kd = keys.select(F.col("k").alias("km"), F.col("rep").alias("rm")), keys.select(F.col("k").alias("kd"), F.col("rep").alias("rd"))
    named = stored(
        linked.join(km, "km", "left").join(kd, "kd", "left").select("km", "kd", F.coalesce("rm", "rd").alias("v"), F.col("rm").alias("u"), F.col("rd").alias("w")), "keynames"
    )
    vertices = named.select(F.explode(F.array_compact(F.array("u", "w"))).alias("v"))
    labels = connected_components(named.select("u", F.col("w").alias("v")), vertices)
    roots = named.select("km", "kd", "v").join(labels, "v").select("km", "kd", "root")
    related = F.col("km").isNotNull() | F.col("kd").isNotNull()
    found = salted_join(keyed.where(related), roots, ["km", "kd"], ["id"]).select("id", "root")
    return found.unionByName(keyed.where(~related).select("id", F.col("id").alias("root"))).groupBy("id").agg(F.min("root").alias("root"))


def group_split(df: DataFrame, proportions: dict[str, float] | None = None, seed: int = 11, **columns: str) -> DataFrame:
    """(id, root, split): the records of a group always share a split.

    The first of `proportions` gets what the others leave. An empty table gives an empty result. Only the table of
    component sizes (at most about the square root of twice the rows) reaches the driver.
    """
    proportions = proportions or SPLITS
    names = list(proportions)
    members = stored(related_groups(df, **columns), "groups")
    parts = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    hist = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(s * n for s, n in hist.items())
    whole = sum(proportions.values()) or 1.0
    counts = closest_counts(hist, [total * proportions[n] / whole for n in names[1:]])
    spark = df.sparkSession
    rows, start = [], {}
    for name, taken in zip(names[1:], counts):
        for s, k in taken.items():
            a = start.get(s, 0)
            rows.append((s, a, a + k, name))
            start[s] = a + k
    plan = spark.createDataFrame(rows, "size_ long, lo long, hi long, split string")
    ranked = running_total(parts, ["size"], "root", seed=seed, bins=max(64, max(hist.values(), default=0) // 100_000), name="rank")
    dealt = ranked.join(plan, (F.col("size") == F.col("size_")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    split = dealt.select("root", F.coalesce("split", F.lit(names[0])).alias("split"))
    return members.join(split, "root").select("id", "root", "split")
