"""Deterministic sampling and splitting. Order is by md5 of seed and id, so results do not depend on partitions.

Places within a group are counted by bins (operators.ranking), so no group, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.operators.ranking import binned_rank, hex_bin, salted_join
from prosewright.operators.subsets import closest_counts
from prosewright.session import cut

#: Places of one (group, model) pair that stratified orders together.
PLACES = 4096


def hash_order(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _ranked(df: DataFrame, group: list[str], id_col: str, seed: int, name: str) -> DataFrame:
    """df plus each row's place in its group, in hashed order."""
    h = hash_order(id_col, seed)
    return binned_rank(df, group, hex_bin(h), [h, F.col(id_col)], name)


def stratified(df: DataFrame, key: str, n: int, id_col: str, model: str | None = "model", seed: int = 42, remainder: bool = False) -> DataFrame:
    """n records a group, taken round-robin over models (a null model is one of its own); all of smaller groups. remainder: the others instead."""
    if model is None:
        d = _ranked(df, [key], id_col, seed, "_k")
    else:
        d = _ranked(df.withColumn("_m", F.coalesce(F.col(model), F.lit("__none__"))), [key, "_m"], id_col, seed, "_r")
        d = binned_rank(d, [key], F.floor(F.col("_r") / PLACES), [F.col("_r"), F.col("_m"), F.col(id_col)], "_k")
    return d.where(F.col("_k") > n if remainder else F.col("_k") <= n).select(*df.columns)


def capped(df: DataFrame, keys: list[tuple[str, int]], id_col: str, seed: int = 42) -> DataFrame:
    """At most so many records per value of each key, one cap after the other."""
    d = df
    for key, most in keys:
        d = _ranked(d, [key], id_col, seed, "_k").where(F.col("_k") <= most).drop("_k")
    return d


def floor_allocation(counts: DataFrame, key: str, n: int, least: int = 50) -> DataFrame:
    """(key, n_rows, alloc): every group its floor, the rest in proportion to what is left, truncated (so the sum may be under n). counts: (key, n_rows)."""
    w = Window.partitionBy(F.lit(1))  # one row per group
    c = counts.withColumn("_floor", F.least(F.lit(least), F.floor(F.lit(n) / F.greatest(F.count(F.lit(1)).over(w), F.lit(1)))))
    c = c.withColumn("_base", F.least(F.col("_floor"), F.col("n_rows")))
    c = c.withColumn("_left", F.col("n_rows") - F.col("_base")).withColumn("_budget", n - F.sum("_base").over(w)).withColumn("_all", F.sum("_left").over(w))
    extra = F.when((F.col("_budget") > 0) & (F.col("_all") > 0), F.floor(F.col("_budget") * F.col("_left") / F.nullif(F.col("_all"), F.lit(0)))).otherwise(0)
    return c.select(key, "n_rows", F.least(F.col("_base") + extra, F.col("n_rows")).cast("long").alias("alloc"))


def stratified_with_floor(df: DataFrame, key: str, n: int, id_col: str, least: int = 50, seed: int = 42) -> DataFrame:
    """About n records: at least `least` of each group (or all), the rest in proportion. Null is a group."""
    alloc = floor_allocation(df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")), key, n, least).select(F.col(key).alias("_g"), "alloc")
    d = _ranked(df, [key], id_col, seed, "_k")
    return d.join(F.broadcast(alloc), F.col(key).eqNullSafe(F.col("_g"))).where(F.col("_k") <= F.col("alloc")).select(*df.columns)


def equal_shares(df: DataFrame, key: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n records: an equal share of each group, topped up from the others in hashed order (anti-join on the id, not on the text)."""
    groups = df.select(key).distinct().count()
    share = max(1, n // max(1, groups))
    first = stratified(df, key, share, id_col, None, seed)
    got = first.count()
    if got >= n:
        return first
    rest = df.join(first.select(id_col), id_col, "left_anti").orderBy(hash_order(id_col, seed), id_col).limit(n - got)
    return first.unionByName(rest.select(*first.columns))


def uniform(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


# How phenomena show in a text.
INJECTION = {
    "stack_trace": [r"Traceback \(most recent call last\)", r"Exception in thread", r"goroutine \d+ \[", r"panicked at", r"\s+at [\w.$]+\(.*\.java:\d+\)", r"^\s+at \w+\.\w+\.\w+\(\) in .*\.cs:line \d+"],
    "diff_patch": [r"(?m)^@@ -\d+(,\d+)? \+\d+(,\d+)? @@", r"(?m)^diff --git a/"],
    "log_content": [r"\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b.*\d{4}-\d{2}-\d{2}", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}.*\b(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b", r"\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}"],
}


def injected(df: DataFrame, label: str, n: int, id_col: str, seed: int = 42, text: str = "text") -> DataFrame:
    """Up to n records that match a label's patterns, tagged inject_<label>."""
    hit = F.col(text).rlike("|".join(f"(?:{p})" for p in INJECTION[label]))
    return df.where(hit).withColumn("audit_source", F.lit(f"inject_{label}")).orderBy(hash_order(id_col, seed), id_col).limit(n)


def audit_sample(df: DataFrame, id_col: str, n: int = 5000, per_label: int = 50, seed: int = 42) -> DataFrame:
    """A stratified sample by sub-type plus injected rows for every semantic label."""
    out = stratified_with_floor(df, "sub_type", n, id_col, 50, seed).withColumn("audit_source", F.lit("stratified"))
    for label in INJECTION:
        out = out.unionByName(injected(df, label, per_label, id_col, seed), allowMissingColumns=True)
    return out


def first_passing(df: DataFrame, passes: Column, n: int, order: Column, skips_per_row: int | None = 50) -> DataFrame:
    """The first n records that pass, in order (null first), given up at the (n x skips_per_row)-th that does not; None: never given up.

    Two top-k selections; no global window. The order may be of any type that can be ordered: where to give up stays in the plan, as a
    table of one row.
    """
    d = df.withColumn("_o", F.struct(order)).withColumn("_pass", F.coalesce(passes, F.lit(False)))  # a struct compares null as it is sorted
    hits = d.where("_pass").orderBy("_o").limit(n)
    if skips_per_row is not None:
        most = max(n * skips_per_row, 1)
        skipped = d.where(~F.col("_pass")).orderBy("_o").select("_o").limit(most)
        edge = skipped.agg(F.when(F.count(F.lit(1)) >= most, F.max("_o")).alias("_edge"))
        hits = hits.crossJoin(F.broadcast(edge)).where(F.col("_edge").isNull() | (F.col("_o") < F.col("_edge"))).drop("_edge")
    return hits.drop("_o", "_pass")


def train_validation(df: DataFrame, label: str, id_col: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """df plus `split`: `fraction` of each label's records (rounded) is validation. Null is a label."""
    wanted = df.groupBy(F.col(label).alias("_l")).agg(F.round(F.count(F.lit(1)) * fraction).alias("_want"))
    d = salted_join(_ranked(df, [label], id_col, seed, "_k"), wanted.withColumnRenamed("_l", label), [label], [id_col])
    return d.select(*df.columns, F.when(F.col("_k") <= F.col("_want"), "validation").otherwise("train").alias("split"))


# How far the validation share of a grouped split may be off, at least and at most, and as a part of it.
GROUPED_OFF = (0.02, 0.05, 0.25)
#: Groups up to which the validation groups' table is sent to all tasks; beyond, rows and groups are shuffled to meet.
BROADCAST_GROUPS = 100_000


def grouped_split(df: DataFrame, group: str, label: str, fraction: float = 0.2, seed: int = 42) -> DataFrame | None:
    """df plus `split`, whole groups on one side: of all choices of groups, the total closest to `fraction` of the rows.

    Which totals can be made is decided on group sizes alone (a bitset of subset sums); among groups of one size those
    whose labels are mixed most like the whole table go to validation, then by hash. Null is no group and goes to train;
    None where there are fewer than two groups or the closest total is too far off. Only the table of sizes (at most
    about the square root of twice the rows) reaches the driver.
    """
    t = cut(df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")))
    sizes = t.groupBy("g").agg(F.sum("n").alias("size"))
    have = {r["size"]: r["k"] for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("k")).collect()}
    total, groups = sum(s * k for s, k in have.items()), sum(have.values())
    if groups < 2:
        return None
    (taken,) = closest_counts(have, [total * fraction])
    taken = {s: k for s, k in taken.items() if k}
    if not taken:
        taken = {min(have): 1}
    elif sum(taken.values()) == groups:
        taken[min(taken)] -= 1
    off = abs(sum(s * k for s, k in taken.items()) / total - fraction)
    least, most, part = GROUPED_OFF
    if off > max(least, min(most, fraction * part)):
        return None
    spark = df.sparkSession
    # how unlike the whole a group's labels are mixed: half the sum of |share in the group - share in all|, labels it lacks included
    share = t.groupBy(F.col("l").alias("l_")).agg((F.sum("n") / total).alias("all"))
    j = t.join(share, F.col("l").eqNullSafe(F.col("l_"))).join(sizes.withColumnRenamed("g", "g_"), F.col("g") == F.col("g_"))
    here = F.col("n") / F.col("size")
    unlike = j.groupBy("g", "size").agg(((F.sum(F.abs(here - F.col("all"))) + 1 - F.sum("all")) / 2).alias("unlike"))
    h = hash_order("g", seed)
    step = F.floor(F.col("unlike") * 255).cast("int")
    placed = binned_rank(unlike, ["size"], step * 4096 + hex_bin(h), [step, h, F.col("g")], "place")
    wanted = spark.createDataFrame([(s, k) for s, k in taken.items()], "size_ long, k long")
    chosen = placed.join(F.broadcast(wanted), F.col("size") == F.col("size_")).where("place <= k").select(F.col("g").alias("_g"), F.lit("validation").alias("split"))
    if sum(taken.values()) <= BROADCAST_GROUPS:
        d = df.join(F.broadcast(chosen), F.col(group) == F.col("_g"), "left").drop("_g")
    else:
        d = salted_join(df, chosen.withColumnRenamed("_g", group), [group], df.columns)
    return d.withColumn("split", F.coalesce("split", F.lit("train")))


def quota(total: int, parts: int) -> list[int]:
    """A total in equal parts, the remainder with the first."""
    base = total // parts
    return [base + total - base * parts, *[base] * (parts - 1)] if parts else []
