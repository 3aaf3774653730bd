"""Ranks and running totals within groups of any size.

A plain window over a hot group sends the whole group to one task. Here each group is first cut into hashed bins; bin
totals (a small table) give every bin its offset, and only the rows of one bin are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_order(seed: int, *ids: Column) -> Column:
    """A pseudorandom but repeatable 64-bit order of rows."""
    return F.xxhash64(F.lit(seed), *ids)


def running_total(df: DataFrame, group: list[str], id_col: str, weight: Column | None = None, seed: int = 7, bins: int = 64, name: str = "before") -> DataFrame:
    """Adds `name`: the summed weight of the group's rows that come before this one in hashed order (the rank from 0 when weight is None).

    bins should grow with the largest group (rows / 50,000, say). Rows with equal ids are ordered arbitrarily but each gets its own place.
    """
    w = F.lit(1).cast("long") if weight is None else F.coalesce(weight.cast("long"), F.lit(0).cast("long"))
    d = df.withColumn("_h", hashed_order(seed, F.col(id_col))).withColumn("_w", w)
    d = d.withColumn("_bin", F.pmod(F.shiftright("_h", 20), F.lit(bins)).cast("int"))
    totals = d.groupBy(*group, "_bin").agg(F.sum("_w").alias("_t"))
    off = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_bin").alias("_gbin"),
        F.coalesce(F.sum("_t").over(off), F.lit(0).cast("long")).alias("_off"),
    )
    inside = Window.partitionBy(*group, "_bin").orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0).cast("long")))
    on = F.col("_bin") == F.col("_gbin")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return d.join(totals, on).select(*df.columns, (F.col("_in") + F.col("_off")).alias(name))


def binned_rank(df: DataFrame, group: list[str], bin_: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds `name`: the row's place, from 1, in its group in the given order. Null is a group.

    bin_ must never fall along the order: bins are counted, every bin gets its offset, and only the rows of one bin are
    ordered together. Make bins so fine that one fits a task; the places don't depend on them.
    """
    d = df.withColumn("_bin", bin_)
    totals = d.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_t"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    totals = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bin").alias("_gbin"), F.coalesce(F.sum("_t").over(before), F.lit(0).cast("long")).alias("_off"))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_bin").orderBy(*order)))
    on = F.col("_bin").eqNullSafe(F.col("_gbin"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return d.join(totals, on).select(*df.columns, (F.col("_in") + F.col("_off")).alias(name))


def hex_bin(hash_: Column, digits: int = 3) -> Column:
    """The first digits of a hexadecimal hash as a number: 16 ** digits bins of about equal size, in the hash's order."""
    return F.conv(F.substring(hash_, 1, digits), 16, 10).cast("int")


def salted_join(df: DataFrame, table: DataFrame, on: list[str], vary: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """df joined with `table` on equal values (null equals null), where a value may hold a large part of df's rows.

    Each row of df goes to one of `salts` parts of its value, by its `vary` columns; table's rows (far fewer) go to all.
    """
    names = [f"_on{i}" for i in range(len(on))]
    t = table.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnsRenamed(dict(zip(on, names)))
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*vary), F.lit(salts)).cast("int"))
    match = F.col("_salt") == F.col("_salt_")
    for c, n in zip(on, names):
        match = match & F.col(c).eqNullSafe(F.col(n))
    return d.join(t, match, how).drop("_salt", "_salt_", *names)
