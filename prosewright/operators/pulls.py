"""Running a source plan: from frames of documents, as many usable rows of each source as the plan asks for, and what is short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.operators.ranking import binned_rank, hex_bin
from prosewright.operators.sampling import hash_order


def planned(plan: DataFrame, name: str = "name", target: str = "target_count") -> DataFrame:
    """(name, target) of the distinct plan entries; a null target is 0, null names are left out. A small table of settings."""
    p = plan.distinct().where(F.col(name).isNotNull())
    return p.groupBy(F.col(name).alias("name")).agg(F.sum(F.greatest(F.coalesce(target, F.lit(0)), F.lit(0))).alias("target"))


def pulled(df: DataFrame, plan: DataFrame, source: str, id_col: str, usable: Column | None = None, seed: int = 42) -> DataFrame:
    """df's usable rows of planned sources, in hashed order as many as each source's target. plan: of `planned`."""
    d = df if usable is None else df.where(F.coalesce(usable, F.lit(False)))
    d = d.join(F.broadcast(plan.select(F.col("name").alias("_name"), "target")), F.col(source) == F.col("_name"))
    h = hash_order(id_col, seed)
    return binned_rank(d, ["_name"], hex_bin(h), [h, F.col(id_col)], "_place").where(F.col("_place") <= F.col("target")).select(*df.columns)


def shortfall(got: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """(name, target, taken, missing): every planned source, also those nothing came from."""
    n = got.groupBy(F.col(source).alias("name")).agg(F.count(F.lit(1)).alias("taken"))
    r = plan.join(n, "name", "left").fillna(0, ["taken"])
    return r.select("name", "target", "taken", (F.col("target") - F.col("taken")).alias("missing"))
