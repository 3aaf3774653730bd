"""Samples matching target category proportions, by the cube method.

Every record gets an inclusion probability that makes its cell's expected count the target. With category indicators as
balancing variables, the directions that leave all cell counts unchanged are spanned by differences of two records of
one cell; a flight step moves two probabilities along such a direction until one of them is 0 or 1. Flights run inside
partitions and leave at most one open record per cell in each; the open ones are brought together into ever fewer
partitions and flown again, and the landing decides the last one of each cell by its remaining probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.words import clean_name, is_blank, mix64
from prosewright.session import cut

_ROWS = "id long, cell long, p double, state int"


def plan_cells(plan: DataFrame) -> DataFrame:
    """(category, sub_type, target_count, share) of the distinct plan entries; entries without a cell are left out."""
    p = plan.distinct().select(clean_name("category").alias("category"), clean_name("sub_type").alias("sub_type"), F.greatest(F.coalesce("target_count", F.lit(0)), F.lit(0)).alias("t"))
    p = p.where("category IS NOT NULL AND sub_type IS NOT NULL").groupBy("category", "sub_type").agg(F.sum("t").cast("long").alias("target_count"))
    everything = Window.partitionBy(F.lit(1))  # the plan is a small table of settings
    return p.withColumn("share", F.coalesce(F.try_divide(F.col("target_count"), F.sum("target_count").over(everything)), F.lit(0.0)))


def cell_rows(df: DataFrame, cells: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, category, sub_type): rows with text whose clean category and sub-type are a cell."""
    rows = df.where(~is_blank(F.col("text"))).select(F.col(id_col).alias("id"), clean_name("category").alias("category"), clean_name("sub_type").alias("sub_type"))
    return rows.join(F.broadcast(cells.select("category", "sub_type")), ["category", "sub_type"])


def cell_targets(rows: DataFrame, cells: DataFrame, fraction: float = 0.5, least: int = 10) -> DataFrame:
    """Cells, numbered, with their rows, targets and the inclusion probability of each row.

    The sample is to hold fraction x all usable rows. A cell with fewer rows than its target gives all; a cell whose target is under `least` gives that many, or all it has.
    """
    n = rows.groupBy("category", "sub_type").agg(F.count(F.lit(1)).alias("n_rows"))
    t = cells.join(n, ["category", "sub_type"], "left").fillna(0, ["n_rows"])
    everything = Window.partitionBy(F.lit(1))  # one row per plan cell
    t = t.withColumn("target", F.sum("n_rows").over(everything) * F.lit(fraction) * F.col("share"))
    t = t.withColumn("cell", F.row_number().over(everything.orderBy("category", "sub_type")).cast("long"))
    wanted = F.least(F.col("n_rows").cast("double"), F.greatest(F.col("target"), F.lit(float(least))))
    return t.withColumn("p", F.coalesce(F.try_divide(wanted, F.col("n_rows")), F.lit(0.0)))


def _step(seed: int, level: int, ids: np.ndarray, cells: np.ndarray, p: np.ndarray) -> int:
    """One flight step of all pairs of neighbouring open records of a cell: moves p in place and returns the number of pairs.

    The direction is drawn by a hash of seed, level and the two ids, so that it does not depend on batches.
    """
    order = np.argsort(cells, kind="stable")
    c = cells[order]
    begin = np.append(True, c[1:] != c[:-1])
    place = np.arange(len(c)) - np.maximum.accumulate(np.where(begin, np.arange(len(c)), 0))
    first = np.flatnonzero((place % 2 == 0) & np.append(c[1:] == c[:-1], False))
    i, j = order[first], order[first + 1]
    a, b = p[i], p[j]
    up, down = np.minimum(1 - a, b), np.minimum(a, 1 - b)
    drawn = mix64(mix64(ids[i].view(np.uint64) + np.uint64(seed * 64 + level)) ^ ids[j].view(np.uint64)) >> np.uint64(11)
    rise = drawn.astype(float) / (1 << 53) * (up + down) < down
    p[i], p[j] = np.where(rise, a + up, a - down), np.where(rise, b - up, b + down)
    return len(first)


def _fly(seed: int, level: int):
    def flight(batches):
        none = np.empty(0, np.int64)
        held = (none, none, none.astype(float))
        for b in batches:
            ids, cells, p = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate(held))
            p = p.copy()
            while True:
                open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
                now = p[open_]
                if not _step(seed, level, ids[open_], cells[open_], now):
                    break
                p[open_] = now
            decided = np.ones(len(p), bool)
            decided[open_] = False
            held = ids[open_], cells[open_], p[open_]
            yield _rows(ids[decided], cells[decided], p[decided], (p[decided] > 0.5).astype(np.int32))
        if len(held[0]):
            yield _rows(*held, np.full(len(held[0]), 2, np.int32))

    return flight


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "cell", "p", "state"])


def cube_sample(rows: DataFrame, targets: DataFrame, seed: int = 3, fan_in: int = 8) -> DataFrame:
    """(id, category, sub_type): the sampled rows. Rows of repeated ids are drawn one by one; an empty table gives an empty sample."""
    t = targets.select("category", "sub_type", "cell", "p")
    left = rows.join(F.broadcast(t), ["category", "sub_type"]).select(F.col("id").cast("long").alias("id"), "cell", "p").where("p > 0")
    parts, level, decided = max(1, left.rdd.getNumPartitions()), 0, []
    while True:
        flown = cut(left.mapInArrow(_fly(seed, level), _ROWS))
        decided.append(flown.where("state = 1").select("id", "cell"))
        left = flown.where("state = 2").select("id", "cell", "p")
        if parts == 1:
            break
        parts, level = -(-parts // fan_in), level + 1
        left = left.repartition(parts, "cell") if parts > 1 else left.coalesce(1)
    landing = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < F.col("p") * (1 << 20)
    decided.append(left.where(landing).select("id", "cell"))
    chosen = decided[0]
    for d in decided[1:]:
        chosen = chosen.unionByName(d)
    return chosen.join(F.broadcast(targets.select("category", "sub_type", "cell")), "cell").select("id", "category", "sub_type")


def cube_report(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """Per cell: rows, target, sampled rows, the residual (sampled less the expected count), and `short`: all its rows are in the sample, and fewer than the target."""
    got = sample.groupBy("category", "sub_type").agg(F.count(F.lit(1)).alias("sampled"))
    r = targets.join(got, ["category", "sub_type"], "left").fillna(0, ["sampled"])
    short = (F.col("sampled") >= F.col("n_rows")) & (F.col("sampled") < F.col("target"))
    return r.select("category", "sub_type", "n_rows", F.round("target", 6).alias("target"), "sampled", F.round(F.col("sampled") - F.col("p") * F.col("n_rows"), 6).alias("residual"), short.alias("short"))
