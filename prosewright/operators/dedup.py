"""Deduplication by nearest neighbour, and the routine that decides which of two neighbours goes.

Row i's neighbour nn(i) is the other row at the least distance d(i), ties to the lesser index. Rows are visited in order;
one still kept whose d(i) is under the threshold drops the later of i and nn(i). In parallel form: a row with d < t and
nn before it always goes; any other goes if a kept earlier row with d < t names it as neighbour. So only rows under the
threshold matter, and what is left to decide is followed link by link in joined tables.

Neighbours are exact: the vectors are compared in blocks, and every two blocks of rows meet once, for both sides. That is
the query itself and quadratic; `candidates` restricts it to the pairs an index gives, as an approximate mode.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.session import cut


def nearest(df: DataFrame, id_col: str, vector: str, metric: str = "cosine", block: int = 2048, candidates: DataFrame | None = None) -> DataFrame:
    """(id, nn, d): nearest other row by cosine distance or squared Euclidean distance. Null vectors and vectors of another length than the one of the least id are left out; fewer than two rows give none.

    Blocks of `block` rows are paired up; each task holds two of them. candidates: pairs (a, b) of ids, in either order;
    only these are compared, and rows in none have no neighbour.
    """
    v = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    n, size = v.agg(F.count(F.lit(1)), F.min_by(F.size("x"), "id")).first()
    v = v.where(F.size("x") == F.lit(size or 0))
    if candidates is not None:
        pair = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        j = pair.join(v.select(F.col("id").alias("a"), F.col("x").alias("p")), "a").join(v.select(F.col("id").alias("b"), F.col("x").alias("q")), "b")
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda acc, z: acc + z)
        p, q = F.col("p"), F.col("q")
        if metric == "cosine":
            d = 1 - dot(p, q) / (F.greatest(F.sqrt(dot(p, p)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(q, q)), F.lit(1e-12)))
        else:
            d = F.aggregate(F.zip_with(p, q, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda acc, z: acc + z)
        j = j.select("a", "b", d.alias("d"))
        return _best(j.select(F.col("a").alias("id"), F.col("b").alias("nn"), "d").unionByName(j.select(F.col("b").alias("id"), F.col("a").alias("nn"), "d")))
    blocks = max(1, -(-n // block))
    v = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = v.withColumn("o", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1)))).select("b", "o", "id", "x")
    right = v.where("b > 0").withColumn("o", F.col("b")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("b", "o", "id", "x")

    def compare(both: pd.DataFrame) -> pd.DataFrame:
        a, b = both[both["side"] == 0], both[both["side"] == 1]
        one = (both["b"] == both["o"]).all()
        b = a if one else b
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "nn": [], "d": []})
        a, b = a.sort_values("id"), b.sort_values("id")
        p, q = np.array(a["x"].tolist()), np.array(b["x"].tolist())
        if metric == "cosine":
            p, q = p / np.maximum(1e-12, np.linalg.norm(p, axis=1, keepdims=True)), q / np.maximum(1e-12, np.linalg.norm(q, axis=1, keepdims=True))
            d = 1 - p @ q.T
        else:
            d = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * p @ q.T
        d[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = np.inf
        found = [_nearest_of(d, p, q, a["id"].to_numpy(), b["id"].to_numpy(), metric)]
        if not one:
            found.append(_nearest_of(d.T, q, p, b["id"].to_numpy(), a["id"].to_numpy(), metric))
        return pd.concat(found)

    sides = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return _best(sides.groupBy("b", "o").applyInPandas(compare, "id long, nn long, d double"))


def _nearest_of(d: np.ndarray, p: np.ndarray, q: np.ndarray, ids: np.ndarray, others: np.ndarray, metric: str) -> pd.DataFrame:
    """The nearest of q for each of p; both are in the order of their ids."""
    k = np.round(d, 9).argmin(axis=1)
    at = np.arange(len(k))
    found = np.isfinite(d[at, k])
    exact = d[at, k] if metric == "cosine" else ((p - q[k]) ** 2).sum(axis=1)  # the expanded form loses digits
    return pd.DataFrame({"id": ids, "nn": others[k], "d": exact})[found]


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min_by(F.struct("nn", "d"), F.struct(F.round("d", 9), "nn")).alias("x")).select("id", "x.nn", "x.d")


def dropped(neighbours: DataFrame, threshold: float, max_rounds: int = 1000) -> DataFrame:
    """(id): rows to drop, from (id, nn, d), strictly under the threshold. Chains that max_rounds don't decide are an error."""
    near = cut(neighbours.where(F.col("d") < threshold).select("id", "nn"))
    gone = near.where("nn < id").select("id")
    # a row that names a later one drops it if the row itself is kept: decide chains from their starts
    names = cut(near.where("nn > id").join(gone, "id", "left_anti"))
    gone = cut(gone)
    for _ in range(max_rounds):
        if names.isEmpty():
            break
        waiting = names.select(F.col("nn").alias("id")).distinct()
        sure = cut(names.join(waiting, "id", "left_anti"))  # named by none that is still undecided: kept
        out = cut(sure.select(F.col("nn").alias("id")).distinct())
        gone = cut(gone.unionByName(out).distinct())
        names = cut(names.join(sure.select("id"), "id", "left_anti").join(out, "id", "left_anti"))
    if not names.isEmpty():
        raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
    return gone


def feature_dedup(df: DataFrame, id_col: str, features: list[str], threshold: float = 0.1) -> DataFrame:
    """df without rows whose feature vector is nearer (squared Euclidean) than the threshold to an earlier kept one. A threshold of 0 or less does nothing."""
    if threshold <= 0:
        return df
    v = df.withColumn("_v", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))
    gone = dropped(nearest(v, id_col, "_v", "squared"), threshold)
    return df.join(gone.withColumnRenamed("id", "_gone"), F.col(id_col) == F.col("_gone"), "left_anti")


def vector_dedup(df: DataFrame, id_col: str, vector: str, similarity: float = 0.95) -> DataFrame:
    """df without rows whose vector is more similar (cosine) than `similarity` to an earlier kept one."""
    gone = dropped(nearest(df, id_col, vector, "cosine"), 1 - similarity)
    return df.join(gone.withColumnRenamed("id", "_gone"), F.col(id_col) == F.col("_gone"), "left_anti")
