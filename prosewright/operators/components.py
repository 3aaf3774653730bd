"""Connected components by hooking and shortcutting over a parent table.

Each round hooks every vertex to its least neighbour, doubles the pointers until all trees are flat (shortcutting), and
renames the edges by the new parents. Edges inside a part vanish, so the edge table shrinks from round to round. Nothing but a row
count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.session import cut


def _shortcut(parent: DataFrame, max_rounds: int) -> DataFrame:
    """Pointers doubled until each points at a root: as many steps as the logarithm of the deepest tree."""
    parent = cut(parent)
    for _ in range(max_rounds):
        above = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        jumped = cut(parent.join(above, "p", "left").select("x", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        if jumped.where("moved").isEmpty():
            return parent
        parent = jumped.select("x", "p")
    raise RuntimeError("pointers did not settle; raise max_rounds")


def connected_components(edges: DataFrame, vertices: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root): root is the least vertex of v's component.

    edges: (u, v) of an ordered type; vertices: (v). Null ends, loops, repeated edges and edges in either direction are
    harmless; an empty edge table leaves every vertex alone.
    """
    e = edges.select(F.col("u"), F.col("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = vertices.select("v").where("v IS NOT NULL").distinct().withColumn("root", F.col("v"))
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        # least neighbour of every vertex that has a lesser one: a forest, as pointers only go down
        parent = e.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("p"))
        parent = _shortcut(parent, max_rounds)
        pu, pv = parent.select(F.col("x").alias("u"), F.col("p").alias("pu")), parent.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        moved = (
            e.join(pu, "u", "left")
            .join(pv, "v", "left")
            .select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
            .where("a <> b")
        )
        e = cut(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        levels.append(parent)
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    for parent in levels:
        step = parent.select(F.col("x").alias("root"), F.col("p").alias("_p"))
        labels = labels.join(step, "root", "left").select("v", F.coalesce("_p", "root").alias("root"))
    return labels
