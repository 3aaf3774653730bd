"""Mixing sources to target weights.

Each source's records, in a pseudorandom order, are packed into blocks of fixed length. The output is cut into shards;
each shard draws, by its own seed, multinomial counts of blocks per source, its slots are numbered through per source,
and slot j of a source takes block perm(j mod blocks) of pass j div blocks, where perm is a keyed permutation of
0..blocks-1. Draws vary by chance: slots a source has drawn beyond what it needs for its wanted size go to sources that
drew too few, so that in the end every source has the slots it needs, or those of max_repeat passes where these are fewer.
Mix and blocks meet in a join on (source, block), so no source, however large, is held by one task. A source falls short
if the mix itself holds less of it than is wanted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from prosewright.functions.words import clean_name, is_blank, mix64, words_column
from prosewright.operators.ranking import running_total
from prosewright.session import cut


def distinct_plan(plan: DataFrame) -> DataFrame:
    """Plan entries once each, with clean names and shares of the summed target.

    Repeats (the same in every column) count once; entries of one name are summed, max_repeat is then the least given,
    and 1 for synthetic ones. Null names are left out; a null or negative target is 0; a null max_repeat is 1.
    """
    p = plan.distinct().where(F.col("name").isNotNull())
    p = p.groupBy(clean_name(F.col("name")).alias("name")).agg(
        F.sum(F.greatest(F.coalesce("target_count", F.lit(0)), F.lit(0))).cast("long").alias("target_count"),
        F.min(F.when(F.coalesce("synthetic", F.lit(False)), F.lit(1)).otherwise(F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(0)))).cast("int").alias("max_repeat"),
    )
    total = Window.partitionBy(F.lit(1))  # the plan is a small table of settings
    return p.withColumn("share", F.coalesce(F.try_divide(F.col("target_count"), F.sum("target_count").over(total)), F.lit(0.0)))


def usable_rows(df: DataFrame, plan: DataFrame, id_col: str = "row_id", weight: Column | None = None) -> DataFrame:
    """(id, name, w): rows with text whose clean source is a plan name."""
    rows = df.where(~is_blank(F.col("text"))).select(F.col(id_col).alias("id"), clean_name(F.col("source")).alias("name"), (F.lit(1).cast("long") if weight is None else weight.cast("long")).alias("w"))
    return rows.join(F.broadcast(plan.select("name")), "name")


def words_weight() -> Column:
    """Size of a record in words."""
    return F.size(words_column(F.col("text")))


def _totals(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Plan with each source's rows and units, the wanted units, and what it can give."""
    have = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("units"))
    t = plan.join(have, "name", "left").fillna(0, ["n_rows", "units"])
    everything = Window.partitionBy(F.lit(1))
    t = t.withColumn("wanted", F.sum("units").over(everything) * F.col("share"))
    return t.withColumn("capacity", F.col("units") * F.col("max_repeat"))


def _draws(seed: int, names: list[str], needs: list[int]):
    p = np.array(needs, float) / max(1, sum(needs))

    def draw(batches):
        for b in batches:
            out = {"shard": [], "name": [], "n": []}
            for shard, slots in zip(b.shard, b.slots):
                for name, n in zip(names, np.random.default_rng([seed, int(shard)]).multinomial(int(slots), p).tolist()):
                    if n:
                        out["shard"].append(shard), out["name"].append(name), out["n"].append(n)
            yield pd.DataFrame(out)

    return draw


def _needed(units: int, wanted: float, repeat: int, block: int) -> int:
    """Slots with which a source surely gives the wanted units, or all slots of `repeat` passes."""
    if not units or wanted <= 0:
        return 0
    blocks, passes = -(-units // block), int(wanted // units)
    if passes >= repeat:
        return repeat * blocks
    rest = wanted - passes * units
    last = 1 if units % block else 0  # the one block that is not full may come early
    return passes * blocks + (min(blocks, math.ceil(rest / block) + last) if rest > 0 else 0)


def _handed_on(missing: list[tuple[str, int, int]]):
    """Gives the spare slots, numbered through, to the sources that drew too few: (name, slots drawn, slots missing) each."""
    ends = np.cumsum([0, *(n for _, _, n in missing)])

    def give(batches):
        for b in batches:
            out = {"shard": [], "name": [], "n": [], "first": []}
            for shard, x, n in zip(b.shard, b.start, b.spare):
                while n > 0:
                    k = int(np.searchsorted(ends, x, side="right")) - 1
                    if k >= len(missing):
                        break
                    take = min(n, int(ends[k + 1]) - x)
                    out["shard"].append(shard), out["name"].append(missing[k][0]), out["n"].append(take), out["first"].append(missing[k][1] + x - int(ends[k]))
                    x, n = x + take, n - take
            yield pd.DataFrame(out)

    return give


def mix_slots(rows: DataFrame, plan: DataFrame, block: int = 16, shard_slots: int = 512, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(totals, slots): totals per source, and (shard, name, n, first): n slots of a shard are the source's slots first, first + 1, ...

    Each of a source's slots from 0 to what it needs is there once.
    """
    spark = rows.sparkSession
    t = [(*r, _needed(r["units"], r["wanted"], r["max_repeat"], block)) for r in _totals(rows, plan).collect()]  # one row per plan name
    totals = spark.createDataFrame(t, "name string, target_count long, max_repeat int, share double, n_rows long, units long, wanted double, capacity long, slots long")
    names, needs = [r[0] for r in t], [r[-1] for r in t]
    slots = sum(needs)
    shards = -(-slots // shard_slots)
    each = spark.range(shards).select(F.col("id").alias("shard"), F.least(F.lit(shard_slots), F.lit(slots) - F.col("id") * shard_slots).alias("slots"))
    drawn = cut(each.mapInPandas(_draws(seed, names, needs), "shard long, name string, n long"))
    got = {r["name"]: r["n"] for r in drawn.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    bins = max(64, shards // 50_000)
    d = running_total(drawn, ["name"], "shard", F.col("n"), seed, bins, "first").join(F.broadcast(totals.select("name", "slots")), "name")
    d = d.withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("first"))))
    kept = d.where("kept > 0").select("shard", "name", F.col("kept").alias("n"), "first")
    spare = d.where("n > kept").select("shard", F.concat_ws(":", F.col("shard").cast("string"), "name").alias("place"), (F.col("n") - F.col("kept")).alias("spare"))
    spare = running_total(spare, [], "place", F.col("spare"), seed, bins, "start")
    missing = [(name, got.get(name, 0), need - got.get(name, 0)) for name, need in zip(names, needs) if need > got.get(name, 0)]
    return totals, kept.unionByName(spare.select("shard", "start", "spare").mapInPandas(_handed_on(missing), "shard long, name string, n long, first long"))


def mix_report(rows: DataFrame, plan: DataFrame, block: int = 16, **kw) -> DataFrame:
    """Per plan name: units wanted and found in the mix, shares wanted and reached, and `short`: the mix holds less than is wanted."""
    totals, pieces = _mix(rows, plan, block, **kw)
    there = pieces.groupBy("name").agg(F.sum(F.col("to") - F.col("from")).alias("drawn_units"))
    r = totals.join(there, "name", "left").fillna(0, ["drawn_units"])
    all_ = Window.partitionBy(F.lit(1))  # one row per plan name
    r = r.withColumn("share_reached", F.coalesce(F.try_divide(F.col("drawn_units"), F.sum("drawn_units").over(all_)), F.lit(0.0)))
    return r.withColumn("short", F.col("drawn_units") < F.col("wanted"))


def pack_blocks(rows: DataFrame, block: int, seed: int = 5, bins: int = 64) -> DataFrame:
    """(name, block, id, from, to): which units of which record fill each block. Records of no size fill none."""
    d = running_total(rows.where("w > 0"), ["name"], "id", F.col("w"), seed, bins, "start")
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("w") - 1) / block))))
    return d.select(
        "name", F.col("block").cast("long"), "id",
        F.greatest(F.lit(0), F.col("block") * block - F.col("start")).cast("long").alias("from"),
        F.least(F.col("w"), (F.col("block") + 1) * block - F.col("start")).cast("long").alias("to"),
    )


def permute(j: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1, applied to j: a Feistel network over the least even number of bits
    that holds n, repeated for the values that land at n or beyond until all are below it."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, x, todo = np.empty(len(j), np.int64), j.astype(np.uint64), np.arange(len(j))
    size, key = n.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for i in range(rounds):
            left, right = right, left ^ (mix64(right + k + np.uint64(i * 0x9E3779B9 + 1)) & m)
        x = (left << h) | right
        done = x < size[todo]
        out[todo[done]] = x[done].astype(np.int64)
        todo, x = todo[~done], x[~done]
    return out


@F.pandas_udf(LongType())
def permuted(j: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(j.to_numpy(), n.to_numpy(), key.to_numpy()))


def _mix(rows: DataFrame, plan: DataFrame, block: int, seed: int = 5, bins: int = 64, **kw) -> tuple[DataFrame, DataFrame]:
    totals, slots = mix_slots(rows, plan, block, seed=seed, **kw)
    d = slots.join(F.broadcast(totals.select("name", "units")), "name")
    d = d.withColumn("blocks", F.ceil(F.col("units") / block))
    d = d.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    d = d.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    d = d.withColumn("block", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.xxhash64("name", "epoch", F.lit(seed))))
    d = d.select("shard", "slot", "name", "epoch", "block")
    most = totals.agg(F.max("n_rows")).first()[0] or 0
    pieces = d.join(pack_blocks(rows, block, seed, max(bins, most // 100_000)), ["name", "block"])
    return totals, pieces.select("shard", "slot", "name", "epoch", "block", "id", "from", "to")


def mix_sources(rows: DataFrame, plan: DataFrame, block: int = 16, seed: int = 5, **kw) -> DataFrame:
    """(shard, slot, name, epoch, block, id, from, to): the mix, record piece by record piece.

    `rows` (of usable_rows) are read twice; cut them from a long lineage first.
    """
    return _mix(rows, plan, block, seed, **kw)[1]
