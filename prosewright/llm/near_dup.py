"""Near-duplicate records with small edits.

Similarity is that of word multisets: words in common, counted with repetition, divided by words in either. Each text
becomes a set of tokens (word, how many times seen so far), of which `SAMPLES` MinHash values are taken.

1. Bands of ROWS MinHash values name buckets. A text enters each of its BANDS buckets with its class id (a hash of its
   token set, so that copies are one entry however many there are), its word count and its odd sketch: the MinHash
   samples folded into a bitmap of parities. Entries travel in blocks, one row per (batch, target partition).
2. Inside a bucket, two classes stay candidates if their word counts allow the similarity and the population count of
   the XOR of their sketches does not speak against it. No text and no token leaves its row for that.
3. Candidates (few of them false) are verified exactly on the token sets.

The result is links between classes, and the class of each row; copies are never expanded into pairs here. LSH is
probabilistic: README gives the measured recall. Every bucket is compared whole. One with more than HOT entries (many
texts that differ, but hardly) is put aside by the task that meets it, then cut into blocks, and every pair of blocks is
a group of its own, so no task ever holds such a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.functions.words import WordCodes, bag_tokens, mix64, words
from prosewright.operators.components import connected_components
from prosewright.operators.ranking import salted_join
from prosewright.session import cut, stored

SAMPLES, ROWS, BANDS = 128, 5, 28
SKETCH_BITS = 256
#: XOR population count up to which a pair of sketches passes: more than two standard deviations above the mean at similarity 0.7.
MAX_POP = 76
PART_MB = 32
#: Entries from which a bucket is cut into blocks, and the memory a task fills before it looks for such buckets.
HOT, HELD_MB = 20_000, 96
#: Classes with candidates up to which their list is sent to all tasks (8 bytes each); beyond, it and the bags are shuffled to meet.
BROADCAST_CLASSES = 2_000_000


def _parameters(seed: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 62, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 62, SAMPLES, np.uint64)
    # bands are subsets of the samples, each sample used about equally often
    picks, pool = [], np.empty(0, np.int64)
    for _ in range(BANDS):
        while len(pool) < ROWS:
            pool = np.concatenate([pool, rng.permutation(SAMPLES)])
        picks.append(pool[:ROWS])
        pool = pool[ROWS:]
    return mul, add, picks


class Texts:
    """Token sets of a batch of texts with at least min_words words."""

    def __init__(self, batch: list[str | None], codes: WordCodes, min_words: int):
        flat: list[int] = []
        rows, starts = [], []
        for i, t in enumerate(batch):
            w = words(t)
            if len(w) >= min_words:
                rows.append(i), starts.append(len(flat))
                flat += codes.encode(w)
        self.rows = np.array(rows, np.int64)
        self.starts = np.array(starts, np.int64)
        self.codes = np.array(flat, np.uint32)
        self.tokens = bag_tokens(self.codes, self.starts)
        self.lengths = np.diff(np.append(self.starts, len(flat)))
        self.n = len(rows)

    def classes(self) -> np.ndarray:
        """A 64-bit hash of each token set."""
        if not self.n:
            return np.empty(0, np.int64)
        return mix64(np.add.reduceat(mix64(self.tokens), self.starts) + self.lengths.astype(np.uint64)).view(np.int64)


def sums_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of several stretches of these lengths begins."""
    return np.cumsum(lengths) - lengths


def minhashes(tokens: np.ndarray, starts: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """SAMPLES x texts, 32-bit values."""
    out = np.empty((SAMPLES, len(starts)), np.uint32)
    for k in range(SAMPLES):
        out[k] = np.minimum.reduceat(((tokens * mul[k] + add[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """texts x (SKETCH_BITS / 64): bit parities of the hashed (sample number, value) pairs."""
    k = np.arange(len(m), dtype=np.uint64)[:, None] << np.uint64(32)
    bit = (mix64(m.astype(np.uint64) + k) % np.uint64(SKETCH_BITS)).astype(np.int64)
    n = m.shape[1]
    flat = np.bincount((np.arange(n)[None, :] * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(flat.astype(bool), axis=1).view(np.uint64)


_ENTRY = np.dtype([("key", "<u8"), ("n", "<u2"), ("cls", "<i8"), ("sketch", "<u8", (SKETCH_BITS // 64,))])


def _batch_entries(b: pa.RecordBatch, parameters: tuple) -> np.ndarray | None:
    """All bucket entries of a batch of (class, bag)."""
    mul, add, picks = parameters
    cls, one = np.unique(b.column(0).to_numpy(), return_index=True)  # copies in one batch enter once
    if not len(one):
        return None
    bags = [b.column(1)[i].as_py() for i in one.tolist()]
    n = np.array([len(x) // 4 for x in bags], np.int64)
    m = minhashes(mix64(np.frombuffer(b"".join(bags), np.uint32).astype(np.uint64)), sums_of(n), mul, add)
    e = np.empty((BANDS, len(one)), _ENTRY)
    e["cls"], e["n"], e["sketch"] = cls, np.minimum(n, 65535), odd_sketches(m)  # longer ones are taken for equally long; the words decide
    for k, pick in enumerate(picks):
        h = np.full(len(one), np.uint64(k + 1))
        for r in pick:
            h = mix64(h ^ m[r].astype(np.uint64)) + np.uint64(r)
        e["key"][k] = h
    return e.ravel()


def _split(e: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Entries grouped by a number: the numbers, and the entries of each as bytes."""
    order = np.argsort(by, kind="stable")
    e, by = e[order], by[order]
    at = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    return by[at], [e[i:j].tobytes() for i, j in zip(at, np.append(at[1:], len(e)))]


def _entries(parts: int, seed: int):
    parameters = _parameters(seed)

    def run(batches):
        for b in batches:
            e = _batch_entries(b, parameters)
            if e is not None:
                part, blobs = _split(e, (e["key"] % np.uint64(parts)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "entries"])

    return run


def _hot_entries(hot, seed: int):
    """Entries of the buckets put aside only: (key, n, entries), one row per batch and bucket."""
    parameters = _parameters(seed)

    def run(batches):
        for b in batches:
            e = _batch_entries(b, parameters)
            if e is None:
                continue
            e = e[np.isin(e["key"], hot.value)]
            if len(e):
                key, blobs = _split(e, e["key"].astype(np.int64))
                n = [len(x) // _ENTRY.itemsize for x in blobs]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "n", "entries"])

    return run


def _bucket_pairs(e: np.ndarray, threshold: float, max_pop: int, step: int = 1 << 20):
    """Candidate pairs of the sorted entries of one partition, in blocks: arrays (a, b), a < b."""
    key = e["key"]
    if len(e) < 2:
        return
    new = np.append(True, key[1:] != key[:-1])
    run_end = np.append(np.flatnonzero(new)[1:], len(e))
    last = np.repeat(run_end, np.diff(np.append(np.flatnonzero(new), len(e)))) - 1  # last entry of each entry's bucket
    live, gap = np.arange(len(e)), 1
    while True:
        live = live[live + gap <= last[live]]
        if not len(live):
            return
        for s in range(0, len(live), step):
            i = live[s : s + step]
            j = i + gap
            small, big = np.minimum(e["n"][i], e["n"][j]), np.maximum(e["n"][i], e["n"][j])
            ok = (small >= threshold * big) & (e["cls"][i] != e["cls"][j])
            i, j = i[ok], j[ok]
            pop = np.bitwise_count(e["sketch"][i] ^ e["sketch"][j]).sum(axis=1, dtype=np.int64)
            ok = pop <= max_pop
            if ok.any():
                a, b = e["cls"][i[ok]], e["cls"][j[ok]]
                yield np.minimum(a, b), np.maximum(a, b)
        gap += 1


def _distinct(held: list[bytes]) -> np.ndarray:
    """Entries of several blobs, once each, by key."""
    e = np.unique(np.frombuffer(b"".join(held), np.dtype((np.void, _ENTRY.itemsize)))).view(_ENTRY)
    return e[np.argsort(e["key"], kind="stable")]


def _pair_batches(found):
    """Distinct pairs in record batches, from arrays of them."""
    pairs: list[np.ndarray] = []
    size = 0

    def batch(p):
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    for a, b in found:
        pairs.append(np.stack([a, b], axis=1))
        size += len(a)
        if size > 2_000_000:
            pairs = [np.unique(np.concatenate(pairs), axis=0)]
            size = len(pairs[0])
            if size > 1_000_000:
                yield batch(pairs[0])
                pairs, size = [], 0
    if pairs:
        yield batch(np.unique(np.concatenate(pairs), axis=0))


def _candidates(threshold: float, max_pop: int, hot: int, held_mb: float):
    """Pairs of one partition's buckets, and (key, null) for buckets too large to be held."""

    def run(batches):
        held: list[bytes] = []
        size, aside = 0, np.empty(0, np.uint64)

        def large(e):
            key, n = np.unique(e["key"], return_counts=True)
            return key[n > hot]

        for b in batches:
            for x in b.column(0):
                x = x.as_py()
                if len(aside):
                    e = np.frombuffer(x, _ENTRY)
                    x = e[~np.isin(e["key"], aside)].tobytes()
                held.append(x)
                size += len(x)
                if size > held_mb * 1e6:
                    e = _distinct(held)
                    aside = np.union1d(aside, large(e))
                    e = e[~np.isin(e["key"], aside)]
                    held, size = [e.tobytes()], 0  # what is left counts anew, so that this is not done for every blob
        if not held:
            return
        e = _distinct(held)
        held.clear()
        aside = np.union1d(aside, large(e))
        if len(aside):
            e = e[~np.isin(e["key"], aside)]
            yield pa.RecordBatch.from_arrays([pa.array(aside.astype(np.int64)), pa.nulls(len(aside), pa.int64())], names=["a", "b"])
        yield from _pair_batches(_bucket_pairs(e, threshold, max_pop))

    return run


def _block_pairs(threshold: float, max_pop: int):
    """Pairs between two blocks of one bucket (or within one block)."""

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        blobs = t.column("entries").to_pylist()
        left, right = (_distinct([x for x, s in zip(blobs, side) if s == k]) if (side == k).any() else None for k in (0, 1))
        if right is None or left is None:  # a block with itself comes as side 0 only
            e = left if left is not None else right
            found = _pair_batches(_bucket_pairs(e, threshold, max_pop)) if t.column("i")[0].as_py() == t.column("j")[0].as_py() else iter(())
        else:
            found = _pair_batches(_cross_pairs(left, right, threshold, max_pop))
        batches = list(found)
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        return pa.Table.from_batches(batches, schema) if batches else schema.empty_table()

    return run


def _cross_pairs(x: np.ndarray, y: np.ndarray, threshold: float, max_pop: int):
    for k in range(len(x)):
        ok = (np.minimum(x["n"][k], y["n"]) >= threshold * np.maximum(x["n"][k], y["n"])) & (x["cls"][k] != y["cls"])
        c = y[ok]
        c = c[np.bitwise_count(c["sketch"] ^ x["sketch"][k]).sum(axis=1, dtype=np.int64) <= max_pop]
        if len(c):
            yield np.minimum(c["cls"], x["cls"][k]), np.maximum(c["cls"], x["cls"][k])


def _hot_pairs(bags: DataFrame, keys: list[int], seed: int, threshold: float) -> DataFrame:
    """Candidates of the buckets put aside: each is cut into blocks of about HOT entries, every two blocks are a group."""
    hot = bags.sparkSession.sparkContext.broadcast(np.array(keys, np.int64).view(np.uint64))  # at most one key for HOT entries
    e = stored(bags.select("cls", "bag").mapInArrow(_hot_entries(hot, seed), "key long, n long, entries binary"), "hot")
    blocks = e.groupBy("key").agg(F.ceil(F.sum("n") / HOT).cast("int").alias("blocks"))
    e = e.join(F.broadcast(blocks), "key").withColumn("block", F.pmod(F.xxhash64("entries"), F.col("blocks")).cast("int"))
    left = e.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "entries", F.lit(0).alias("side"))
    right = e.where("block > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), "entries", F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_block_pairs(threshold, MAX_POP), "a long, b long")


def _bags(min_words: int):
    """(id, class, bag) of the texts of at least min_words words; a bag is 32 bits of each token, in the tokens' order."""

    def run(batches):
        codes = WordCodes()
        for b in batches:
            t = Texts(b.column(1).to_pylist(), codes, min_words)
            short = (t.tokens >> np.uint64(32)).astype(np.uint32)
            bags = [short[a : a + n].tobytes() for a, n in zip(t.starts.tolist(), t.lengths.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t.rows)), pa.array(t.classes()), pa.array(bags, pa.binary())], names=["id", "cls", "bag"])

    return run


def _verified(threshold: float):
    def run(batches):
        for b in batches:
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=False))
                s = both / (len(x) + len(y) - both)
                if s >= threshold - 1e-9:
                    keep.append(i), sims.append(s)
            k = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


def near_duplicates(df: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.7, min_words: int = 40, parts: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, cls) of all texts with at least min_words words; links (a, b, similarity), a < b, between classes of different token sets.

    Rows of one cls have the same words equally often. Null, empty and shorter texts are in no class. MAX_POP and the bands
    suit similarities of 0.7 and more; a lower threshold is an error. parts: target partitions of the buckets; each is held by one task, so by
    default there are enough that one holds about PART_MB, and at least twice the session's shuffle partitions.
    """
    if threshold < 0.7:
        raise ValueError("the sketches' bound and the bands are for similarities of 0.7 and more")
    spark = df.sparkSession
    id_type = dict(df.dtypes)[id_col]
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col))
    bags = stored(texts.mapInArrow(_bags(min_words), f"id {id_type}, cls long, bag binary"), "bags")  # every text is cut into words once
    if not parts:
        parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(bags.count() * BANDS * _ENTRY.itemsize / (PART_MB * 1e6)))
    entries = bags.select("cls", "bag").mapInArrow(_entries(parts, seed), "part int, entries binary")
    found = entries.repartition(parts, "part").select("entries").mapInArrow(_candidates(threshold, MAX_POP, HOT, HELD_MB), "a long, b long")
    pairs = stored(found.distinct(), "candidates")
    aside = [r["a"] for r in pairs.where("b IS NULL").select("a").collect()]
    pairs = pairs.where("b IS NOT NULL")
    if aside:
        pairs = stored(pairs.unionByName(_hot_pairs(bags, aside, seed, threshold)).distinct(), "candidates")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_CLASSES:
        one = bags.join(F.broadcast(wanted), "cls")
    else:
        one = salted_join(bags, wanted, ["cls"], ["id"], how="inner")
    one = one.groupBy("cls").agg(F.first("bag").alias("bag"))  # copies of a text, however many, are spread, and one row each before they meet
    a, b = one.select(F.col("cls").alias("a"), F.col("bag").alias("x")), one.select(F.col("cls").alias("b"), F.col("bag").alias("y"))
    links = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verified(threshold), "a long, b long, similarity double")
    return bags.select("id", "cls"), links


def row_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): every pair of near-same rows, copies included. Its size is the result's; only for reports that must name each pair."""
    m = members
    x, y = m.select(F.col("id").alias("i"), F.col("cls").alias("a")), m.select(F.col("id").alias("j"), F.col("cls").alias("b"))
    same = x.join(y, F.col("a") == F.col("b")).where("i < j").select("i", "j")
    linked = links.select("a", "b").join(x, "a").join(y, "b").select("i", "j")
    both = same.unionByName(linked).select(F.least("i", "j").alias("row_id_a"), F.greatest("i", "j").alias("row_id_b"))
    return both.where("row_id_a < row_id_b").distinct()


def near_duplicate_groups(df: DataFrame, **kw) -> DataFrame:
    """(id, group_id, n_links): one row per text long enough; rows connected by links share group_id (the least id among them); n_links counts linked classes."""
    members, links = near_duplicates(df, **kw)
    links = cut(links)
    classes = members.groupBy("cls").agg(F.min("id").alias("least"))
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), classes.select(F.col("cls").alias("v")))
    n = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    group = classes.join(roots, F.col("cls") == F.col("v")).select("cls", "root", "least")
    group = group.join(group.groupBy("root").agg(F.min("least").alias("group_id")), "root").join(n, "cls", "left").select("cls", "group_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return members.join(group, "cls").select("id", "group_id", "n_links")
