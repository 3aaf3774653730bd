"""Evaluation passages leaking into training texts, by q-gram filtering in diagonal bands.

Texts are normalised to lower-case words joined by single spaces. A passage is `min_words` consecutive words of an item,
m characters long. A text that holds it with at most e edits shares at least m + 1 - q (e + 1) of its q-grams with it,
and their diagonals (position in the text less position in the item) lie within e of one another. So:

1. Every q-gram of a text is looked up in an index of the items' q-grams.
2. Hits are counted in diagonal bands of 2 (e + 1) diagonals that overlap by half, so that any e + 1 neighbouring
   diagonals lie in one of them. A band's regions are the passages whose own characters hold as many hits as the lemma
   asks of their length.
3. Each region is verified by an alignment restricted to the band's diagonals, all regions of a batch side by side.
4. Where unchanged words are asked for, only passages aligned without an edit, between word borders, stay.

q is chosen for each item: the largest of GRAMS that the lemma allows for its shortest passage, so that no bound is empty.

The items are a stated query set. They lie in the shared folder, in blocks of about `max_items_mb` of text; a worker
reads one block at a time, and each block is a pass over the documents. Corpus rows are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.functions.words import mix64, words
from prosewright.llm.overlap import shared_table
from prosewright.session import shared_path

#: Lengths of q-grams to choose from.
GRAMS = (24, 16, 12, 8, 6, 4, 3, 2, 1)
#: Characters of texts looked up at a time, hits taken up at once, and passages aligned at once.
TEXT_CHARS, HITS, ALIGNED = 1 << 21, 1 << 21, 1 << 13

_BITS = 22  # of the membership bitmap
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, by doubling: a gram of 2k characters combines two of k."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, have, done, at = mix64(codes.astype(np.uint64) + np.uint64(1)), 1, None, 0
    rest = q
    while rest:
        if rest & 1:
            part = h[at : at + n]
            done = part.copy() if done is None else done * _BASE + part
            at += have
        rest >>= 1
        if rest:
            h = h[: len(h) - have] * _BASE + h[have:]
            h ^= h >> np.uint64(29)
            have *= 2
    return mix64(done)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _spans(n: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def gram_length(shortest: int, edits: int) -> int:
    """The largest of GRAMS of which a passage of `shortest` characters keeps at least one under so many edits."""
    return next(q for q in GRAMS if q * (edits + 1) <= shortest)


class Items:
    """Items of one gram length q: their passages, and an index of their q-grams."""

    def __init__(self, ids: list[int], texts: list[str], q: int, edits: int, min_words: int):
        self.q, self.edits, self.ids = q, edits, np.array(ids, np.int64)
        codes, start, size, count, grams, item, pos = [], [], [], [], [], [], []
        base = 0
        for k, t in enumerate(texts):
            c = _codes(t)
            first = np.flatnonzero(np.append(True, c[:-1] == 32))
            last = np.append(first[1:] - 1, len(c))[min_words - 1 :]
            first = first[: len(last)]
            start.append(base + first), size.append(last - first), count.append(len(first))
            g = _grams(c, q)
            grams.append(g), item.append(np.full(len(g), k, np.int64)), pos.append(np.arange(len(g)))
            codes.append(c)
            base += len(c)
        self.codes = np.concatenate(codes)
        self.base = np.cumsum([0, *(len(c) for c in codes)])
        #: Passages: place in codes, length, and the hits the lemma asks for; windows[k]:windows[k + 1] are those of item k.
        self.start, self.size = np.concatenate(start), np.concatenate(size)
        self.bound = np.maximum(1, self.size + 1 - q * (edits + 1))
        self.windows = np.cumsum([0, *count])
        self.least = np.minimum.reduceat(self.bound, self.windows[:-1])
        g, item, pos = np.concatenate(grams), np.concatenate(item), np.concatenate(pos)
        order = np.argsort(g, kind="stable")
        self.keys, first = np.unique(g[order], return_index=True)
        self.item, self.pos = item[order], pos[order]
        #: (number of the gram, item) of each entry, in order
        self.entry = np.repeat(np.arange(len(self.keys)), np.diff(np.append(first, len(g)))) * len(ids) + self.item
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def _hits(self, codes: np.ndarray, ends: np.ndarray):
        """(text, item, position in the item, diagonal) of all hits, in pieces of whole (text, item) pairs of about HITS."""
        g = _grams(codes, self.q)
        at = np.flatnonzero(self.bitmap[(g & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        ok = self.keys[k] == g[at]
        at, k = at[ok], k[ok]
        text = np.searchsorted(ends, at, side="right")
        n_items = len(self.ids)

        def expand(at, k, text, a, b):
            lo, hi = np.searchsorted(self.entry, k * n_items + a), np.searchsorted(self.entry, k * n_items + b)
            n = hi - lo
            hit = np.repeat(np.arange(len(at)), n)
            e = np.repeat(lo, n) + _spans(n)
            item, pos = self.item[e], self.pos[e]
            return text[hit], item, pos, at[hit] - (self.base[item] + pos)

        n = np.searchsorted(self.entry, (k + 1) * n_items) - np.searchsorted(self.entry, k * n_items)
        per = np.bincount(text, n, minlength=len(ends)).astype(np.int64)
        piece = np.cumsum(per) // HITS
        for p in np.unique(piece):
            mine = piece[text] == p
            weight = int(n[mine].sum())
            if weight <= 2 * HITS or n_items == 1:
                yield expand(at[mine], k[mine], text[mine], 0, n_items)
                continue
            width = max(1, n_items * HITS // weight)  # one text that repeats what many items hold: some items at a time
            for a in range(0, n_items, width):
                yield expand(at[mine], k[mine], text[mine], a, min(n_items, a + width))

    def regions(self, codes: np.ndarray, ends: np.ndarray):
        """(text, first diagonal of the band, passage) of all regions; diagonals are between places in `codes` and in the items' codes."""
        if not len(self.keys):
            return
        width = 2 * (self.edits + 1) if self.edits else 1
        for text, item, pos, diagonal in self._hits(codes, ends):
            for half in (0, self.edits + 1) if self.edits else (0,):
                band = (diagonal + (1 << 40) + half) // width
                order = np.lexsort((pos, band, item, text))
                t, i, b, p = text[order], item[order], band[order], pos[order]
                s = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]))) if len(t) else np.empty(0, np.int64)
                n = np.diff(np.append(s, len(t)))
                enough = n >= self.least[i[s]]
                s, n = s[enough], n[enough]
                if not len(s):
                    continue
                # the hits of the bands that are left, numbered by band, to be counted by passage
                at = np.repeat(s, n) + _spans(n)
                key = (np.repeat(np.arange(len(s)), n) << 40) + p[at]
                w = self.windows[i[s] + 1] - self.windows[i[s]]
                of = np.repeat(np.arange(len(s)), w)
                passage = np.repeat(self.windows[i[s]], w) + _spans(w)
                first = self.start[passage] - self.base[i[s][of]]
                held = np.searchsorted(key, (of << 40) + first + self.size[passage] - self.q, "right") - np.searchsorted(key, (of << 40) + first)
                ok = held >= self.bound[passage]
                yield t[s][of[ok]], b[s][of[ok]] * width - (1 << 40) - half, passage[ok]

    def align(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, diagonal: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """diagonals of a band x passages: the least edits with which the passage ends on each, in the text at codes[lo:hi].

        It may begin on any diagonal of the band. A replaced, missing or added character is one edit.
        """
        width = 2 * (self.edits + 1) if self.edits else 1
        out = np.empty((width, len(passage)), np.int16)
        by_size = np.argsort(self.size[passage], kind="stable")
        for c in range(0, len(passage), ALIGNED):
            mine = by_size[c : c + ALIGNED]
            start, size, left, right = self.start[passage[mine]], self.size[passage[mine]], lo[mine], hi[mine]
            cost = np.zeros((width, len(mine)), np.int16)
            for r in range(int(size.max(initial=0))):
                live = r < size
                ch = self.codes[start + np.minimum(r, size - 1)]
                new = np.empty_like(cost)
                for d in range(width):
                    j = start + r + diagonal[mine] + d
                    differs = (codes[np.clip(j, 0, len(codes) - 1)] != ch) | (j < left) | (j >= right)
                    new[d] = cost[d] + differs
                    if d + 1 < width:
                        np.minimum(new[d], cost[d + 1] + 1, out=new[d])
                    if d:
                        np.minimum(new[d], new[d - 1] + 1, out=new[d])
                cost = np.where(live, new, cost)
            out[:, mine] = cost
        return out

    def matches(self, texts: list[str], exact: bool):
        """(text, item, words) of the passages that stand in the texts; words: the longest stretch of them in a row."""
        codes = _codes("\x00".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        for text, diagonal, passage in self.regions(codes, ends):
            hi = ends[text] - 1
            lo = np.concatenate([[0], ends])[text]
            cost = self.align(codes, lo, hi, diagonal, passage)
            if exact:  # unchanged, and between borders of words
                d, at = np.nonzero(cost == 0)
                lane = diagonal[at] + d
                a = self.start[passage[at]] + lane
                b = a + self.size[passage[at]]
                ok = ((a == lo[at]) | (codes[a - 1] == 32)) & ((b == hi[at]) | (codes[np.minimum(b, len(codes) - 1)] == 32))
                at, lane = at[ok], lane[ok]
            else:
                at = np.flatnonzero(cost.min(axis=0) <= self.edits)
                lane = diagonal[at]
            if not len(at):
                continue
            found = np.unique(np.stack([text[at], lane, passage[at]], axis=1), axis=0)
            item = np.searchsorted(self.windows, found[:, 2], side="right") - 1
            new = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1) | (found[1:, 2] != found[:-1, 2] + 1) | (item[1:] != item[:-1]))
            s = np.flatnonzero(new)
            yield found[s, 0], self.ids[item[s]], np.diff(np.append(s, len(found)))


def _tiers(ids: list[int], texts: list[str | None], q: int | None, edits: int, min_words: int) -> list[Items]:
    """The items by gram length; those of too few words have no passage and are left out."""
    by: dict[int, tuple[list[int], list[str]]] = {}
    for i, t in zip(ids, texts):
        w = words(t)
        if len(w) < min_words:
            continue
        size = np.cumsum([0, *(len(x) + 1 for x in w)])
        shortest = int((size[min_words:] - size[:-min_words]).min()) - 1
        mine = by.setdefault(q or gram_length(shortest, edits), ([], []))
        mine[0].append(i), mine[1].append(" ".join(w))
    return [Items(*x, g, edits, min_words) for g, x in sorted(by.items())]


_BLOCK: dict[tuple, list[Items]] = {}


def _block(path: str, block: int, *settings) -> list[Items]:
    """The worker's block of items; only the last one used is kept."""
    key = (path, block, *settings)
    if key not in _BLOCK:
        _BLOCK.clear()
        t = shared_table(f"{path}/block={block}", ["id", "text"])
        _BLOCK[key] = _tiers(t.column("id").to_pylist(), t.column("text").to_pylist(), *settings)
    return _BLOCK[key]


def _pieces(texts: list[str]):
    """Slices of texts of about TEXT_CHARS characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TEXT_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _scan(path: str, block: int, q: int | None, edits: int, min_words: int, exact: bool):
    def run(batches):
        for b in batches:
            held = _block(path, block, q, edits, min_words)
            ids, texts = b.column(0).to_numpy(), [" ".join(words(t)) for t in b.column(1).to_pylist()]
            best: dict[tuple[int, int], int] = {}
            for piece in _pieces(texts):
                for items in held:
                    for text, item, n in items.matches(texts[piece], exact):
                        for pair, k in zip(zip(item.tolist(), ids[piece][text].tolist()), n.tolist()):
                            best[pair] = max(k + min_words - 1, best.get(pair, 0))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in best], pa.int64()), pa.array([x for _, x in best], pa.int64()), pa.array(list(best.values()), pa.int32())], names=["item_id", "doc_id", "n_words"])

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, min_words: int = 13, edits: int = 1, exact: bool = True, q: int | None = None, max_items_mb: float = 4.0, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(item_id, doc_id, n_words): documents that hold at least min_words consecutive words of an item.

    Regions are found and aligned with an edit budget of `edits` characters a passage. exact: then only passages of
    unchanged whole words count, and n_words is their longest run. Else passages within the budget count, words and
    borders changed or not, and n_words is the longest stretch of the item each min_words of which are within it.
    Null, empty and short texts match nothing; several rows of one id give the best of them. q, if given, must suit the
    shortest possible passage.
    """
    if q and q * (edits + 1) > 2 * min_words - 1:
        raise ValueError("q * (edits + 1) must not exceed the characters of the shortest passage of min_words words")
    if not edits and not exact:
        raise ValueError("without edits only unchanged words can be found")
    spark = docs.sparkSession
    kept = items.where(F.col("text").isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("id"), "text")
    chars = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // int(max_items_mb * 1e6)))
    path = shared_path(spark, "items")
    kept.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
    there = [r[0] for r in spark.read.schema("id long, text string, block int").parquet(path).select("block").distinct().collect()]
    rows = docs.where(F.col("text").isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long"), "text")
    schema = "item_id long, doc_id long, n_words int"
    out = spark.createDataFrame([], schema)
    for block in sorted(there):
        out = out.unionByName(rows.mapInArrow(_scan(path, block, q, edits, min_words, exact), schema))
    return out.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"))
