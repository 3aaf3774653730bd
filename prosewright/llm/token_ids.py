"""Encoding of a corpus with a public byte-level BPE vocabulary, by forced boundaries.

Two bytes that stand next to each other in no vocabulary token can't be joined by any merge, so between them a cut is
certain. Each pretoken of the text is cut at all such pairs, the fragments are encoded independently, each distinct
fragment once for as long as it is remembered, and their ids are put one after the other. Because nothing depends on a
fragment's neighbours, a pretoken of any length (a megabyte of letters) costs no more than its fragments.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pretoken pattern published with byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of the vocabulary file byte_bpe_50k (ranks) in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from lines of base64 token and id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ForcedBoundaryEncoder:
    """Encodes texts with the merges that the ranks of a byte-level vocabulary imply."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remembered: int = 600_000):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.joined = np.zeros((256, 256), bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.joined[a, b] = True
        self.known: dict[str, list[int]] = {}
        self.remembered = remembered

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut at every pair of bytes that occurs inside no token."""
        if len(piece) < 2:
            return [piece]
        b = np.frombuffer(piece, np.uint8)
        cuts = np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1
        if not len(cuts):
            return [piece]
        ends = [0, *cuts.tolist(), len(piece)]
        return [piece[i:j] for i, j in zip(ends, ends[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: always the pair of least rank, the leftmost first, until none is left. n log n in its length."""
        ranks = self.ranks
        whole = ranks.get(fragment)
        if whole is not None:
            return [whole]
        n = len(fragment)
        start, nxt, prv, alive = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(fragment[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, end[j], nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if nxt[i] < n and (r := ranks.get(fragment[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
            p = prv[i]
            if p >= 0 and (r := ranks.get(fragment[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[fragment[start[i] : end[i]]])
            i = nxt[i]
        return out

    def pretoken(self, token: str) -> list[int]:
        piece = token.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        for f in self.fragments(piece):
            out += self.merge(f)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty and for a null one."""
        if not text:
            return []
        known, out = self.known, []
        if len(known) > self.remembered:
            known.clear()
        for t in self.find(text):
            ids = known.get(t)
            if ids is None:
                ids = self.pretoken(t)
                if len(t) <= 64:
                    known[t] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], ForcedBoundaryEncoder] = {}


def encoder(path: str, pattern: str = PATTERN) -> ForcedBoundaryEncoder:
    """The worker's encoder for a vocabulary file, made once."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = ForcedBoundaryEncoder(read_ranks(path), pattern)
    return _ENCODERS[key]


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>): one row per row; empty lists for empty and null texts. No special tokens; their strings are ordinary text.

    Rows keep their partitions: there is no shuffle. The vocabulary file must lie at the same path on every executor.
    """
    path = vocabulary or default_vocabulary()
    type_ = dict(df.dtypes)[id_col]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids, flat, offsets = b.column(0), [], [0]
            for t in b.column(1).to_pylist():
                flat += enc.encode(t)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([ids, lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {type_}, ids array<int>")
