"""Words of a text: longest runs of letters or digits, lower-cased.

Both engines' forms live here: Column expressions for work inside the JVM, and plain-Python helpers for Arrow batches.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")

#: The same as a Java pattern.
WORD_JAVA = r"[\p{L}\p{N}]+"

_SPACE_JAVA = r"\p{IsWhite_Space}"


def words(text: str | None) -> list[str]:
    """Words in order; none for a null text."""
    return WORD.findall(text.lower()) if text else []


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_JAVA), F.lit(0))


def is_blank(text: Column) -> Column:
    """True for null and for nothing but white space."""
    return F.coalesce(~text.rlike(rf"[^{_SPACE_JAVA}]"), F.lit(True))


def clean_name(name: Column) -> Column:
    """Trimmed, lower-cased, `-` read as `_`; null stays null."""
    trimmed = F.regexp_replace(name, rf"^{_SPACE_JAVA}+|{_SPACE_JAVA}+$", "")
    return F.translate(F.lower(trimmed), "-", "_")


class WordCodes:
    """Maps words to stable 32-bit codes, keeping those already seen.

    The memory is emptied when it holds `limit` words, so it stays bounded on any corpus; codes never change.
    """

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.seen: dict[str, int] = {}

    def encode(self, ws: list[str]) -> list[int]:
        seen = self.seen
        try:
            return [seen[w] for w in ws]
        except KeyError:
            pass
        if len(seen) > self.limit:
            seen.clear()
        out = []
        for w in ws:
            c = seen.get(w)
            if c is None:
                b = w.encode("utf-8", "surrogatepass")
                c = seen[w] = zlib.crc32(b)
            out.append(c)
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), elementwise on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bag_tokens(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers repeated words within each text, so that a multiset becomes a set of 64-bit tokens.

    codes: word codes of all texts, one after the other; starts: where each text begins.
    Returns tokens sorted within each text; equal multisets give equal rows.
    """
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64)
    lengths = np.diff(np.append(starts, n))
    doc = np.repeat(np.arange(len(starts), dtype=np.uint64), lengths)
    both = (doc << np.uint64(32)) | codes.astype(np.uint64)
    both.sort()
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(both[1:], both[:-1], out=new[1:])
    first = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    tokens = mix64(((both & np.uint64(0xFFFFFFFF)) << np.uint64(20)) + nth.astype(np.uint64) + np.uint64(1))
    # sorted by code, then by repeat: the same order for equal multisets
    return tokens
