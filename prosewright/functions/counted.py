"""Features that count how often characters, lines, shapes or word triples of a text recur, in one pass over Arrow batches."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Unicode White_Space, as textprims.WS has it.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_SPACES}]+")
_LINE_END = re.compile(r"\r?\n")

# Delimiters of fields.
DELIMITERS = [",", "|", "\t", ";"]


def _tokens(text: str) -> list[str]:
    return [x for x in _SPACE.split(text) if x]


class _Text:
    """A text, and its lines and tokens where asked for."""

    def __init__(self, text: str):
        self.text = text
        self._lines = self._words = None

    @property
    def lines(self) -> list[str]:
        if self._lines is None:
            parts = _LINE_END.split(self.text)
            self._lines = parts if parts[-1] else parts[:-1]
        return self._lines

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = _tokens(self.text)
        return self._words


def _entropy(t: _Text, known: frozenset) -> float:
    """Shannon entropy of the characters, in bits."""
    n = np.unique(np.frombuffer(t.text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
    p = n / n.sum()
    return float(max(0.0, -(p * np.log2(p)).sum()))


def _delimiter(t: _Text, known: frozenset) -> float:
    """Share of lines with the most frequent number of a delimiter (of equally frequent ones the first seen), if it isn't 0; for the best delimiter."""
    if len(t.lines) < 3:
        return 0.0
    best = 0
    for d in DELIMITERS:
        if d in t.text:
            number, times = max(Counter([x.count(d) for x in t.lines]).items(), key=lambda x: x[1])
            best = max(best, times if number else 0)
    return best / len(t.lines)


def _dictionary(t: _Text, known: frozenset) -> float:
    words = [x for x in (w.lower().strip(string.punctuation) for w in t.words) if x]
    return sum(w in known for w in words) / len(words) if words and known else 0.0


def _shapes(t: _Text, known: frozenset) -> float:
    """Share of the first twenty lines that have the most frequent shape: number of tokens, and which delimiters there are."""
    if len(t.lines) < 3:
        return 0.0
    first = t.lines[:20]
    return max(Counter([(len(_tokens(x)), *(d in x for d in DELIMITERS)) for x in first]).values()) / len(first)


def _short_repeated(t: _Text, known: frozenset) -> float:
    """Share of short lines that occur more than once."""
    short = [x for x in (y.strip(_SPACES) for y in t.lines) if 1 <= len(x) <= 40 and len(x.encode("utf-8", "surrogatepass")) <= 40]
    return sum(n for n in Counter(short).values() if n > 1) / len(short) if len(short) > 1 else 0.0


def _triples(t: _Text, known: frozenset) -> float:
    """Share of distinct triples of tokens that occur more than once."""
    w = t.words
    n = Counter(zip(w, w[1:], w[2:])).values()
    return sum(x > 1 for x in n) / len(n) if n else 0.0


#: feature -> its value for a text that isn't empty
COUNTED = {
    "char_entropy": _entropy, "delimiter_consistency": _delimiter, "repetitive_structure_score": _shapes, "short_repeated_line_ratio": _short_repeated,
    "dictionary_word_ratio": _dictionary, "repeated_ngram_ratio": _triples,
}


def counted(names: list[str], wordlist: Iterable[str] | None = None):
    """A function of a text column that gives a struct of the named features; null and empty texts have zeros."""
    known = frozenset(wordlist or ())

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        zeros = [0.0] * len(names)
        rows = []
        for x in texts:
            t = _Text(x) if x else None
            rows.append([COUNTED[n](t, known) for n in names] if t else zeros)
        return pd.DataFrame(rows, columns=names, dtype=float)

    return run
