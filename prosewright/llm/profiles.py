"""Text quality statistics and structural profiles of documents.

A document is cut into paragraphs. Each paragraph has two distributions: one over word classes (function words of a
language by rank group, other dictionary words, unknown words, numbers, mixed) and one over character classes. Both are
compared by Jensen-Shannon divergence with profiles: natural prose of each language and a number of structures. The
paragraph takes the nearest profile, the document's shares of characters by profile follow, and a document most of whose
characters are in paragraphs nearest to a structure is no prose. Basic counts of the document and the statistics that
FeatureVector stores stand beside them where asked for.

Profiles are centroids of labelled training rows, at most about `sample` rows a label, drawn by hash (the bound is a
parameter; everything else covers all records), besides a few stated ones for structures that have no label.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.functions.features import with_features
from prosewright.functions.words import clean_name, is_blank

LANGUAGES = ("en", "de", "fr", "es")
#: Rank groups of function words; the last rank still counted as one is FUNCTION_RANKS.
RANK_GROUPS = (4, 12, 30, 60)
FUNCTION_RANKS = RANK_GROUPS[-1]
N_WORD = len(RANK_GROUPS) + 4
#: What each label of the training rows is an instance of.
LABELS = {
    "plain": "prose", "boilerplate": "notice",
    "python": "code", "javascript": "code", "sql": "code", "shell": "code",
    "csv": "table", "tsv": "table", "pipe_table": "table",
    "json": "record", "jsonl": "record", "yaml": "record", "ini": "record", "key_value": "record",
    "log_lines": "log", "ocr_garbage": "junk", "pdf_dump": "form",
}
PROSE = {"prose", "notice"}

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _QUOTE, _BRACKET, _SYMBOL, _BAR = range(11)
N_CHAR = 11


def _char_table() -> np.ndarray:
    t = np.full(0x10000, _SYMBOL, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.islower() or (ch.isalpha() and not ch.isupper()):
            t[c] = _LOWER
        elif ch.isupper():
            t[c] = _UPPER
        elif ch.isdigit():
            t[c] = _DIGIT
        elif ch == "\n" or ch == "\r":
            t[c] = _LINE
        elif ch == "\t" or ch == "|":
            t[c] = _BAR
        elif ch.isspace():
            t[c] = _SPACE
    for chars, k in ((".!?…。", _STOP), (",;:", _COMMA), ("'\"-–—’‘“”«»", _QUOTE), ("()[]{}<>", _BRACKET)):
        for ch in chars:
            t[ord(ch)] = k
    return t


_CHARS = _char_table()
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n[ \t\r\n]*")
_TOKEN = re.compile(r"[^\W_]+")
#: FeatureVector's statistics, by the core's definitions.
STORED = ("alpha_ratio", "symbol_ratio", "sentence_punctuation_rate", "dictionary_word_ratio")
#: What may end a sentence, and what may stand behind it.
_ENDS, _CLOSING = tuple(".!?…。！？؟।"), "'\"’”»)]"


class Dictionary:
    """Function words by language and rank group, and all other listed words, from rows of (word, lang, freq_rank)."""

    def __init__(self, rows: list[tuple]):
        best: dict[tuple[str, str], float] = {}
        listed = set()
        for word, lang, rank in rows:
            if not word or not lang:
                continue
            w = word.strip().lower()
            listed.add(w)
            if rank is not None and rank == rank:
                best[lang, w] = min(rank, best.get((lang, w), 1e9))
        self.number: dict[str, int] = {}
        of: dict[int, dict[str, int]] = defaultdict(dict)
        for lang in LANGUAGES:
            for place, (_, w) in enumerate(sorted((r, w) for (g, w), r in best.items() if g == lang)[:FUNCTION_RANKS], 1):
                of[self.number.setdefault(w, len(self.number))][lang] = next(i for i, m in enumerate(RANK_GROUPS) if place <= m)
        k = len(self.number)
        self.listed, self.unknown, self.digits, self.mixed = k, k + 1, k + 2, k + 3
        self.size = k + 4
        for w in listed:
            self.number.setdefault(w, self.listed)
        g = len(RANK_GROUPS)
        self.to_class = np.zeros((self.size, len(LANGUAGES), N_WORD))
        for i in range(k):
            for j, lang in enumerate(LANGUAGES):
                self.to_class[i, j, of[i].get(lang, g)] = 1
        for i, c in ((self.listed, g), (self.unknown, g + 1), (self.digits, g + 2), (self.mixed, g + 3)):
            self.to_class[i, :, c] = 1

    def ids(self, ws: list[str]) -> list[int]:
        get, out = self.number.get, []
        for w in ws:
            i = get(w)
            if i is None:
                i = self.unknown if w.isalpha() else self.digits if w.isdigit() else self.mixed
            out.append(i)
        return out


def paragraphs(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All paragraphs and the number of the text each is from."""
    out, row = [], []
    for i, t in enumerate(texts):
        if t:
            for p in _PARAGRAPH.split(t):
                if p and not p.isspace():
                    out.append(p), row.append(i)
    return out, np.array(row, np.int64)


def line_ends(text: str | None) -> tuple[int, int]:
    """(lines that end a sentence, lines) of a text; blank lines don't count."""
    lines = [x for x in map(str.strip, (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")) if x]
    return sum(x.rstrip(_CLOSING).endswith(_ENDS) for x in lines), len(lines)


def distributions(parts: list[str], d: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word classes in the language that fits best, character classes, number of that language, characters in words) of each paragraph, as counts."""
    n = len(parts)
    flat, counts, inside = [], [], []
    for p in parts:
        w = _TOKEN.findall(p.lower())
        flat += d.ids(w)
        counts.append(len(w)), inside.append(len("".join(w)))
    owner = np.repeat(np.arange(n), counts)
    per = np.bincount(owner * d.size + np.array(flat, np.int64), minlength=n * d.size).reshape(n, d.size)
    by = np.tensordot(per, d.to_class, 1)  # paragraph x language x class
    lang = by[:, :, : len(RANK_GROUPS)].sum(axis=2).argmax(axis=1)
    words = by[np.arange(n), lang]
    lengths = np.array([len(p) for p in parts], np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CHARS[np.minimum(codes, 0xFFFF)].astype(np.int64)
    chars = np.bincount(np.repeat(np.arange(n), lengths) * N_CHAR + kind, minlength=n * N_CHAR).reshape(n, N_CHAR)
    return words, chars, lang, np.array(inside, np.int64)


def _normed(x: np.ndarray, smooth: float = 0.02) -> np.ndarray:
    x = x.astype(float)
    s = x.sum(axis=-1, keepdims=True)
    return (np.divide(x, s, out=np.zeros_like(x), where=s > 0) + smooth / x.shape[-1]) / (1 + smooth)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of each row of p with each row of q."""
    p, q = p[:, None, :], q[None, :, :]
    tiny = 1e-300  # a class of no weight adds nothing
    m = np.log2(np.maximum((p + q) / 2, tiny))
    return ((p * (np.log2(np.maximum(p, tiny)) - m)).sum(axis=2) + (q * (np.log2(np.maximum(q, tiny)) - m)).sum(axis=2)) / 2


class Profiles:
    """Named profiles; prose and notices are per language, structures are compared whatever the language."""

    def __init__(self, names: list[str], langs: list[int], words: np.ndarray, chars: np.ndarray, word_weight: float = 0.6):
        self.names, self.langs = names, np.array(langs)
        self.words, self.chars, self.word_weight = words, chars, word_weight

    def nearest(self, words: np.ndarray, chars: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest profile, its divergence)."""
        far = self.word_weight * divergence(_normed(words), self.words) + (1 - self.word_weight) * divergence(_normed(chars), self.chars)
        far[(self.langs[None, :] >= 0) & (self.langs[None, :] != lang[:, None])] = 9.0
        k = far.argmin(axis=1)
        return k, far[np.arange(len(k)), k]

    @staticmethod
    def fit(rows: list[tuple[str, str]], d: Dictionary) -> "Profiles":
        """Centroids of labelled texts (text, kind). Rows nearer to another kind's centroid are left out of a second round, as labels may be wrong."""
        texts = [t for t, _ in rows]
        words, chars, lang, _ = distributions([t or " " for t in texts], d)
        kinds = [k if k not in PROSE else f"{k}:{LANGUAGES[g]}" for (_, k), g in zip(rows, lang.tolist())]
        w, c = _normed(words), _normed(chars)
        keep = np.ones(len(rows), bool)
        built = None
        for _ in range(2):
            names, langs, ws, cs = [], [], [], []
            for k in sorted(set(kinds)):
                at = [i for i, x in enumerate(kinds) if x == k and keep[i]]
                if len(at) < 3:
                    continue
                names.append(k.split(":")[0]), langs.append(LANGUAGES.index(k.split(":")[1]) if ":" in k else -1)
                ws.append(np.median(w[at], axis=0)), cs.append(np.median(c[at], axis=0))
            for name, a, b in _STATED:
                names.append(name), langs.append(-1), ws.append(_normed(np.array(a))), cs.append(_normed(np.array(b)))
            ws, cs = np.array(ws), np.array(cs)
            built = Profiles(names, langs, ws / ws.sum(axis=1, keepdims=True), cs / cs.sum(axis=1, keepdims=True))
            near, _ = built.nearest(words, chars, lang)
            keep = np.array([built.names[j] == k.split(":")[0] for j, k in zip(near.tolist(), kinds)])
        return built


#: Structures without a label of their own: word classes (four rank groups, listed, unknown, numbers, mixed) and character
#: classes (lower, upper, digit, space, line, stop, comma, quote, bracket, symbol, bar), in hundredths.
_STATED = [
    ("list", [1, 1, 1, 1, 80, 15, 0, 1], [72, 4, 1, 12, 4, 0, 4, 1, 0, 2, 0]),
    ("list", [1, 1, 1, 1, 50, 45, 0, 1], [66, 8, 3, 13, 5, 0, 1, 1, 1, 2, 0]),
    ("list", [1, 1, 1, 1, 35, 40, 20, 1], [45, 7, 10, 12, 5, 18, 2, 0, 0, 1, 0]),
    ("junk", [1, 1, 1, 1, 1, 94, 0, 1], [80, 2, 0, 15, 0, 2, 1, 0, 0, 0, 0]),
    ("junk", [0, 0, 0, 0, 0, 12, 84, 4], [6, 0, 55, 25, 2, 2, 1, 0, 0, 9, 0]),
    ("junk", [0, 0, 0, 0, 0, 50, 25, 25], [1, 1, 1, 12, 4, 8, 6, 9, 14, 40, 4]),
]


def dictionary(words: DataFrame, limit: int = 200_000) -> Dictionary:
    """From the word list, a fixed small table; more than `limit` rows are an error."""
    rows = words.select("word", "lang", "freq_rank").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("the word list is too long to be held by every worker")
    return Dictionary([tuple(r) for r in rows])


def fit_profiles(train: DataFrame, d: Dictionary, sample: int = 120, seed: int = 23) -> Profiles:
    """Profiles from labelled rows: about `sample` of each label in LABELS, drawn by hash."""
    label = clean_name("sub_type")
    rows = train.where(~is_blank(F.col("text"))).select("row_id", label.alias("label"))
    rows = rows.where(F.col("label").isin(list(LABELS)))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {k: sample * (4 if LABELS[k] in PROSE else 1) for k in n}
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, wanted[k] / v)))]) if n else F.create_map(F.lit(""), F.lit(0.0))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, label), F.lit(0.0)) * (1 << 20)
    got = train.where(drawn & F.col("text").isNotNull()).select("text", label.alias("label")).collect()
    return Profiles.fit([(r["text"], LABELS[r["label"]]) for r in got], d)


def structure(df: DataFrame, profiles: Profiles, d: Dictionary, id_col: str = "doc_id", text_col: str = "text", statistics: bool = False) -> DataFrame:
    """(id, profile, divergence, prose_share, n_paragraphs) of every row with text that isn't blank.

    profile: the one most characters are nearest to; divergence: mean over characters; prose_share: share of characters
    in paragraphs nearest to prose or notices. Null, empty and blank texts have no row; repeated ids keep each row.

    With statistics, every row comes out, and also has n_words, mean_word_length (characters), line_end_ratio (share of
    lines that end a sentence, blank lines not counted), common_word_ratio (share of words that are function words of
    their paragraph's language), and STORED and line_count of the whole text as the core defines them. Null, empty and
    blank texts then have no paragraph and no word, a null profile, divergence and prose_share, and 0 for the ratios
    (of STORED, what the core gives).
    """
    spark = df.sparkSession
    id_type = dict(df.dtypes)[id_col]
    held = spark.sparkContext.broadcast((profiles, d))
    names = sorted(set(profiles.names))
    schema = f"id {id_type}, profile string, divergence double, prose_share double, n_paragraphs int"
    rows_in = df.select(id_col, text_col)
    if statistics:
        rows_in = with_features(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), names=STORED, sample_bytes=None, wordlist=d.number).select("id", "text", *STORED, "line_count")
        schema += ", n_words long, mean_word_length double, line_end_ratio double, common_word_ratio double" + "".join(f", {c} float" for c in STORED) + ", line_count int"

    def run(batches):
        p, words = held.value
        prose = np.array([n in PROSE for n in p.names])
        number = np.array([names.index(n) for n in p.names])
        for b in batches:
            texts = b.column(1).to_pylist()
            parts, row = paragraphs(texts)
            if not parts and not statistics:
                continue
            w, c, lang, inside = distributions(parts, words)
            near, far = p.nearest(w, c, lang)
            size = c.sum(axis=1) - c[:, _SPACE] - c[:, _LINE]
            rows = np.arange(len(texts)) if statistics else np.unique(row)
            at = np.searchsorted(rows, row)
            k = len(rows)
            n = np.bincount(at, minlength=k)
            none = n == 0
            total = np.maximum(1, np.bincount(at, size, k))
            by = np.bincount(at * len(names) + number[near], size, minlength=k * len(names)).reshape(-1, len(names))
            out = [
                b.column(0).take(pa.array(rows)),
                pa.array([names[i] for i in by.argmax(axis=1)], pa.string(), mask=none) if k else pa.array([], pa.string()),
                pa.array(np.bincount(at, size * far, k) / total, mask=none),
                pa.array(np.bincount(at, size * prose[near], k) / total, mask=none),
                pa.array(n.astype(np.int32)),
            ]
            if statistics:
                n_words = np.bincount(at, w.sum(axis=1), k)
                ends = np.array([line_ends(t) for t in texts], np.int64).reshape(-1, 2)
                out += [
                    pa.array(n_words.astype(np.int64)),
                    pa.array(np.bincount(at, inside, k) / np.maximum(1, n_words)),
                    pa.array(ends[:, 0] / np.maximum(1, ends[:, 1])),
                    pa.array(np.bincount(at, w[:, : len(RANK_GROUPS)].sum(axis=1), k) / np.maximum(1, n_words)),
                    *b.columns[2:],
                ]
            yield pa.RecordBatch.from_arrays(out, names=columns)

    columns = [x.split()[0] for x in schema.split(", ")]
    return rows_in.mapInArrow(run, schema)
