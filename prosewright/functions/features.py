"""The 41 structural features of a text, in canonical order, as Column expressions.

`with_features` adds them to a DataFrame without a shuffle: one projection of shared primitives (sample, lines, trimmed
lines, tokens), then one of features. Those that count how often the values of a text recur (functions.counted) are
computed together in Arrow batches: expressions over arrays would be quadratic or interpreted row by row. Values are
computed in double and cast to float; a null or empty text has all zeros and line_count 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions.counted import COUNTED, DELIMITERS, counted
from prosewright.functions.textprims import ALNUM, WS, byte_prefix, count_of, lines, ltrim, ratio, rtrim, tokens, trim, unescape_newlines

# Sequences of wrongly decoded text, and programming operators.
MOJIBAKE = ["Ã©", "Ã¨", "Ã¼", "Ã¶", "Ã¤", "Â°", "Â©", "â\u0080\u0093", "â\u0080\u0099", "â\u0080\u009c", "â\u0080\u009d"]
OPERATORS = ["==", "!=", ">=", "<=", "&&", "||", "=>", "->", "+=", "-=", "*=", "/=", "**", "<<", ">>", "::"]

# Line and token patterns (Java dialect).
SENTENCE_END = rf"(?<=\p{{IsAlphabetic}})[.!?](?={WS}|\z)"
SYMBOL = rf"[^{ALNUM} \n\t\r.,;:!?\-'\"←-⇿─-➿–—•°©®™…×÷]"
LOG_START = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}|\[[0-9]{4})"
COMMENT_START = r"^(?:#|//|/\*|--|%)"
NUMBER = r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
PAGE = r"^[0-9]{1,4}$|(?i)^page[ \t\f\r]+[0-9]{1,4}([ \t\f\r]+of[ \t\f\r]+[0-9]{1,4})?$|^[0-9]{1,4}[ \t\f\r]*/[ \t\f\r]*[0-9]{1,4}"
LABEL_VALUE = rf"^[A-Za-z][A-Za-z0-9 _/().]{{0,31}}+[ \t\f\r]*+[:\-][ \t\f\r]++[^{WS}]"
SPACED = rf"[^{WS}]{WS}{{2,}}[^{WS}]"
MARKUP = r"\*\*[^*](?s:.*?)\*\*|`[^`]+`|\*[^*\s][^*]*\*|\[[^\]]+\]\([^)]+\)"
HEADING = r"^#+ .*\S|^[=\-*~^\"'`]{3,}$"
LIST_ITEM = rf"^(?:[-*•] |[0-9]+[.)] )[^{WS}]"
SECTION = r"^\[[A-Za-z0-9_ .\-]+\]$"

class _Primitives:
    """Columns of shared primitives by name; they are dropped from the result. Made on use, as a Column needs a session."""

    names = ("s", "r", "l", "t", "ne", "w", "chars", "n", "m")

    def __getattr__(self, name: str) -> Column:
        return F.col(f"_{name}")


P = _Primitives()


def _share(hits: Callable[[Column], Column], of: Column, by: Column) -> Column:
    return ratio(F.size(F.filter(of, hits)), by)


def _line_length_cv() -> Column:
    sizes = F.transform(P.l, lambda x: F.octet_length(x).cast("double"))
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.size(P.l)
    var = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(P.l)
    return F.when((F.size(P.l) < 2) | (mean < 1), F.lit(0.0)).otherwise(F.sqrt(var) / mean)


def _columns_before(line: Column) -> Column:
    """Columns of white space a line starts with; a tab counts four."""
    return F.length(F.replace(F.regexp_extract(line, f"^{WS}*", 0), F.lit("\t"), F.lit("    ")))


def _is_key_value(t: Column) -> Column:
    colon, equal = F.instr(t, ": "), F.instr(t, "=")
    named = lambda at: F.substring(t, F.lit(1), at - 1).rlike(f"[{ALNUM}]")
    return F.when(colon > 0, (colon > 1) & named(colon)).otherwise((equal > 1) & (equal < F.length(t)) & named(equal))


def _hyphenated() -> Column:
    broken = F.zip_with(F.slice(P.l, 1, F.greatest(F.size(P.l) - 1, F.lit(0))), F.slice(P.l, 2, F.greatest(F.size(P.l) - 1, F.lit(0))), lambda a, b: rtrim(a).endswith("-") & ltrim(b).rlike(r"^\p{IsLowercase}"))
    return F.when(F.size(P.l) < 2, F.lit(0.0)).otherwise(ratio(F.size(F.filter(broken, lambda x: x)), F.size(P.l) - 1))


def _uppercase_header() -> Column:
    def hit(t: Column) -> Column:
        letters, upper = F.regexp_count(t, F.lit(r"\p{IsAlphabetic}")), F.regexp_count(t, F.lit(r"\p{IsUppercase}"))
        return (F.octet_length(t) <= 80) & (letters >= 3) & ((upper / letters).cast("float") >= F.lit(0.8).cast("float")) & ~t.rlike(r"[.!?]$")

    return _share(hit, P.ne, P.m)


def _multiple_of(base: int) -> Callable[[Column], Column]:
    return lambda v: v % base == 0


def _indentation() -> Column:
    levels = F.transform(F.filter(P.l, lambda x: x.rlike(rf"^{WS}+[^{WS}]")), _columns_before)
    n = F.size(levels)
    best = F.greatest(*[F.size(F.filter(levels, _multiple_of(b))) for b in (2, 3, 4)])
    return F.when(n < 3, F.lit(0.0)).otherwise(ratio(best, n))


def _code_fences() -> Column:
    state = F.aggregate(
        P.t,
        F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n")),
        lambda s, t: F.when(t.startswith("```"), F.struct((~s["inside"]).alias("inside"), s["n"].alias("n"))).otherwise(F.struct(s["inside"].alias("inside"), (s["n"] + s["inside"].cast("int")).alias("n"))),
    )
    return ratio(state["n"], P.n)


def _prose_paragraphs() -> Column:
    is_line = lambda t: (F.octet_length(t) > 40) & ~t.rlike(r"[|{}\t]") & ~t.startswith("#")
    state = F.aggregate(
        P.t,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("n")),
        lambda s, t: F.when(is_line(t), F.struct((s["run"] + 1).alias("run"), s["n"].alias("n"))).otherwise(F.struct(F.lit(0).alias("run"), (s["n"] + F.when(s["run"] >= 3, s["run"]).otherwise(0)).alias("n"))),
    )
    return ratio(state["n"] + F.when(state["run"] >= 3, state["run"]).otherwise(0), P.n)


def _per_mille(count: Column) -> Column:
    return ((count.cast("double") / P.chars).cast("float") * F.lit(1000.0).cast("float")).cast("double")


#: feature -> expression over the shared primitives; the order is the model's input order.
FEATURES: dict[str, Callable[[], Column]] = {
    "line_length_cv": _line_length_cv,
    "char_entropy": lambda: F.col("_counted.char_entropy"),
    "leading_whitespace_ratio": lambda: _share(lambda x: _columns_before(x) > 2, P.l, P.n),
    "tab_density": lambda: ratio(count_of(P.s, "\t"), P.chars),
    "sentence_punctuation_rate": lambda: ratio(F.regexp_count(P.s, F.lit(SENTENCE_END)), F.greatest(F.size(P.w), F.lit(1))),
    "paragraph_break_rate": lambda: ratio(count_of(P.s, "\n\n"), P.n),
    "alpha_ratio": lambda: ratio(F.regexp_count(P.s, F.lit(f"[{ALNUM} ]")), P.chars),
    "line_uniqueness": lambda: ratio(F.size(F.array_distinct(F.slice(P.l, 1, 500))), F.greatest(F.size(F.slice(P.l, 1, 500)), F.lit(1))),
    "short_line_ratio": lambda: _share(lambda t: F.octet_length(t).between(1, 14), P.t, P.n),
    "symbol_ratio": lambda: ratio(F.regexp_count(P.s, F.lit(SYMBOL)), P.chars),
    "delimiter_consistency": lambda: F.col("_counted.delimiter_consistency"),
    "json_brace_depth": lambda: ratio(F.regexp_count(P.s, F.lit(r"[{}\[\]]")), P.chars),
    "key_value_ratio": lambda: _share(_is_key_value, P.t, P.n),
    "xml_tag_ratio": lambda: _share(lambda x: x.rlike(r"</?\p{IsAlphabetic}"), P.l, P.n),
    "log_line_ratio": lambda: _share(lambda t: t.rlike(LOG_START), P.t, P.n),
    "comment_ratio": lambda: _share(lambda t: t.rlike(COMMENT_START), P.t, P.n),
    "numeric_field_ratio": lambda: _share(lambda w: F.replace(w, F.lit(","), F.lit("")).rlike(NUMBER), P.w, F.size(P.w)),
    "repetitive_structure_score": lambda: F.col("_counted.repetitive_structure_score"),
    "hyphenated_line_break_ratio": _hyphenated,
    "short_repeated_line_ratio": lambda: F.col("_counted.short_repeated_line_ratio"),
    "page_number_density": lambda: _share(lambda t: t.rlike(PAGE), P.t, P.n),
    "label_value_line_ratio": lambda: _share(lambda t: t.rlike(LABEL_VALUE), P.t, P.n),
    "table_fragment_score": lambda: ratio(F.size(F.filter(P.l, lambda x: (trim(x) != "") & ((F.regexp_count(x, F.lit(r"[,|\t;]")) >= 2) | x.rlike(SPACED)))), P.m),
    "uppercase_header_ratio": _uppercase_header,
    "dictionary_word_ratio": lambda: F.col("_counted.dictionary_word_ratio"),
    "encoding_error_ratio": lambda: ratio(sum((count_of(P.s, m) for m in MOJIBAKE), count_of(P.s, "�")), P.chars),
    "repeated_ngram_ratio": lambda: F.col("_counted.repeated_ngram_ratio"),
    "sentence_coherence_score": lambda: _share(lambda t: t.rlike(r"(?s)^\p{IsUppercase}(?:.*[.!?])$"), P.ne, P.m),
    "avg_words_per_line": lambda: ratio(F.size(P.w), P.m),
    "operator_density": lambda: _per_mille(sum((count_of(P.s, o) for o in OPERATORS[1:]), count_of(P.s, OPERATORS[0]))),
    "inline_markup_count": lambda: _per_mille(F.regexp_count(P.s, F.lit(MARKUP))),
    "indentation_consistency": _indentation,
    "markup_heading_ratio": lambda: _share(lambda t: t.rlike(HEADING), P.ne, P.m),
    "code_fence_density": _code_fences,
    "prose_paragraph_ratio": _prose_paragraphs,
    "semicolon_line_ending_ratio": lambda: _share(lambda t: t.endswith(";"), P.ne, P.m),
    "list_item_ratio": lambda: _share(lambda x: ltrim(x).rlike(LIST_ITEM), F.filter(P.l, lambda x: trim(x) != ""), P.m),
    "parenthesis_density": lambda: _per_mille(F.regexp_count(P.s, F.lit(r"[()]"))),
    "section_header_ratio": lambda: _share(lambda t: t.rlike(SECTION), P.ne, P.m),
    "json_lines_ratio": lambda: _json_lines(),
    "shebang_present": lambda: ltrim(P.s).startswith("#!").cast("double"),
}


def _json_lines() -> Column:
    full = F.filter(F.transform(lines(P.r), trim), lambda t: t != "")
    return ratio(F.size(F.filter(full, lambda t: t.startswith("{") & t.endswith("}"))), F.size(full))


def dictionary_tokens(text_tokens: Column) -> Column:
    """Lower-case tokens without ASCII punctuation at either end; empty ones are left out."""
    strip = lambda w: F.regexp_replace(F.lower(w), r"^\p{Punct}+|\p{Punct}+$", "")
    return F.filter(F.transform(text_tokens, strip), lambda w: w != "")


def prepared(df: DataFrame, text_col: str = "text", sample_bytes: int | None = 10_000) -> DataFrame:
    """df with the shared primitives. sample_bytes: features look at so many leading bytes (None: at the whole text)."""
    d = df.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_r", byte_prefix(F.col("_t"), sample_bytes) if sample_bytes else F.col("_t"))
    d = d.withColumn("_s", unescape_newlines(F.col("_r"))).drop("_t").withColumn("_l", lines(F.col("_s")))
    d = d.withColumn("_t", F.transform(F.col("_l"), trim)).withColumn("_w", tokens(F.col("_s")))
    d = d.withColumn("_ne", F.filter(F.col("_t"), lambda t: t != ""))
    return d.withColumns({"_chars": F.greatest(F.length("_s"), F.lit(1)).cast("double"), "_n": F.greatest(F.size("_l"), F.lit(1)), "_m": F.greatest(F.size("_ne"), F.lit(1))})


PRIMITIVES = ["_s", "_r", "_l", "_t", "_ne", "_w", "_chars", "_n", "_m"]


def with_features(df: DataFrame, text_col: str = "text", names: Iterable[str] | None = None, sample_bytes: int | None = 10_000, wordlist: Iterable[str] | None = None, line_count: bool = True) -> DataFrame:
    """df plus the named features (all by default) as floats, and line_count.

    wordlist: the words of dictionary_word_ratio, a list every worker holds; without it the ratio is 0.
    """
    names = list(FEATURES if names is None else names)
    d = prepared(df, text_col, sample_bytes)
    together = [n for n in names if n in COUNTED]
    if together:
        d = d.withColumn("_counted", counted(together, wordlist)(P.s))
    new = {n: F.when(F.length("_r") == 0, F.lit(0.0)).otherwise(FEATURES[n]()).cast("float") for n in names}
    if line_count:
        new["line_count"] = F.when(F.length("_r") == 0, F.lit(0)).otherwise(P.n)
    return d.withColumns(new).drop(*PRIMITIVES, "_counted")
