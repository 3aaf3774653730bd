"""Text primitives as Column expressions: sample, lines, tokens, trims. Everything stays in the JVM.

White space is Unicode White_Space; "bytes" are UTF-8; a line ends at `\\n`, a `\\r` before it belongs to the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
ALNUM = r"\p{IsAlphabetic}\p{N}"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+$", "")


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+", "")


def byte_prefix(text: Column, n: int) -> Column:
    """The first n bytes, cut back to the end of a character."""
    raw = text.cast("binary")
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(4)])


def unescape_newlines(text: Column) -> Column:
    """The two characters backslash and n stand for a line end in texts from JSON or CSV payloads."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def lines(text: Column) -> Column:
    parts = F.split(text, r"\r?\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(text, rf"{WS}+"), lambda x: x != "")


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a fixed string that don't overlap."""
    n = len(needle)
    gone = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return gone if n == 1 else (gone / n).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def json_value(text: Column) -> Column:
    """The JSON value a text is, as VARIANT; null where it is none or more than one.

    The parser stops behind the first value, so the text is read as the one item of an array and of an object: whatever
    closes the one early is an error in the other.
    """
    item = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.when(alone & (F.size(item) == 1), F.get(item, F.lit(0)))
