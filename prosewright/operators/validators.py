"""Format validators and plausibility heuristics per sub-type, as boolean Columns; null texts give false."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prosewright.functions.textprims import WS, json_value, trim


def _full_lines(text: Column) -> Column:
    return F.filter(F.split(trim(text), "\n"), lambda x: x.rlike(f"[^{WS}]"))


def _delimited(delimiter: str):
    """Quoting rules of delimited text need a real parser: Arrow batches."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        csv.field_size_limit(1 << 30)

        def one(t):
            if t is None:
                return False
            try:
                rows = [r for r in csv.reader(io.StringIO(t), delimiter=delimiter) if r]
            except csv.Error:
                return False
            width = len(rows[0]) if rows else 0
            return len(rows) >= 2 and width >= 2 and all(len(r) == width for r in rows[:20])

        return texts.map(one, na_action=None)

    return run


def is_csv(text: Column) -> Column:
    return _delimited(",")(text)


def is_tsv(text: Column) -> Column:
    return _delimited("\t")(text)


def is_json(text: Column) -> Column:
    return json_value(text).isNotNull()


def is_jsonl(text: Column) -> Column:
    """At least two full lines, the first twenty of them JSON."""
    rows = _full_lines(text)
    return F.coalesce((F.size(rows) >= 2) & F.forall(F.slice(rows, 1, 20), lambda x: json_value(x).isNotNull()), F.lit(False))


def is_pipe_table(text: Column) -> Column:
    """Pipes in at least 70 % of two or more full lines, and at most two different counts of them in the first twenty."""
    rows = _full_lines(text)
    with_pipe = F.filter(rows, lambda x: F.contains(x, F.lit("|")))
    counts = F.array_distinct(F.transform(F.slice(with_pipe, 1, 20), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))))
    return F.coalesce((F.size(rows) >= 2) & (F.size(with_pipe) >= F.size(rows) * 0.7) & (F.size(counts) <= 2), F.lit(False))


def is_fixed_width(text: Column) -> Column:
    """Some position is inside a gap of two or more spaces in each of the first twenty of at least three full lines."""
    rows = _full_lines(text)

    def gaps(line: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(line), F.lit(1)))
        space = lambda i: F.substring(line, i, F.lit(1)) == " "
        return F.filter(at, lambda i: space(i) & (((i > 1) & space(i - 1)) | space(i + 1)))

    head = F.transform(F.slice(rows, 1, 20), gaps)
    common = F.aggregate(F.slice(head, 2, 20), F.get(head, F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return F.coalesce((F.size(rows) >= 3) & (F.size(common) >= 1), F.lit(False))


def _any(text: Column, *parts: str) -> Column:
    hit = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def _share(pattern: str, least: float) -> Callable[[Column], Column]:
    def check(text: Column) -> Column:
        rows = _full_lines(text)
        return (F.size(rows) > 0) & (F.size(F.filter(rows, lambda x: x.rlike(pattern))) / F.greatest(F.size(rows), F.lit(1)) >= least)

    return check


VALIDATORS: dict[str, Callable[[Column], Column]] = {"csv": is_csv, "tsv": is_tsv, "json": is_json, "jsonl": is_jsonl, "pipe_table": is_pipe_table, "fixed_width": is_fixed_width}

# What a text of each sub-type is expected to hold.
HEURISTICS: dict[str, Callable[[Column], Column]] = VALIDATORS | {
    "python": lambda t: _any(t, "def ", "import ", "class ", "print("),
    "javascript": lambda t: _any(t, "function ", "const ", "let ", "=>", "require("),
    "typescript": lambda t: _any(t, "function ", "const ", "let ", "=>", "require("),
    "rust": lambda t: _any(t, "fn ", "let ", "struct ", "impl ", "use "),
    "go": lambda t: _any(t, "func ", "package ", "import ("),
    "java": lambda t: _any(t, "class ", "public ", "private ", "import "),
    "sql": lambda t: _any(F.upper(t), "SELECT", "INSERT", "CREATE", "ALTER"),
    "shell": lambda t: t.startswith("#!/") | _any(t, "if [", "then", "echo ", "fi"),
    "html": lambda t: _any(F.lower(t), "<html", "<div", "<body", "<head"),
    "xml": lambda t: _any(t, "<?xml") | t.rlike(r"(?s)<[a-z]+>.*</[a-z]+>"),
    "css": lambda t: _any(t, "{") & _any(t, "color:", "margin:", "display:", "font-"),
    "yaml": lambda t: t.rlike(r"(?m)^\w[\w\s]*:\s"),
    "toml": lambda t: t.rlike(r"(?m)^\[.+\]") & t.rlike(r"(?m)^\w[\w\s]*=\s"),
    "ini": lambda t: t.rlike(r"(?m)^\[.+\]") & t.rlike(r"(?m)^\w[\w\s]*\s*=\s*"),
    "dockerfile": lambda t: _any(t, "FROM ", "RUN ", "CMD "),
    "makefile": lambda t: t.rlike(r"(?m)^[^\t\n]+:\s*$\n\t"),
    "markdown": lambda t: t.rlike(r"(?m)^#+ ") | _any(t, "**", "```") | t.rlike(r"\[.+?\]\(.+?\)"),
    "rst": lambda t: _any(t, ".. ") | t.rlike(r":[a-z]+:") | t.rlike(r"(?m)^[=\-]{3,}$"),
    "latex": lambda t: _any(t, "\\begin{", "\\end{", "\\section", "\\documentclass"),
    "key_value": _share(r"^\w[\w\s]*\s*[=:]\s*\S", 0.3),
    "log_lines": _share(r"^\d+[\-:T]", 0.3),
}


def plausible(text: Column, sub_type: Column) -> Column:
    """Does a text look like its sub-type? Sub-types without a heuristic always do; null texts never."""
    out = F.lit(True)
    for name, check in HEURISTICS.items():
        out = F.when(sub_type == name, check(text)).otherwise(out)
    return F.coalesce(out & text.isNotNull(), F.lit(False))
