"""Parsing of noisy annotator replies into labels, as Columns; the few that need real recursion are Arrow UDFs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from prosewright.functions.labels import VALID_SUB_TYPES
from prosewright.functions.textprims import trim

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"


def unfenced(reply: Column) -> Column:
    """The inside of the first code fence, or the trimmed reply."""
    inside = F.regexp_extract(reply, FENCE, 1)
    return F.when(reply.rlike(FENCE), trim(inside)).otherwise(trim(reply))


def flags(reply: Column, labels: list[str]) -> Column:
    """Map of label to 0/1 from a JSON object in a reply: whole, fenced, or the first braces; missing and odd values are 0."""
    body = unfenced(reply)
    v = F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)\{[^{}]*\}", 0)))

    def one(label: str) -> Column:
        n = F.try_variant_get(v, f"$['{label}']", "double")
        return F.when(F.coalesce(F.floor(F.abs(n)) * F.signum(n), F.lit(0.0)) > 0, 1).otherwise(0)

    return F.create_map(*[x for label in labels for x in (F.lit(label), one(label))])


def reply_category(reply: Column) -> Column:
    """First of prose, code, structured that a reply names; else unknown."""
    t = F.lower(trim(reply))
    return F.coalesce(F.when(F.contains(t, F.lit("prose")), "prose").when(F.contains(t, F.lit("code")), "code").when(F.contains(t, F.lit("structured")), "structured"), F.lit("unknown"))


def reply_sub_type(reply: Column, valid: list[str] | None = None) -> Column:
    """A valid sub-type from a reply: the bare (perhaps quoted) label, else the longest one it holds, equally long ones in alphabetical order; null if none."""
    valid = VALID_SUB_TYPES if valid is None else valid
    bare = F.regexp_replace(trim(reply), r"^[\"']+|[\"']+$", "")
    out = F.when(trim(bare).isin(*valid), trim(bare))
    for s in sorted(valid, key=lambda s: (-len(s), s)):
        out = out.when(F.contains(reply, F.lit(s)), s)
    return out


def reply_voter_label(reply: Column) -> Column:
    """c_cpp, objc, prose or other; the first of them found, in this order, where the reply says more."""
    t = F.lower(trim(reply))
    labels = ["c_cpp", "objc", "prose", "other"]
    out = F.when(t.isin(*labels), t)
    for s in labels:
        out = out.when(F.contains(t, F.lit(s)), s)
    return out.otherwise("other")


def canonical_vote(label: Column) -> Column:
    return F.when(label == "prose_plain", "prose").when(label == "other", "unknown").otherwise(label)


# Signs of languages and licences.
_OBJC = r"@interface|@implementation|@property|@protocol|@synthesize|@class"
_PREPROCESSOR = r"#include|#define|#ifndef"
_FUNCTION = r"\b(?:int|void|char|float|double|long|unsigned|signed|short|size_t|bool)\s+\w+\s*\("
_STRUCT = r"\bstruct\s+\w+"
_C_ONLY = r"\*\w|\w\*|typedef\b|enum\s+\w+\s*\{|enum\s*\{|NULL\b|nullptr\b"
_LICENCE = r"(?i)permission|license|granted|warranty|copyright|distribute|sublicense|merchantability|liability|damages|software|modification|restriction"


def heuristic_vote(text: Column) -> Column:
    """A vote from plain signs: objc, c_cpp, prose_plain (licences) or drop."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    licence = F.regexp_count(text, F.lit(_LICENCE)) / F.greatest(words, F.lit(1)) > 0.10
    braces = F.regexp_count(text, F.lit("[{};]")) >= 3
    return (
        F.when(F.coalesce(~text.rlike(r"\S"), F.lit(True)), "drop")
        .when(text.rlike(_OBJC), "objc")
        .when(text.rlike(_PREPROCESSOR) | text.rlike(_FUNCTION) | text.rlike(_STRUCT), "c_cpp")
        .when(licence, "prose_plain")
        .when(braces & text.rlike(_C_ONLY), "c_cpp")
        .otherwise("drop")
    )


def _recovered(reply: str | None) -> list[str]:
    """Items of a JSON array in a reply: whole, fenced, between the outer brackets, or object by object."""
    import re

    if not reply:
        return []
    m = re.search(FENCE, reply)
    body = (m.group(1) if m else reply).strip()
    a, b = body.find("["), body.rfind("]")
    for part in (body, body[a : b + 1] if 0 <= a < b else ""):
        try:
            v = json.loads(part)
        except ValueError:
            continue
        if isinstance(v, dict) and "text" in v:
            v = [v]
        if isinstance(v, list):
            return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in v]
    out, decoder, i = [], json.JSONDecoder(), 0
    while (i := body.find("{", i)) >= 0:
        try:
            v, end = decoder.raw_decode(body, i)
            out.append(json.dumps(v, ensure_ascii=False))
            i = end
        except ValueError:
            i += 1
    return out


@F.pandas_udf(ArrayType(StringType()))
def array_items(replies: pd.Series) -> pd.Series:
    """JSON items of noisy replies; texts stay as they are, other items as JSON."""
    return replies.map(_recovered, na_action=None)


def preview(text: Column, n: int = 150) -> Column:
    """The first n characters on one line."""
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit("\\n"))


def prompt(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns; null values become empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def one_section(text: Column, seed: int = 42, least: int = 50) -> Column:
    """One of a text's paragraphs of at least `least` characters, chosen by hash of the text; null if there is none."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), trim), lambda x: F.length(x) >= least)
    return F.get(parts, F.pmod(F.xxhash64(F.lit(seed), text), F.greatest(F.size(parts), F.lit(1)).cast("long")).cast("int"))
