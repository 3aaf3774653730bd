"""Synthetic documents, generated on the workers: spark.range plus a seeded generator a row, so that neither partitions nor their order change what comes out.

Every kind is a function of a random.Random that returns a text; `generate` turns any of them into rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NOUNS = "harbour ledger orchard signal valley engine window market bridge record garden station cable river lantern meadow archive kettle".split()
_ADJECTIVES = "quiet early narrow common bright heavy spare distant local hollow".split()
_VERBS = "opened measured carried repaired sorted counted painted followed closed".split()
_FIRST = "Ada Bruno Clara Dario Edda Felix Greta Hanno Iris Jonas".split()


def _word(r: random.Random) -> str:
    return r.choice(_NOUNS)


def _sentence(r: random.Random) -> str:
    return f"The {r.choice(_ADJECTIVES)} {_word(r)} was {r.choice(_VERBS)} by {r.choice(_FIRST)} before the {_word(r)} {r.choice(_VERBS)}."


def fragment(r: random.Random) -> str:
    """Leftovers no one should classify."""
    return r.choice([lambda: "-" * r.randint(3, 30), lambda: str(r.randint(0, 10**6)), lambda: f"({_word(r)})", lambda: " ".join(r.choices("xyz#*·", k=r.randint(2, 9))), lambda: f"page {r.randint(1, 400)}"])()


def noise(r: random.Random) -> str:
    """Recognition errors: confused letters, stray marks, spaced words, wrongly decoded bytes, repeats."""
    confuse, marks = str.maketrans("oliegsb", "01!3956"), "|~^#§¶�"

    def spoil(w: str) -> str:
        k = r.randrange(5)
        return [w.translate(confuse), " ".join(w), w[:2] + r.choice(marks) + w[2:], w.replace("e", "Ã©"), f"{w} {w}"][k]

    return "\n".join(" ".join(spoil(_word(r)) if r.random() < 0.7 else _word(r) for _ in range(r.randint(6, 12))) for _ in range(r.randint(3, 9)))


def form(r: random.Random) -> str:
    """Headings, fields, dotted totals and page numbers of a printed form."""
    out = []
    for page in range(1, r.randint(2, 5)):
        out += [f"{_word(r)} {_word(r)}".upper(), f"{_word(r)}: {r.randint(1, 9999)}   {_word(r)}: {r.choice(_FIRST)}", f"{r.choice(_ADJECTIVES)}-", f"{_word(r)} {'.' * r.randint(4, 20)} {r.randint(1, 9999)}", f"Page {page} of 9"]
    return "\n".join(out)


def letter(r: random.Random) -> str:
    """A letter, a mail or a dialogue."""
    body = " ".join(_sentence(r) for _ in range(r.randint(3, 9)))
    a, b = r.sample(_FIRST, 2)
    return r.choice([f"Dear {a},\n\n{body}\n\nKind regards,\n{b}", f"From: {a}\nTo: {b}\nSubject: {_word(r)}\n\n{body}", "\n".join(f"{r.choice((a, b))}: {_sentence(r)}" for _ in range(r.randint(4, 9)))])


def delimited(r: random.Random) -> str:
    """CSV mostly, else TSV; cells follow their header."""
    kinds = {"id": lambda: str(r.randint(1, 10**5)), "name": lambda: r.choice(_FIRST), "price": lambda: f"{r.uniform(1, 900):.2f}", "date": lambda: f"20{r.randint(10, 25)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", "item": lambda: _word(r), "active": lambda: r.choice(["true", "false"])}
    head = r.sample(list(kinds), r.randint(3, 6))
    sep = "," if r.random() < 0.7 else "\t"
    return "\n".join(sep.join(x) for x in [head] + [[kinds[h]() for h in head] for _ in range(r.randint(5, 80))])


def log(r: random.Random) -> str:
    stamp = lambda: f"20{r.randint(10, 25)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"
    level = lambda: r.choice(["INFO", "WARN", "ERROR", "DEBUG"])
    kind = r.randrange(4)
    line = [
        lambda: f"{stamp()} {level()} [{_word(r)}] {r.choice(_VERBS)} {_word(r)}={r.randint(1, 999)}",
        lambda: f'10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)} - - [{stamp()}] "GET /{_word(r)}/{r.randint(1, 999)} HTTP/1.1" {r.choice([200, 304, 404, 500])} {r.randint(10, 9999)}',
        lambda: f'{{"ts": "{stamp()}", "level": "{level()}", "event": "{_word(r)}"}}',
        lambda: f"{stamp()} [error] {r.randint(100, 999)}#0: {_word(r)} {r.choice(_VERBS)}",
    ][kind]
    return "\n".join(line() for _ in range(r.randint(10, 60)))


def settings(r: random.Random) -> str:
    """INI, properties or XML."""
    value = lambda: r.choice([str(r.randint(1, 9999)), f"/srv/{_word(r)}", _word(r), r.choice(["on", "off"])])
    kind = r.randrange(3)
    if kind == 0:
        return "\n".join(f"[{_word(r)}]\n" + "\n".join(f"{_word(r)}_{i} = {value()}" for i in range(r.randint(3, 6))) for _ in range(r.randint(2, 4)))
    if kind == 1:
        return "\n".join(f"{_word(r)}.{_word(r)}={value()}" for _ in range(r.randint(6, 20)))
    return "<settings>\n" + "\n".join(f"  <{(w := _word(r))}>{value()}</{w}>" for _ in range(r.randint(5, 12))) + "\n</settings>"


def licence(r: random.Random) -> str:
    return (
        f"Copyright (c) {r.randint(1990, 2025)} {r.choice(_FIRST)} {r.choice(_FIRST)}\n\nPermission is granted to use, copy and distribute this {_word(r)}, provided that this notice is kept.\n\n"
        f"The {_word(r)} comes without warranty of any kind; no holder is liable for damages that arise from its use or modification."
    )


#: kind -> (generator, category, sub_type, least length in characters)
KINDS: dict[str, tuple[Callable[[random.Random], str], str, str, int]] = {
    "fragments": (fragment, "artifact", "skip", 0),
    "noise": (noise, "artifact", "ocr_garbage", 50),
    "forms": (form, "artifact", "pdf_dump", 50),
    "letters": (letter, "prose", "plain", 0),
    "delimited": (delimited, "structured", "csv", 50),
    "logs": (log, "structured", "log_lines", 50),
    "settings": (settings, "structured", "ini", 50),
    "licences": (licence, "artifact", "boilerplate", 50),
}


def generate(spark: SparkSession, kind: str, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n rows (id, text, category, sub_type, source) of one kind; too short texts are drawn again."""
    make, category, sub_type, least = KINDS[kind]

    def rows(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                r = random.Random(seed * 2**32 + int(i))
                t = make(r)
                while len(t) < least:
                    t = make(r)
                out.append(t)
            yield pd.DataFrame({"id": b["id"], "text": out})

    d = spark.range(0, n, 1, partitions or max(1, n // 5000)).mapInPandas(rows, "id long, text string")
    sub = F.when(F.contains(F.col("text"), F.lit("\t")), "tsv").otherwise("csv") if kind == "delimited" else F.lit(sub_type)
    return d.select("id", "text", F.lit(category).alias("category"), sub.alias("sub_type"), F.lit(f"generated_{kind}").alias("source"))


def perturbed(df: DataFrame, id_col: str, features: list[str], least: int = 10, most: int = 15, std: float = 0.05, seed: int = 42) -> DataFrame:
    """Copies of feature rows with Gaussian noise: `least` to `most` of each, values at least 0, four decimals. The noise is a function of (seed, id, copy, feature)."""
    n = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(most - least + 1)) + least
    d = df.withColumn("copy", F.explode(F.sequence(F.lit(1), n.cast("int"))))

    def uniform(*key) -> "F.Column":
        return (F.pmod(F.xxhash64(F.lit(seed), id_col, "copy", *map(F.lit, key)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)

    # Box and Muller
    gauss = {f: F.sqrt(-2 * F.log(uniform(f, 1))) * F.cos(2 * 3.141592653589793 * uniform(f, 2)) for f in features}
    return d.withColumns({f: F.greatest(F.lit(0.0), F.round(F.col(f).cast("double") + std * gauss[f], 4)) for f in features})


def weighted_choice(weights: dict[str, float], id_col: str, seed: int = 42):
    """A choice per row by hash, with the given weights (normalised)."""
    total, low = sum(weights.values()), 0.0
    u = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 40)) / float(1 << 40)
    out = None
    for name, w in weights.items():
        low += w / total
        out = F.when(u < low, name) if out is None else out.when(u < low, name)
    return out.otherwise(list(weights)[-1])
