"""Template residue, filler, failed-page messages and demands for scripts.

Learning is from positive and unlabelled records. A record is cut into passages (sentences, and the surroundings of
each slot a template may have left). Some passages are trusted: they match one of a few plain seed patterns in a place
where they can't be quoted. A naive Bayes model of words and word pairs starts from these against all others and is
refined by expectation-maximization until the expected share of residue is settled: the unlabelled passages enter both
classes by their posterior, trusted ones stay. Then the model scores every passage, trusted or not, and a record is a
case if one of its passages is: what is trusted only starts the learning and decides nothing.

In long paragraphs, where a message may only be quoted, quoted words are features of their own, and the model decides on
each sentence as on other passages. So it does in records most of whose lines are shaped like program text, log records,
settings or table rows, with a mark of their own on slots. For learning such sentences count among the others; entering
both classes by their posterior, they would draw junk of numbers and letters after them. Seeds are not tried on them;
dummy Latin is. The shaped lines themselves are no content of their own and no passages: code that holds a template and
logs that record an error are no cases.

Features are hashed to 2 ** FEATURE_BITS numbers, so the model and all counts that reach the driver are bounded; counts
and posteriors are over all records. The hashed passages are written once to the shared folder and read once a step.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.functions.words import mix64
from prosewright.session import stored

FEATURE_BITS = 18
_MASK = (1 << FEATURE_BITS) - 1

_NAME = r"[^\W\d_][\w .|#/?:'-]{0,38}"
#: What a template leaves where a value should be. The first group's delimiters are doubled or paired oddly, so that they hardly occur otherwise.
SLOT_SURE = rf"\{{\{{[ #/]{{0,2}}{_NAME}\}}\}}|<%=? {{0,2}}{_NAME}%>|%%{_NAME}%%|@@{_NAME}@@|\[\[ ?{_NAME}\]\]|«{_NAME}»|\$\{{{_NAME}\}}|%\({_NAME}\)s|__[^\W\d_][\w. ]*?[^\W_]__"
SLOT_MAYBE = rf"\{{(?:\d|{_NAME})\}}|<[^\W\d_][\w .]{{1,38}}>|\[[^\W\d_][\w .]{{1,38}}\]|#[^\W\d_][^\W\d]{{1,38}}#|#[^\W\d_][^\W\d_ ]*(?: [^\W\d_]+){{0,4}}#|\$[A-Z][A-Z_]+\$"
_SLOT = re.compile(rf"(?P<sure>{SLOT_SURE})|(?P<maybe>{SLOT_MAYBE})")

_SURE = re.compile(SLOT_SURE)
_SLOT_START = re.compile(r"[{%@\[«$<#]|__")

#: How a line of program text, a log record, a setting or a table row begins, or is as a whole; what one holds; an option.
_SHAPED_START = re.compile(
    r"\s*(?:#!|//|--|/\*|@\w|\}|\)|\]|\"{3}|'{3}|\"[^\"]*\"\s*(?:[:,\]}]|$)|'[^']*'\s*(?:[:,\]}]|$)|def \w+\(|class \w+[:({]|import [\w.]+|from [\w.]+ import|(?:const|let|var) \w+ ?=|function\b.*\(|return\b.*[;({]|export |elif |else:|echo "
    r"|\[?\d{4}-\d\d-\d\d|\d{1,3}(?:\.\d{1,3}){3}\b|\d\d:\d\d:\d\d|[\w.-]+\s*[:=]\s*[^\s]|\w+\s+\w+: [^.]*$|\[\w+\]\s*$|[-*•] \w+$)"
)
_SHAPED_INSIDE = re.compile(r"[;{}\\]\s*$|\w[(\[]|[=-]>|[=!]=|&&|\|\||\"\$|;\s*(?:do|then|done|fi)\b|\t|\|.*\|.*\||\.{4}")
_OPTION = re.compile(r"(?:^|\s)--?[A-Za-z]{1,2}\s")
_SENTENCE = re.compile(r"(?<=[.!?…:])\s+|\n+")
_TOKEN = re.compile(r"[^\W_]++(?:[_-][^\W_]++)*+|§\w+|©")

#: The tokens of a long paragraph, with quotation marks and the ends of its sentences (as _SENTENCE has them, hard-wrapped lines joined).
_LONG_TOKEN = re.compile(_TOKEN.pattern + r"|[\"“”«»„]|[.!?…:](?=\s)|\n(?![ \t]*[^\W\d_A-Z])")

#: Seeds: how a sentence of a short paragraph opens, or what it holds.
SEEDS = re.compile(
    r"^\W*(?:(?:http|error|status|erreur|fehler)\b[\w ]{0,12}\b[45]\d\d\b|[45]\d\d\b[ -]*(?:not found|page missing|forbidden|bad (?:request|gateway)|server fault|internal server error|unavailable|slow down|unauthorized|request timeout|gateway timeout)"
    r"|access denied|your session has expired|service temporarily unavailable|this site can't be reached|your text goes here|(?:this is )?placeholder (?:copy|text)|sample text\b|content to come|to ?do:? write|click here to add|(?:heading|body copy|text|title) goes here"
    r"|too many requests|rate limit|hier (?:steht|folgt|kommt) (?:später|noch|bald|demnächst)|texte provisoire|texto de relleno|platzhaltertext|blah blah|x{3,} x{3,}|lorem ipsum|oops\b|(?:we're |we are )?sorry\b.*\b(?:available|found|error)|(?:something went wrong|an error occurred)|verify (?:that )?you are human|(?:the )?(?:requested )?(?:page|url|resource)\b.*\b(?:could not be found|was not found|does not exist|has moved)"
    r"|(?:die |diese )?(?:angeforderte )?seite\b.*\b(?:nicht gefunden|nicht (?:mehr )?(?:verfügbar|vorhanden)|existiert nicht)|(?:la |cette )?page\b.*\b(?:introuvable|n['’]existe (?:pas|plus)|n['’]a pas été trouvée)"
    r"|(?:la |esta )?p[aá]gina\b.*\b(?:no existe|no (?:fue |se ha )?encontrada|no se (?:encuentra|encontró|pudo encontrar)))"
    r"|(?=.*\b(?:javascript|scripts?|scripting|cookies)\b)(?=.*\b(?:enable|activate|allow|requires?|needs?|needed|must|turn(?:ed)? (?:it )?o[nf]f?|switch(?:ed)? (?:it )?on|disabled|blocks?|depends|without|aktivieren|activer|active|activar|habilite)\b)",
    re.I | re.S,
)
#: Inner text of a slot that only a template would hold.
SLOT_TEXT = re.compile(r"\b(?:insert|your|add|enter|choose|to come|goes? here|company name)\b|^\W*\w+[_.]\w+\W*$|^\d$", re.I)
#: Words of dummy Latin; a passage of four and more of them, and of hardly anything else, is filler.
DUMMY = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua".split())

#: Marks of passages: trusted; beside a trusted one in a tiny record; in another tiny record; a sentence of a long
#: paragraph or a passage of a shaped record, which is scored but never teaches what residue is.
TRUSTED, MATE, TINY_ROW, LONG = 1, 2, 3, 4

_CODES: dict[str, int] = {}
#: Codes of a sentence's end and of a quotation mark, and what makes a word's code that of the word quoted.
_BREAK, _QUOTE, _QUOTED = -1, zlib.crc32("§q".encode()), zlib.crc32("§quoted".encode())
_DUMMY_CODES = frozenset(zlib.crc32(w.encode()) for w in DUMMY)


def _code(token: str) -> int:
    c = _CODES.get(token)
    if c is None:
        if len(_CODES) > 400_000:
            _CODES.clear()
        t = token.lower()
        if t in ".!?…:\n":
            c = _CODES[token] = _BREAK
            return c
        if t in "\"“”«»„":
            t = "§q"
        if t[0].isdigit():
            t = t if len(t) == 3 and t[0] in "45" else "§n"
        elif "_" in t or (any(ch.isdigit() for ch in t) and t[0] != "§"):
            t = "§id"
        c = _CODES[token] = 0 if t in ("§n", "§id") else zlib.crc32(t.encode("utf-8", "surrogatepass"))
    return c


#: What most of those forms hold, and how lines begin that hold none of it.
_MARK = re.compile(r"[;{}\\()\[\]=<>|&$\t@/*:_]|\.{4}")
_UNMARKED_START = re.compile(r"\s*(?:#!|--|\"{3}|'{3}|\"[^\"]*\"\s*(?:,|$)|'[^']*'\s*(?:,|$)|import [\w.]+|from [\w.]+ import|export |elif |echo |\d{4}-\d\d-\d\d|\d{1,3}(?:\.\d{1,3}){3}\b|[-•] \w+$)")


def shaped_lines(lines: list[str], slots: bool) -> list[bool]:
    """Per line: is it shaped like program text, a log record, a setting or a table row? Slots don't count as shape."""
    marked, start, inside, unmarked, option = _MARK.search, _SHAPED_START.match, _SHAPED_INSIDE.search, _UNMARKED_START.match, _OPTION.search
    if slots:
        lines = [_SLOT.sub("x", x) for x in lines]
    return [bool((start(x) or inside(x) if marked(x) else unmarked(x)) or ("-" in x and option(x))) for x in lines]


_WORD = re.compile(r"[^\W_]+")
_WRAPPED = re.compile(r"(?<=[^\s.!?:…])[ \t]*\n[ \t]*(?=[^\W\d_A-Z])")
SHORT = 30  # words of a short paragraph
TINY = 60  # words of a record that may be nothing but a message; only for the first step of learning


def passages(text: str) -> list[tuple[str, str]]:
    """(kind, passage) of a record: 'o' a long paragraph (or any of a record of shaped lines), 'p' a sentence of a short one, 'w' a slot with its surroundings ('w+': of a form or text that is no chance; 's': in a record of shaped lines)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    slots = bool(_SLOT_START.search(text)) and bool(_SLOT.search(text))
    shaped = shaped_lines(lines, slots)
    full = [i for i, x in enumerate(lines) if x.strip()]
    n_shaped = sum(shaped[i] for i in full)
    mostly = len(full) >= 4 and n_shaped >= 0.5 * len(full)
    if mostly and slots:  # what may be a slot elsewhere is a header or an index here
        shaped = shaped_lines([_SURE.sub("x", x) for x in lines], False)
    plain = "\n".join("" if s else x for x, s in zip(lines, shaped)) if n_shaped else text
    out = []
    if slots:
        for m in _SLOT.finditer(plain):
            before, after = plain[max(0, m.start() - 60) : m.start()], plain[m.end() : m.end() + 60]
            if after[:1] == "(":
                continue
            a, b = _SLOT.sub(" §x ", before).split()[-2:], _SLOT.sub(" §x ", after).split()[:2]
            edge = ("§bol" if not before.strip(" ") or before.rstrip(" ").endswith("\n") else "") + " " + ("§eol" if not after.strip(" ") or after.lstrip(" ").startswith("\n") else "")
            inner = " ".join("§i" + x for x in _WORD.findall(m.group().replace("_", " ")))
            sure = m.group("sure") or SLOT_TEXT.search(m.group()[1:-1])
            kind = "§sure" if m.group("sure") else "§maybe" + re.sub(r"[\w .]+", "", m.group()).encode().hex()
            near = [" ".join(x if x == "§x" else "§w" + "".join(_WORD.findall(x)) for x in side) for side in (a, b)]  # words of a slot's surroundings tell nothing of sentences
            out.append(("s" if mostly else "w+" if sure else "w", f"{near[0]} {kind} {inner} {near[1]} {edge}{' §code' * mostly}"))
        plain = _SLOT.sub(" ", plain)
    for block in re.split(r"\n[ \t]*\n", plain):
        if not block.strip():
            continue
        if mostly or len(block) > 12 * SHORT or len(_WORD.findall(block)) > SHORT:
            out.append(("o", block))
        else:
            out += [("p", x) for x in _SENTENCE.split(_WRAPPED.sub(" ", block)) if x.strip()]
    return out


def is_filler(dummy: int, words: int) -> bool:
    return dummy >= 4 or (dummy >= 2 and 2 * dummy >= words)


def _coded(tokens: list[str]) -> list[int]:
    try:
        return [_CODES[x] for x in tokens]
    except KeyError:
        get = _CODES.get
        return [_code(x) if c is None else c for x in tokens for c in (get(x),)]


def _long_sentences(block: str):
    """(codes, mark, words) of each sentence of a long paragraph."""
    codes = _coded(_LONG_TOKEN.findall(block))
    codes.append(_BREAK)
    plain = codes
    maybe = not _DUMMY_CODES.isdisjoint(codes)
    if _QUOTE in codes:
        plain, marks = codes.copy(), [k for k, c in enumerate(codes) if c == _QUOTE]
        for a, b in zip(marks[::2], marks[1::2]):
            codes[a + 1 : b] = [c ^ _QUOTED if c > 0 else c for c in codes[a + 1 : b]]
    start, last = 0, len(codes)
    while start < last:
        end = codes.index(_BREAK, start)
        if end > start:
            s = codes[start:end]
            quotes = s.count(_QUOTE)
            named = len(s) - quotes - s.count(0)
            if len(s) > quotes:
                filler = maybe and is_filler(sum(c in _DUMMY_CODES for c in plain[start:end]), named)
                yield s, TRUSTED if filler else LONG, len(s) - quotes
        start = end + 1


def trusted(kind: str, passage: str) -> bool:
    """Is the passage a sure positive? Slots no text has by chance, dummy Latin, and seed phrases in short paragraphs."""
    if kind == "w+":
        return True
    if kind in "ws":
        return False
    ws = [w.lower() for w in re.findall(r"[^\W\d_]+", passage)]
    if is_filler(sum(w in DUMMY for w in ws), len(ws)):
        return True
    return kind == "p" and len(ws) <= 20 and bool(SEEDS.search(passage.strip()))


def _features(batch_id: pa.Array, texts: list[str | None]) -> tuple:
    """Passages of a batch: (row of the record, trusted, lengths, features)."""
    row, trust, flat, length = [], [], [], []
    find = _TOKEN.findall
    for i, t in enumerate(texts):
        if not t or not t.strip():
            continue
        at, words_ = len(row), 0
        for kind, p in passages(t):
            if kind == "o":
                for codes, mark, n in _long_sentences(p):
                    flat += codes
                    row.append(i), length.append(len(codes)), trust.append(mark)
                    words_ += n
                continue
            tokens = find(p)
            if not tokens:
                continue
            flat += _coded(tokens)
            row.append(i), length.append(len(tokens))
            trust.append(TRUSTED if trusted(kind, p) else LONG if kind == "s" else 0)
            words_ += len(tokens)
        if words_ <= TINY and len(row) > at:
            mate = MATE if 1 in trust[at:] else TINY_ROW
            trust[at:] = [x or mate for x in trust[at:]]
    codes = np.array(flat, np.uint64)
    n = np.array(length, np.int64)
    ends = np.cumsum(n)
    uni = (mix64(codes + np.uint64(1)) & np.uint64(_MASK)).astype(np.int32)
    uni[codes == 0] = -1  # numbers and identifiers say nothing
    bi = np.full(len(codes), -1, np.int32)
    if len(codes) > 1:
        pair = (mix64(codes[:-1] * np.uint64(0x9E3779B1) + codes[1:]) & np.uint64(_MASK)).astype(np.int32)
        pair[(codes[:-1] == 0) | (codes[1:] == 0)] = -1
        bi[:-1] = pair
        bi[ends - 1] = -1
    return np.array(row, np.int64), np.array(trust, np.int8), n, uni, bi


def _hashed(id_col: str):
    def run(batches):
        for b in batches:
            row, trust, n, uni, bi = _features(b.column(0), b.column(1).to_pylist())
            if not len(row):
                continue
            # unigram and pair stand side by side; a missing pair is -1
            both = np.stack([uni, bi], axis=1).ravel()
            start = np.concatenate([[0], np.cumsum(2 * n)])
            per = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            ends = np.append(per[1:], len(row))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row[per])),
                    pa.array([both[start[i] : start[j]].tobytes() for i, j in zip(per, ends)], pa.binary()),
                    pa.array([n[i:j].astype(np.int32).tobytes() for i, j in zip(per, ends)], pa.binary()),
                    pa.array([trust[i:j].tobytes() for i, j in zip(per, ends)], pa.binary()),
                ],
                names=["id", "features", "lengths", "trusted"],
            )

    return run


def _unpack(b) -> tuple:
    f = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32)
    counts = b.column(2).to_pylist()
    n = np.frombuffer(b"".join(counts), np.int32).astype(np.int64)
    t = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int8)
    rec = np.repeat(np.arange(len(counts)), [len(x) // 4 for x in counts])
    passage = np.repeat(np.arange(len(n)), 2 * n)
    ok = f >= 0
    return f[ok].astype(np.int64), passage[ok], t, rec


def _posterior(weights: np.ndarray, prior: float, f: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """P(residue | passage); unigrams and pairs overlap, so their evidence is halved."""
    if not n:
        return np.empty(0)
    s = np.bincount(passage, weights[f], minlength=n) * 0.5 + prior
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


#: Rows into which a task cuts its sums.
_PIECES = 32


def _counts(model):
    """Sums of features by class over one task, in _PIECES rows: (piece, positive, all)."""

    def run(batches):
        pos, all_ = np.zeros(_MASK + 1), np.zeros(_MASK + 1)
        for b in batches:
            f, passage, t, _ = _unpack(b)
            if model is None:  # tiny records without a seed are left out of both classes at first, their like in others' half
                p, n = np.choose(t, [0.0, 1.0, 0.5, 0.0, 0.0]), (t != TINY_ROW).astype(float)
            else:
                p = _posterior(model.value[0], model.value[1], f, passage, len(t))
                p[t == TRUSTED], p[t == LONG] = 1, 0
                n = np.ones(len(t))
            pos += np.bincount(f, p[passage], minlength=_MASK + 1)
            all_ += np.bincount(f, n[passage], minlength=_MASK + 1)
        yield _sums_batch(range(_PIECES), np.split(pos, _PIECES), np.split(all_, _PIECES))

    return run


def _sums_batch(pieces, pos, all_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([x.tobytes() for x in pos], pa.binary()), pa.array([x.tobytes() for x in all_], pa.binary())], names=["piece", "pos", "n"])


def _added(batches):
    """The sums of each piece over all tasks' rows."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for k, *x in zip(*(c.to_pylist() for c in b.columns)):
            x = [np.frombuffer(y) for y in x]
            held[k] = [a + y for a, y in zip(held[k], x)] if k in held else x
    if held:
        yield _sums_batch(held, [x[0] for x in held.values()], [x[1] for x in held.values()])


def _summed(h: DataFrame, model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of features by class over all records. There are as many rows a piece as tasks, and no more tasks than cores."""
    cores = h.sparkSession.sparkContext.defaultParallelism
    rows = h.coalesce(cores).mapInArrow(_counts(model), _SUMS).repartition(min(cores, _PIECES), "piece").mapInArrow(_added, _SUMS).collect()
    got = {r["piece"]: r for r in rows}
    none = bytes(8 * (_MASK + 1) // _PIECES)
    return tuple(np.frombuffer(b"".join(bytes(got[k][c]) if k in got else none for k in range(_PIECES))) for c in ("pos", "n"))


_SUMS = "piece int, pos binary, n binary"


def _model(pos: np.ndarray, all_: np.ndarray, strength: float, least: float) -> tuple[np.ndarray, float]:
    """Weights and prior from the summed counts. A class's rate is drawn to the feature's rate in all records, by `strength` counts; features seen fewer than `least` times weigh nothing, unless they stand in residue only."""
    P, N = pos.sum(), all_.sum()
    if not P or P >= N:
        return np.zeros(_MASK + 1), -20.0
    base = all_ / N
    neg = all_ - pos
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.log((pos + strength * base) / (P + strength)) - np.log((np.maximum(neg, 0) + strength * base) / (N - P + strength))
    w[((all_ < least) & (neg > 1e-6)) | ~np.isfinite(w)] = 0
    return np.clip(w, -6, 6), float(np.log(P / (N - P)))


def residue_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 1e-3, most_steps: int = 50, strength: float = 30.0, least: float = 3.0) -> DataFrame:
    """(id, score, n_passages): for every record with a passage, the greatest posterior of its passages.

    Learning ends when the log odds of residue among all features move by no more than `tolerance` in a step; if they
    still do after most_steps, that is an error. Null and blank records, and those of shaped lines only, have no passage
    and don't come out; an empty table, or one without a trusted passage, gives scores near 0; rows of a repeated id
    come out each.
    """
    spark = df.sparkSession
    id_type = dict(df.dtypes)[id_col]
    h = stored(df.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(_hashed(id_col), f"id {id_type}, features binary, lengths binary, trusted binary"), "passages")
    model, odds = None, None
    for _ in range(most_steps):
        weights, prior = _model(*_summed(h, model), strength, least)
        model = spark.sparkContext.broadcast((weights, prior))
        if odds is not None and abs(prior - odds) <= tolerance:
            break
        odds = prior
    else:
        raise RuntimeError(f"the share of residue is not settled after {most_steps} steps")

    def score(batches):
        for b in batches:
            f, passage, t, rec = _unpack(b)
            best, n = np.zeros(b.num_rows), np.bincount(rec, minlength=b.num_rows)
            np.maximum.at(best, rec, _posterior(model.value[0], model.value[1], f, passage, len(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(n.astype(np.int32))], names=["id", "score", "n_passages"])

    return h.mapInArrow(score, f"id {id_type}, score double, n_passages int")


def template_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_off: float = 0.5, **kw) -> DataFrame:
    """(id, score): records that hold template residue, filler, a failed page's message or a demand for scripts."""
    return residue_scores(df, id_col, text_col, **kw).where(F.col("score") >= cut_off).select("id", "score").dropDuplicates(["id"])
