"""Consensus labels from several annotators, weighted by spectral reliability.

Annotators see the label a row already has, and some just keep it. So agreement is centred by chance given that label:
with x = 1 for a vote that keeps it, m an annotator's rate of doing so, and c the chance that two other labels
coincide, two votes a, b contribute

    [same label, not the shown one] - c (1 - m_a)(1 - m_b) + (x_a - m_a)(x_b - m_b).

Its mean over the rows both labelled is about r_a r_b times a constant of the log, r being the chance that an annotator
knows the right label; one who always keeps, or always guesses, agrees with nobody beyond chance. With S the sums and N
the numbers of shared rows of each pair, and D an annotator's shared rows with all others, the leading eigenvector u of
D^-1/2 S D^-1/2 gives r as D^-1/2 u: the overlap correction, as a pair counts by how much it shares. The scale of r
is the one with which the r_a r_b come closest to the means, pairs weighted by N.

S and N are never formed and no pair of votes is emitted: an annotator's product with them is a sum over their votes of
totals per row and per (row, label). Votes are put once into blocks of rows; a power step is one pass over the blocks with
the vector sent to all tasks, and gives a number for each annotator. Steps go on until the vector is settled.

A vote's weight is the log of how much likelier the vote is if its label is right, for an annotator who knows the
label with r, and else keeps the shown one with h or picks any of the labels. Without a shown label all this is the
plain form (m = 0, h = 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions.words import clean_name
from prosewright.session import stored


def vote_label() -> Column:
    """A vote's label: sub_type; if null, original_sub_type where a tier agrees, else new_sub_type."""
    agrees = F.coalesce(F.col("tier1_agrees"), F.lit(False)) | F.coalesce(F.col("tier2_agrees"), F.lit(False))
    given = clean_name("sub_type")
    return F.coalesce(given, F.when(agrees, clean_name("original_sub_type")).otherwise(clean_name("new_sub_type")))


def last_votes(log: DataFrame) -> DataFrame:
    """(row_id, annotator, label, original): the last vote of each annotator on each row that has a label.

    Order: voted_at, then received_at, then vote_id. Votes without a label don't count, nor do those without row or
    annotator. A vote sent twice counts once.
    """
    v = log.select("row_id", clean_name("annotator").alias("annotator"), vote_label().alias("label"), clean_name("original_sub_type").alias("original"), "voted_at", "received_at", "vote_id")
    v = v.where("row_id IS NOT NULL AND annotator IS NOT NULL AND label IS NOT NULL AND label <> ''")
    last = F.max_by(F.struct("label", "original"), F.struct("voted_at", "received_at", "vote_id"))
    return v.groupBy("row_id", "annotator").agg(last.alias("x")).select("row_id", "annotator", "x.label", "x.original")


#: Annotators up to which their table is sent to all tasks; beyond, votes and annotators are shuffled to meet.
BROADCAST_ANNOTATORS = 50_000
#: The vector of a power step has a number for each annotator, on the driver and in every task; more than this are an error.
MOST_ANNOTATORS = 2_000_000


def _with_annotators(votes: DataFrame, table: DataFrame, n: int) -> DataFrame:
    return votes.join(F.broadcast(table) if n <= BROADCAST_ANNOTATORS else table, "annotator")


def _packed(batches):
    """Votes of the rows of a batch, side by side: votes a row, annotator, number of the (row, label) pair, kept."""
    for b in batches:
        lists = b.column(0)
        n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        who, label, kept = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("who", "label", "kept"))
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((label, row))
        new = np.append(True, (row[order][1:] != row[order][:-1]) | (label[order][1:] != label[order][:-1])) if len(order) else np.empty(0, bool)
        pair = np.empty(len(row), np.int32)
        pair[order] = np.cumsum(new) - 1
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (n.astype(np.int32), who.astype(np.int32), pair, kept.astype(np.int8))], names=["n", "who", "pair", "kept"])


def _blocks(batches):
    """(row, annotator, (row, label) pair, kept) of the votes of each block, as arrays."""
    for b in batches:
        for n, who, pair, kept in zip(*(c.to_pylist() for c in b.columns)):
            n = np.frombuffer(n, np.int32)
            yield np.repeat(np.arange(len(n)), n), np.frombuffer(who, np.int32), np.frombuffer(pair, np.int32), np.frombuffer(kept, np.int8).astype(float)


def _products(held, c: float):
    """Per annotator: (S x), (N x^2) and D, summed over one task. held: (x, rate of keeping) of all annotators."""

    def run(batches):
        x, m = held.value
        s, q, d = (np.zeros(len(x)) for _ in range(3))
        for row, who, pair, kept in _blocks(batches):
            if not len(row):
                continue
            own, away, dev = x[who], 1 - m[who], kept - m[who]
            rows, pairs = row[-1] + 1, pair.max() + 1
            u, v = np.bincount(row, own * away, rows), np.bincount(row, own * dev, rows)
            same = (1 - kept) * (np.bincount(pair, own, pairs)[pair] - own)
            s += np.bincount(who, same - c * away * (u[row] - away * own) + dev * (v[row] - dev * own), len(x))
            q += np.bincount(who, np.bincount(row, own * own, rows)[row] - own * own, len(x))
            d += np.bincount(who, np.bincount(row, minlength=rows)[row] - 1, len(x))
        k = np.flatnonzero(d)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(s[k]), pa.array(q[k]), pa.array(d[k])], names=["who", "s", "q", "d"])

    return run


def _weights(r, h, kept, labels: float):
    """The log of how much likelier a vote is if its label is right, by the voter's reliability and habit."""
    guess = (1 - r) * (kept * h + (1 - h) / labels) + 1e-4
    return np.log((r + guess) / guess)


def _changed(held, labels: float, wrong: float):
    """(rows, rows whose consensus isn't the shown label) of one task."""

    def run(batches):
        r, h = held.value
        rows = changed = 0
        for row, who, pair, kept in _blocks(batches):
            if not len(row):
                continue
            score = np.bincount(pair, _weights(r[who], h[who], kept, labels))
            shown, of = np.zeros(len(score)), np.empty(len(score), np.int64)
            shown[pair], of[pair] = kept, row
            if wrong < 1:
                score += shown * np.log((1 - wrong) / (wrong / labels))
            best = np.full(row[-1] + 1, -np.inf)
            np.maximum.at(best, of, score)
            stays = np.bincount(of, (score >= best[of] - 1e-9) * shown) > 0
            rows, changed = rows + len(best), changed + int((~stays).sum())
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([changed])], names=["n", "changed"])

    return run


def _leading(step, people: int, tolerance: float, most: int):
    """(x, S x, N x^2, D) at the leading eigenvector: x = D^-1/2 u. A half of the eigenvalue is added to the diagonal, so that an equally large negative one doesn't keep the steps from settling."""
    x = np.ones(people)
    shift = None
    for _ in range(most):
        s, q, d = step(x)
        live = d > 0
        if not live.any():
            return x, s, q, d
        value = float((x * s).sum() / max((d * x * x).sum(), 1e-300))
        shift = abs(value) / 2
        y = np.where(live, s / np.maximum(d, 1) + shift * x, 0.0)
        size = np.sqrt((d * y * y).sum())
        old = np.sqrt((d * x * x).sum())
        if size == 0:
            return np.zeros(people), s, q, d
        if np.abs(y / size - np.where(live, x, 0) / old).max() <= tolerance * np.abs(y / size).max():
            return x, s, q, d
        x = y / size
    raise RuntimeError(f"reliabilities not settled after {most} power steps")


def trust(votes: DataFrame, tolerance: float = 1e-4, most_steps: int = 500) -> tuple[DataFrame, float]:
    """(annotators, wrong): (annotator, votes, shared, keeps, reliability, habit), and the share of rows whose shown label is wrong.

    reliability: 1 always knows, 0 never; habit: how often one who doesn't know keeps the shown label; shared: pairs of
    votes with others. Who shares no row with others gets 0.5. The eigenvector needs no constant; its scale needs `wrong`,
    which the consensus then gives anew, until it is settled (or comes back to a value it had). `votes` (of last_votes)
    must be cut from its lineage by the caller. An empty log gives an empty table.
    """
    spark = votes.sparkSession
    votes = votes.withColumn("kept", F.coalesce(F.col("label") == F.col("original"), F.lit(False)).cast("int"))
    away = votes.where("kept = 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    c = float(away["nn"]) / float(away["n"]) ** 2 if away["n"] else 0.0
    labels = float(max(2, votes.select("label").distinct().count()))
    each = votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("votes"), F.avg("kept").alias("keeps")).orderBy("annotator").limit(MOST_ANNOTATORS + 1).collect()
    if len(each) > MOST_ANNOTATORS:
        raise ValueError(f"more than {MOST_ANNOTATORS} annotators")
    people, keeps = len(each), np.array([r["keeps"] for r in each], float)
    schema = "annotator string, votes long, shared long, keeps double, reliability double, habit double"
    if not people:
        return spark.createDataFrame([], schema), 0.0
    number = spark.createDataFrame([(r["annotator"], i) for i, r in enumerate(each)], "annotator string, who int")
    rows = _with_annotators(votes, number, people).groupBy("row_id").agg(F.collect_list(F.struct("who", F.xxhash64("label").alias("label"), "kept")).alias("v"))  # a vote for each annotator at most
    blocks = stored(rows.select("v").mapInArrow(_packed, "n binary, who binary, pair binary, kept binary"), "votes")

    def step(x):
        held = spark.sparkContext.broadcast((x, keeps))
        got = blocks.mapInArrow(_products(held, c), "who int, s double, q double, d double").groupBy("who").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("d").alias("d")).toPandas()
        held.destroy()
        out = np.zeros((3, people))
        out[:, got["who"].to_numpy(int)] = got[["s", "q", "d"]].to_numpy(float).T
        return out

    x, s, q, d = _leading(step, people, tolerance, most_steps)
    if x[d > 0].sum() < 0:
        x, s = -x, -s
    wrong, seen = (0.1 if keeps.any() else 1.0), set()
    while True:
        kappa = max(1e-6, wrong * (2 - wrong) - c * wrong * wrong)
        much = float((x * s).sum()), float((x * x * q).sum()) * kappa
        scale = np.sqrt(max(0.0, much[0]) / much[1]) if much[1] > 0 else 0.0
        r = np.where(d > 0, np.clip(x * scale, 0.001, 0.99), 0.5)
        h = np.clip((keeps - r * (1 - wrong)) / (1 - r), 0, 1)
        held = spark.sparkContext.broadcast((r, h))
        n = blocks.mapInArrow(_changed(held, labels, wrong), "n long, changed long").agg(F.sum("n").alias("n"), F.sum("changed").alias("changed")).first()
        found = min(1.0, max(0.002, n["changed"] / n["n"]))
        if abs(found - wrong) < 0.0005 or found in seen:
            break
        seen.add(found)
        wrong = found
    out = [(e["annotator"], e["votes"], int(k), e["keeps"], float(a), float(b)) for e, k, a, b in zip(each, d, r, h)]
    return spark.createDataFrame(out, schema), wrong


def reliability(votes: DataFrame, **kw) -> DataFrame:
    """The annotators of `trust`."""
    return trust(votes, **kw)[0]


def consensus(votes: DataFrame, annotators: DataFrame, labels: int, wrong: float | None = None) -> DataFrame:
    """(row_id, label, agreement, confidence, n_votes, original): the label the weighted votes show, for each row with a vote.

    agreement: share of the row's votes for it; confidence: its posterior among the labels voted for. `wrong`, the
    share of shown labels expected to be wrong, is the prior for keeping; null leaves it out. Ties go to the label with
    more votes, then to the first in order.
    """
    k = float(max(2, labels))
    people = annotators.select("annotator", "reliability", "habit")
    v = _with_annotators(votes, people, people.limit(BROADCAST_ANNOTATORS + 1).count())
    kept = F.coalesce(F.col("label") == F.col("original"), F.lit(False))
    guess = (1 - F.col("reliability")) * (F.when(kept, F.col("habit")).otherwise(F.lit(0.0)) + (1 - F.col("habit")) / k) + F.lit(1e-4)
    v = v.withColumn("w", F.log((F.col("reliability") + guess) / guess))
    per = v.groupBy("row_id", "label").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("original").alias("original"))
    if wrong is not None and wrong < 1:
        per = per.withColumn("w", F.col("w") + F.when(F.col("label") == F.col("original"), F.log(F.lit((1 - wrong) / (wrong / k)))).otherwise(F.lit(0.0)))
    row = per.groupBy("row_id").agg(F.collect_list(F.struct("label", "w", "n")).alias("all"), F.sum("n").alias("n_votes"), F.max("original").alias("original"))
    best = F.array_sort(F.col("all"), lambda a, b: F.when(F.abs(a.w - b.w) > 1e-9, F.signum(b.w - a.w).cast("int")).when(a.n != b.n, F.signum(b.n - a.n).cast("int")).when(a.label < b.label, -1).when(a.label > b.label, 1).otherwise(0))[0]
    row = row.withColumn("t", best)
    odds = F.aggregate(F.col("all"), F.lit(0.0), lambda acc, x: acc + F.exp(x.w - F.col("t.w")))
    return row.select("row_id", F.col("t.label").alias("label"), (F.col("t.n") / F.col("n_votes")).alias("agreement"), (1 / odds).alias("confidence"), "n_votes", "original")
