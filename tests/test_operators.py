"""Validators, parsing, voting, metrics, sampling, dedup, components, ranking."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosewright.operators import components, dedup, filters, metrics, parsing, ranking, sampling, validators, voting


def flags(spark, check, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in d.orderBy("i").select(check(F.col("t"))).collect()]


def test_validators(spark):
    assert flags(spark, validators.is_csv, 'a,b\n1,"x,\ny"\n', "a,b\n1", "a\nb", None, "") == [True, False, False, False, False]
    assert flags(spark, validators.is_tsv, "a\tb\n1\t2", "a,b\n1,2") == [True, False]
    assert flags(spark, validators.is_json, '{"a": [1]}', "[1", None) == [True, False, False]
    assert flags(spark, validators.is_jsonl, '{"a":1}\n{"b":2}', '{"a":1}', '{"a":1}\nx') == [True, False, False]
    assert flags(spark, validators.is_pipe_table, "|a|b|\n|-|-|\n|1|2|", "a|b\nc\nd", "|a|") == [True, False, False]
    assert flags(spark, validators.is_fixed_width, "aa   bb\ncc   dd\nee   ff", "aa  bb\ncccc dd\nee f", "a  b") == [True, False, False]


def test_plausible(spark):
    d = spark.createDataFrame([("def f(): pass", "python"), ("hello", "python"), ("x", "no_such"), (None, "plain")], "t string, s string")
    assert [r[0] for r in d.select(validators.plausible(F.col("t"), F.col("s"))).collect()] == [True, False, True, False]


def test_reply_parsing(spark):
    d = spark.createDataFrame([('```json\n{"a": 2, "b": "0"}\n```',), ('sure: {"a": 1} ok',), ("none",), ('{"a": -3, "b": 1.5}',), (None,)], "r string")
    got = [r[0] for r in d.select(parsing.flags(F.col("r"), ["a", "b"])).collect()]
    assert got == [{"a": 1, "b": 0}, {"a": 1, "b": 0}, {"a": 0, "b": 0}, {"a": 0, "b": 1}, {"a": 0, "b": 0}]
    d = spark.createDataFrame([('"jsonl"',), ("It is a pipe_table",), ("json or jsonl",), ("nope",)], "r string")
    assert [r[0] for r in d.select(parsing.reply_sub_type(F.col("r"))).collect()] == ["jsonl", "pipe_table", "jsonl", None]
    d = spark.createDataFrame([('[{"a": 1}, "x"]',), ('```\n["p"]\n```',), ('text {"a": 1} and {"b": 2',), (None,)], "r string")
    assert [r[0] for r in d.select(parsing.array_items(F.col("r"))).collect()] == [['{"a": 1}', "x"], ["p"], ['{"a": 1}'], []]


def test_heuristic_vote(spark):
    assert flags(spark, parsing.heuristic_vote, "@interface A", "#include <a>", "permission granted license warranty", "x{;} *p;", "hello there you", " ", None) == ["objc", "c_cpp", "prose_plain", "c_cpp", "drop", "drop", "drop"]


def test_tiered_decision(spark):
    rows = [(True, None, None), (False, None, None), (False, True, None), (False, False, "csv"), (False, False, "nope"), (False, False, None), (True, False, "csv")]
    d = spark.createDataFrame(rows, "a boolean, b boolean, r string")
    x = voting.tiered_decision(F.col("a"), F.col("b"), F.col("r"))
    assert [tuple(r) for r in d.select(x["action"], x["new_sub_type"]).collect()] == [("keep", None), ("drop", None), ("keep", None), ("relabel", "csv"), ("drop", None), ("drop", None), ("keep", None)]


def test_votes(spark):
    d = spark.createDataFrame([("a", "a", "a"), ("a", "a", "b"), ("a", "b", "a"), ("b", "a", "a"), ("a", "b", "c"), (None, None, "c")], "a string, b string, c string")
    x = voting.vote3(F.col("a"), F.col("b"), F.col("c"))
    assert [tuple(r) for r in d.select(x["label"], x["method"]).collect()] == [("a", "unanimous"), ("a", "majority"), ("a", "majority"), ("a", "majority"), ("manual_review", "tie"), ("manual_review", "tie")]
    d = spark.createDataFrame([("a", "a", "a", "b"), ("a", "b", "b", "b"), ("a", "a", "b", "b"), ("a", "b", "b", "c"), ("a", "b", "c", "d")], "a string, b string, c string, d string")
    y = voting.vote4(*map(F.col, "abcd"))
    assert [tuple(r) for r in d.select(y["verdict"], y["winner"]).collect()] == [("KEEP_LABEL", "a"), ("FIX_LABEL", "b"), ("TIE", "a"), ("FIX_LABEL", "b"), ("KEEP_LABEL", "a")]


def test_apply_voted(spark):
    d = spark.createDataFrame([(1, "unknown", "unknown"), (2, "unknown", "unknown"), (3, "code", "go"), (4, "unknown", "unknown")], "id int, category string, sub_type string")
    v = spark.createDataFrame([(1, "prose_plain"), (2, "drop"), (4, "manual_review")], "id int, label string")
    assert {tuple(r) for r in voting.apply_voted(d, v, "id").collect()} == {(1, "prose", "plain"), (3, "code", "go"), (4, "unknown", "unknown")}


def test_metrics(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a")], "t string, p string")
    m = {r["label"]: r for r in metrics.per_category(d, "t", "p").collect()}
    assert (m["a"]["precision"], m["a"]["recall"], m["a"]["support"]) == (pytest.approx(1 / 3), 0.5, 2)
    assert (m["c"]["precision"], m["c"]["recall"], m["c"]["f1"]) == (0, 0, 0)
    assert metrics.accuracy(d.limit(0), "t", "p").first()["accuracy"] == 0.0
    assert {(r["actual"], r["predicted"], r["n"]) for r in metrics.confusion(d, "t", "p").collect()} == {("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("c", "a", 1)}


def test_agreement_and_gate(spark):
    v = spark.createDataFrame([(1, "x", "l", 1), (1, "y", "l", 1), (1, "z", "l", 0), (2, "x", "l", 0), (2, "y", "l", 0), (2, "z", "l", 0)], "k int, a string, label string, flag int")
    r = metrics.annotator_agreement(v, "k", "label", "flag").first()
    assert (r["mean_agreement"], r["unanimous_rate"], r["split_rate"]) == (pytest.approx(5 / 6), 0.5, 0.5)
    inj = spark.createDataFrame([(1, "x", "inject_diff_patch", "diff_patch", 1), (1, "y", "inject_diff_patch", "diff_patch", 1), (2, "x", "inject_diff_patch", "diff_patch", 1)], "k int, a string, audit_source string, label string, flag int")
    rec = {x["label"]: x["recall"] for x in metrics.injected_recall(inj, "k").collect()}
    assert rec == {"diff_patch": 0.5, "log_content": None, "stack_trace": None}
    agree = spark.createDataFrame([("diff_patch", float("nan"))], "label string, mean_agreement double")
    ok = {x["label"]: x["passes"] for x in metrics.gate(agree, spark.createDataFrame([("diff_patch", 0.95), ("log_content", None)], "label string, recall double")).collect()}
    assert ok == {"diff_patch": True, "log_content": False}


def test_stratified_takes_models_in_turn(spark):
    d = spark.createDataFrame([(i, "g", "m1" if i < 8 else "m2") for i in range(10)], "id int, g string, model string")
    got = sampling.stratified(d, "g", 4, "id").collect()
    assert sorted(r["model"] for r in got) == ["m1", "m1", "m2", "m2"]
    assert {r["id"] for r in got} | {r["id"] for r in sampling.stratified(d, "g", 4, "id", remainder=True).collect()} == set(range(10))
    assert sampling.stratified(d.repartition(3), "g", 4, "id").exceptAll(sampling.stratified(d, "g", 4, "id")).isEmpty()


def test_floor_allocation(spark):
    c = spark.createDataFrame([("a", 1000), ("b", 10), ("c", None)], "g string, n_rows long").fillna(5)
    a = {r["g"]: r["alloc"] for r in sampling.floor_allocation(c, "g", 100, 20).collect()}
    assert a["b"] == 10 and a["c"] == 5 and 20 < a["a"] <= 85


def test_grouped_split_keeps_groups(spark):
    d = spark.createDataFrame([(i, f"s{i % 10}", "x") for i in range(200)], "id int, g string, y string")
    s = sampling.grouped_split(d, "g", "y")
    assert s.groupBy("g").agg(F.count_distinct("split").alias("k")).where("k > 1").isEmpty()
    assert s.where("split = 'validation'").count() == 40
    assert sampling.grouped_split(d.withColumn("g", F.lit("one")), "g", "y") is None


def test_grouped_split_is_the_closest_of_all(spark):
    from itertools import combinations

    r = random.Random(3)
    for trial in range(3):
        sizes = [r.randint(1, 12) for _ in range(7)]
        rows = [(f"s{g}", r.choice("xyz")) for g, n in enumerate(sizes) for _ in range(n)]
        d = spark.createDataFrame([(i, *x, "clash") for i, x in enumerate(rows)], "id int, g string, y string, place string")
        s = sampling.grouped_split(d, "g", "y", 0.3)
        best = min(abs(sum(c) / len(rows) - 0.3) for k in range(1, 7) for c in combinations(sizes, k))
        if s is None:
            assert best > 0.05
        else:
            assert abs(s.where("split = 'validation'").count() / len(rows) - 0.3) == pytest.approx(best)
    # of groups of one size, the one mixed like the whole goes to validation; null is no group
    rows = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("c", "y"), (None, "x"), (None, None)]
    s = sampling.grouped_split(spark.createDataFrame(rows, "g string, y string"), "g", "y", 1 / 3)
    assert {x["g"] for x in s.where("split = 'validation'").collect()} == {"b"} and s.count() == 8
    assert sampling.grouped_split(d.limit(0), "g", "y") is None


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_grouped_split_beyond_a_broadcast(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sampling, "BROADCAST_GROUPS", broadcast)
    d = spark.createDataFrame([(i, f"s{i % 5}" if i % 7 else None, "x") for i in range(210)], "id int, g string, y string")
    s = sampling.grouped_split(d, "g", "y")
    assert s.count() == 210 and s.where("split = 'validation'").count() == 36 and s.where("g is null and split = 'validation'").isEmpty()


def test_places_in_hot_groups(spark):
    """One group holds nine tenths of the rows; ids repeat and may be null."""
    from prosewright.operators import ranking

    n = 4000
    d = spark.createDataFrame([(i if i % 50 else None, "hot" if i % 10 else [None, "b"][i % 20 // 10], f"m{i % 3}" if i % 11 else None) for i in range(n)], "id int, g string, model string")
    got = sampling._ranked(d, ["g"], "id", 1, "k").groupBy("g").agg(F.count_distinct("k").alias("d"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 3 and all(r["lo"] == 1 and r["d"] == r["hi"] == r["n"] for r in got)
    for places in (7, 4096):
        sampling.PLACES, old = places, sampling.PLACES
        s = sampling.stratified(d, "g", 400, "id")
        sampling.PLACES = old
        assert {r["g"]: r["n"] for r in s.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {"hot": 400, "b": 200, None: 200}
        assert all(abs(r["n"] - 100) <= 1 for r in s.where("g = 'hot'").groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect())
    t = sampling.train_validation(d, "g", "id", 0.25)
    assert {r["g"]: r["n"] for r in t.where("split = 'validation'").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {"hot": 900, "b": 50, None: 50} and t.count() == n
    table = spark.createDataFrame([("hot", 1), (None, 2)], "g string, x int")
    assert {(r["g"], r["x"]): r["n"] for r in ranking.salted_join(d, table, ["g"], ["id"]).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")).collect()} == {("hot", 1): 3600, (None, 2): 200, ("b", None): 200}


def test_first_passing_gives_up(spark):
    d = spark.createDataFrame([(i,) for i in range(100)], "i int")
    assert [r[0] for r in sampling.first_passing(d, F.col("i") % 10 == 0, 3, F.col("i")).orderBy("i").collect()] == [0, 10, 20]
    assert sampling.first_passing(d, F.col("i") >= 50, 2, F.col("i"), skips_per_row=10).isEmpty()


def test_first_passing_any_order(spark):
    """Orders that no literal can hold, with a null; given up at the last skip allowed, or never. Rows 30 to 99 pass, 99 has no place in order."""
    d = spark.createDataFrame([(i if i < 99 else None, i) for i in range(100)], "o int, i int")

    def got(order, n, skips):
        return sorted(r["i"] for r in sampling.first_passing(d, F.col("i") >= 30, n, order, skips).collect())

    for order in (F.struct("o"), F.array("o"), F.col("o"), F.struct(F.col("o").isNotNull(), "o")):
        assert [got(order, 3, k) for k in (11, 10, 0, None)] == [[30, 31, 99], [99], [99], [30, 31, 99]]
    assert [got(F.struct(F.col("o").isNull(), "o"), 3, k) for k in (11, 10, 0, None)] == [[30, 31, 32], [], [], [30, 31, 32]]


def test_first_passing_query(spark, tmp_path):
    """As its SQL has it where thousands of rows are skipped, before the first that passes too, and where an id is null."""
    duckdb = pytest.importorskip("duckdb")
    from prosewright.plans import more, more_sql

    rows = [(i, "x", "prose" if i < 2500 else "code") for i in range(2560)] + [(None, "x", "code"), (7, " ", "code"), (8, None, "code"), (9, "x", None), (10, "x", " Code ")]
    d = spark.createDataFrame(rows[::-1], "row_id long, text string, category string").withColumns({c: F.lit("s") for c in ("sub_type", "source", "model")})
    for most in (2**20, 2520):
        path = f"{tmp_path}/{most}"
        d.where(f"coalesce(row_id, 0) < {most}").write.parquet(f"{path}/golden_train.parquet")
        want = duckdb.connect().execute(more_sql.SQL["first_passing"].replace("FROM golden_train", f"FROM '{path}/golden_train.parquet/*.parquet'")).fetchall()
        assert [tuple(r) for r in more.first_passing(spark, path).collect()] == want and len(want) == (40 if most > 2520 else 22)


def test_filters(spark):
    good = "\n".join(["line of text"] * 6)
    assert flags(spark, filters.quality_ok, good, "a\nb", "# DO NOT EDIT\n" + good, "\u0001" * 50 + good, None) == [True, False, False, False, False]
    assert flags(spark, filters.size_ok, "x" * 50, "x" * 49, None) == [True, False, False]
    assert filters.kept_columns(["a", "b", "c"], ["a, b"]) == ["c"]
    for bad in (["x"], ["a,b,c"]):
        with pytest.raises(ValueError):
            filters.kept_columns(["a", "b", "c"], bad)


def _drop_in_order(x, threshold, cosine):
    n = len(x)
    if cosine:
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    nn = np.round(d, 9).argmin(axis=1)
    keep = [True] * n
    for i in range(n):
        if keep[i] and d[i, nn[i]] < threshold:
            keep[max(i, nn[i])] = False
    return [i for i in range(n) if not keep[i]]


@pytest.mark.parametrize("seed", range(4))
def test_dedup_equals_the_sequential_rule(spark, seed):
    x = np.random.default_rng(seed).normal(size=(40, 2)).round(1)
    d = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    n = dedup.nearest(d, "id", "v", "squared", block=16)
    got = sorted(r[0] for r in dedup.dropped(n, 0.1).collect())
    assert got == _drop_in_order(x, 0.1, False)


def test_dedup_edges(spark):
    d = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, 2.0])], "id long, v array<double>")
    assert dedup.nearest(d, "id", "v").count() <= 1
    assert dedup.nearest(d.limit(0), "id", "v").isEmpty()
    one = spark.createDataFrame([(1, 0.0)], "id long, f double")
    assert dedup.feature_dedup(one, "id", ["f"], 0).count() == 1 and dedup.feature_dedup(one, "id", ["f"], 0.1).count() == 1


def _components(edges, vertices):
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_components(spark, kind):
    r = random.Random(3)
    vertices = list(range(60))
    edges = {"chain": [(i, i + 1) for i in range(40)], "random": [(r.randrange(60), r.randrange(60)) for _ in range(45)], "star": [(7, i) for i in range(20)] + [(None, 3), (3, 3), (7, 1)], "none": []}[kind]
    e = spark.createDataFrame(edges or [(None, None)], "u long, v long")
    got = {x["v"]: x["root"] for x in components.connected_components(e, spark.createDataFrame([(v,) for v in vertices], "v long")).collect()}
    assert got == _components(edges, vertices)


def test_running_total(spark):
    d = spark.createDataFrame([(i, "hot" if i % 3 else None, i % 5) for i in range(90)], "id long, g string, w int")
    rank = ranking.running_total(d, ["g"], "id", bins=7, name="r")
    for _, rows in rank.toPandas().groupby("g", dropna=False):
        assert sorted(rows["r"]) == list(range(len(rows)))
    total = ranking.running_total(d, ["g"], "id", F.col("w"), bins=7, name="b").toPandas()
    for _, rows in total.groupby("g", dropna=False):
        rows = rows.sort_values(["b", "w"])
        assert rows["b"].iloc[0] == 0 and rows["b"].max() + rows.loc[rows["b"].idxmax(), "w"] <= rows["w"].sum()


def test_undecided_rows_are_an_error(spark):
    """Every row of a chain names the next one; one round decides two of them."""
    from prosewright.operators import dedup

    chain = spark.createDataFrame([(i, i + 1, 0.0) for i in range(6)], "id long, nn long, d double")
    assert {r["id"] for r in dedup.dropped(chain, 0.1, max_rounds=3).collect()} == {1, 3, 5}
    with pytest.raises(RuntimeError):
        dedup.dropped(chain, 0.1, max_rounds=2)


def test_nearest_among_candidates(spark):
    r = np.random.default_rng(1)
    d = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(30)], "id int, v array<double>")
    pairs = d.select(F.col("id").alias("a")).crossJoin(d.select(F.col("id").alias("b")))
    for metric in ("cosine", "squared"):
        rows = lambda x: sorted((y["id"], y["nn"], round(y["d"], 6)) for y in x.collect())
        whole = rows(dedup.nearest(d, "id", "v", metric))
        assert rows(dedup.nearest(d, "id", "v", metric, block=7)) == whole == rows(dedup.nearest(d, "id", "v", metric, candidates=pairs)) and len(whole) == 30
    assert rows(dedup.nearest(d, "id", "v", candidates=pairs.where("a = 3 and b = 9"))) and dedup.nearest(d, "id", "v", candidates=pairs.where("a = 3 and b = 9")).count() == 2


def test_json_is_one_value(spark):
    texts = ['{"a": 1}', " [1, 2] ", "1", '"x"', "null", "1, 2", "1] [2", "{} {}", '{"a": 1', "", " ", None, '1, "b": 2', "1}", '{"a": 1, "a": 2} x']
    assert flags(spark, validators.is_json, *texts) == [True] * 5 + [False] * 10
