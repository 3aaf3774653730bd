import pytest
from pyspark.sql import functions as F

from prosewright.functions import labels
from prosewright.operators import routing, rules, scoring

PROSE = "The old bridge was closed in spring. People walked along the river instead. Nobody minded the longer way home. It was a quiet year for the town."
CODE = "def f(x):\n" + "\n".join(f"    y[{i}] = g(x) + {{'a': {i}}} * (x % {i + 1})" for i in range(12))
TABLE = "\n".join("\t".join(["10", "20", "30", "ab"]) for _ in range(12))


def one(spark, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["classification"] for r in rules.classify(d).orderBy("i").collect()]


def test_rule_outcomes(spark):
    p, c, t = one(spark, PROSE, CODE, TABLE)
    assert (p["category"], round(p["confidence"], 2)) == ("prose", 0.95)
    assert (c["category"], round(c["confidence"], 2)) == ("code", 0.98)
    assert (t["category"], round(t["confidence"], 2)) == ("structured", 0.98)
    assert all(x["tier"] == "structural" and x["sub_type"] is None for x in (p, c, t))


def test_guards(spark):
    null, empty, blank, short = one(spark, None, "", " \t\n ", "hello world")
    assert all((x["category"], x["confidence"]) == ("prose", 0.0) for x in (null, empty, blank))
    assert (short["category"], short["confidence"]) == ("prose", 0.5)


def test_deferral(spark):
    (x,) = one(spark, "key = value\nother = thing\n[section]\nname = text here")
    assert round(x["confidence"], 2) == 0.40


def test_human_line(spark):
    d = rules.classify(spark.createDataFrame([(PROSE,)], "text string"))
    assert d.select(rules.human(F.col("classification"))).first()[0] == "prose (confidence: 0.95, tier: structural)"


def test_route(spark):
    d = spark.createDataFrame([(1, CODE, None, None), (2, CODE, "short", None), (3, PROSE, None, None), (4, None, None, None)], "id int, bodytext string, summarytext string, title string")
    r = {x["id"]: x for x in routing.route(d).collect()}
    assert [r[i]["route"] for i in (1, 2, 3, 4)] == ["skipped", "prose", "prose", "skipped"]
    assert r[2]["fields"]["summarytext"]["reason"] == "short field" and len(r[4]["fields"]) == 0


def test_marginalisation(spark):
    subs = ["ini", "key_value", "toml", "python", "rust"]
    d = spark.createDataFrame([([0.35, 0.30, 0.15, 0.12, 0.08],)], "p array<double>")
    m = d.select(scoring.marginalised(F.col("p"), subs).alias("m")).first()["m"]
    assert m["category"] == "structured" and m["probability"] == pytest.approx(0.80)


def test_marginalisation_tie_goes_to_the_first_category(spark):
    d = spark.createDataFrame([([0.5, 0.5],)], "p array<double>")
    assert d.select(scoring.marginalised(F.col("p"), ["csv", "plain"]).alias("m")).first()["m"]["category"] == "prose"


def test_softmax_sigmoid_argmax(spark):
    d = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>")
    r = d.select(scoring.softmax(F.col("x")).alias("s"), scoring.argmax(F.col("x")).alias("l"), scoring.argmax(F.col("x"), last=False).alias("f"), scoring.sigmoid(F.lit(0.0)).alias("g")).first()
    assert sum(r["s"]) == pytest.approx(1) and r["l"] == 2 and r["f"] == 1 and r["g"] == 0.5


def test_detections(spark):
    d = spark.createDataFrame([([0.2, 0.9, 0.3, 0.31],)], "x array<double>")
    rows = scoring.scored(F.col("x"), ["plain", "python", "csv", "markdown"], scoring.DETECTION_THRESHOLD)
    g = d.select(scoring.by_category(rows).alias("g"), scoring.at_least(scoring.by_category(rows), 0.5).alias("h")).first()
    assert [x["sub_type"] for x in g["g"]["prose"]] == ["markdown"] and set(g["g"]) == {"prose", "code", "structured"}
    assert set(g["h"]) == {"code"}


def test_standardised_guards_zero_deviation(spark):
    d = spark.createDataFrame([([3.0, 5.0, 9.0],)], "x array<double>")
    assert d.select(scoring.standardised(F.col("x"), [1.0, 5.0], [2.0, 0.0])).first()[0] == [1.0, 0.0]


def test_score_with(spark):
    d = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "x array<double>")
    got = scoring.score_with(d, F.col("x"), lambda: lambda m: m * 2).select("logits").collect()
    assert [list(r[0]) for r in got] == [[2.0, 4.0], [6.0, 8.0]]


def test_labels(spark):
    d = spark.createDataFrame([("yaml_config",), ("python",), ("??",), (None,)], "s string")
    r = d.select(labels.canonical_sub_type(F.col("s")).alias("c"), labels.category_of(F.col("s")).alias("k"), labels.detector_category(F.col("s")).alias("d")).collect()
    assert [x["c"] for x in r] == ["yaml", "python", "unknown", "unknown"]
    assert [x["k"] for x in r] == ["prose", "code", "prose", "prose"]
    assert r[1]["d"] == "code" and r[3]["d"] == "unknown"
    assert labels.dimension(spark).count() == 32
