import json

import pytest
from pyspark.sql import functions as F

from prosewright.api import Classifier, ModelConfig, human_with_detections
from prosewright.functions.features import FEATURES
from prosewright.operators import parsing
from prosewright.plans import reports

PROSE = "The old bridge was closed in spring. People walked along the river instead. Nobody minded the longer way home. It was a quiet year for the town."


@pytest.fixture
def config(tmp_path):
    n = len(FEATURES)
    (tmp_path / "c.json").write_text(json.dumps({"feature_names": list(FEATURES), "feature_mean": [0.0] * n, "feature_std": [1.0] * n, "sub_type_map": {"csv": 1, "plain": 0, "markdown": 2}, "detection_map": {"python": 0, "csv": 1}, "detection_threshold": 0.4}))
    return ModelConfig.load(str(tmp_path / "c.json"))


def test_rules_only(spark):
    c = Classifier(spark)
    assert [r["category"] for r in c.classify_batch([PROSE, ""])] == ["prose", "prose"]
    assert len(c.extract_features("a b")) == 42


def test_model(spark, config):
    def model():
        import numpy as np

        return lambda x: np.tile([2.0, 1.0, 1.9, 3.0, -3.0], (len(x), 1))

    assert config.sub_types == ["plain", "csv", "markdown"]
    d = spark.createDataFrame([(1, PROSE), (2, ""), (3, "hi you")], "i int, text string")
    c = Classifier(spark, config, model)
    r = {x["i"]: x for x in c.transform(d).collect()}
    assert (r[1]["classification"]["category"], r[1]["classification"]["sub_type"], r[1]["classification"]["tier"]) == ("prose", "plain", "model")
    assert [x["sub_type"] for x in r[1]["sub_type_scores"]["prose"]] == ["plain", "markdown"] and set(r[1]["detections"]) == {"code"}
    assert r[2]["classification"]["confidence"] == 0 and r[3]["classification"]["confidence"] == 0.5 and r[3]["detections"] is None
    assert set(c.with_min_score(0.3).transform(d).where("i = 1").first()["sub_type_scores"]) == {"prose"}
    line = c.transform(d).where("i = 1").select(human_with_detections(F.col("classification"), F.col("detections"))).first()[0]
    assert line.startswith("prose/plain (confidence: 0.8") and line.endswith("[detections: code/python(0.95)]")


def test_reports(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "t string, p string")
    r = reports.evaluation(d, "t", "p")
    assert "a -> b: 1" in reports.as_text(r, "x") and json.loads(reports.as_json(r))["correct"] == 1
    assert reports.table(d.groupBy("p").count().orderBy("p")).splitlines()[2] == "| a | 2 |"


def test_prompt_and_section(spark):
    d = spark.createDataFrame([("x" * 60 + "\n\nshort", None)], "t string, u string")
    r = d.select(parsing.prompt("[{t}|{u}]", t=F.lit("k"), u=F.col("u")), parsing.one_section(F.col("t"))).first()
    assert r[0] == "[k|]" and r[1] == "x" * 60


def test_a_failing_model_falls_back(spark, config):
    def model():
        raise OSError("no such file")

    d = spark.createDataFrame([(1, PROSE), (2, "")], "i int, text string")
    r = {x["i"]: x["classification"] for x in Classifier(spark, config, model).transform(d).collect()}
    assert r[1]["category"] == "prose" and r[1]["reason"].startswith("no model") and r[2]["confidence"] == 0
    with pytest.raises(Exception, match="no such file"):
        Classifier(spark, config, model, failures="raise").transform(d).collect()


def test_whole_texts_where_asked_for(spark):
    long = PROSE + "\n" * 3 + "x = {1;\n" * 3000
    d = spark.createDataFrame([(long,)], "text string")
    a, b = (Classifier(spark, sample_bytes=n).extract_features(long)["line_count"] for n in (10_000, None))
    assert a < b == 3003 and Classifier(spark, sample_bytes=None).transform(d).count() == 1


def test_functions_of_the_package(spark):
    import prosewright

    assert prosewright.classify(PROSE, spark=spark)["category"] == "prose"
    assert len(prosewright.classify_batch([PROSE, ""], spark=spark)) == 2
    with pytest.raises(AttributeError):
        prosewright.nothing


def test_audit_and_slices(spark):
    v = spark.createDataFrame([(k, a, "inject_log_content", "log_content", 1) for k in range(5) for a in "xyz"], "row_id int, annotator string, audit_source string, label string, flag int")
    r = reports.audit(v, "row_id")
    assert r["labels"]["log_content"] == {"mean_agreement": 1, "unanimous_rate": 1, "split_rate": 0, "recall": 1, "passes": True} and not r["passes"]
    d = spark.createDataFrame([("a", "a", "u"), ("a", "b", "v"), ("b", "b", None)], "t string, p string, f string")
    assert reports.sliced(d, ["f"], "t", "p")["slices"] == {"f": {"u": {"total": 1, "correct": 1, "accuracy": 1}, "v": {"total": 1, "correct": 0, "accuracy": 0}}}


def test_aligned_tables(spark):
    from prosewright.operators import metrics, voting

    a = spark.createDataFrame([(1, 0), (2, 1)], "k int, flag int")
    assert metrics.aligned({"x": a, "y": a}, "k", ["flag"]).count() == 2
    for b in (a.limit(1), a.union(a), a.withColumn("k", F.col("k") + 1)):
        with pytest.raises(ValueError):
            metrics.aligned({"x": a, "y": b}, "k", ["flag"])
    with pytest.raises(ValueError):
        metrics.aligned({"x": a, "y": a.drop("flag")}, "k", ["flag"])
    assert voting.all_resolved(a, "k", ("9",)).count() == 2
    with pytest.raises(ValueError):
        voting.all_resolved(a, "k", ("1",))
