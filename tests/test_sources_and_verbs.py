import json

import pytest
from pyspark.sql import functions as F

from prosewright.plans import verbs
from prosewright.sources import documents as docs
from prosewright.sources import generators as gen

PROSE = "The old bridge was closed in spring. People walked along the river instead. Nobody minded the longer way home. It was a quiet year for the town."


@pytest.fixture
def jsonl(tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text("\n".join([json.dumps({"id": 1, "text": PROSE, "deep": {"t": "x"}}), "", json.dumps({"id": 2, "text": 5}), json.dumps({"id": 3}), "{}"]))
    return str(p)


def read(path):
    import glob

    return [json.loads(x) for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f) if x.strip()]


def test_json_paths(spark, jsonl):
    d = docs.read_json_lines(spark, jsonl)
    rows = d.select(docs.json_text(F.col("doc"), "text").alias("t"), docs.json_text(F.col("doc"), "deep.t").alias("u")).collect()
    assert [r["t"] for r in rows] == [PROSE, None, None, None] and [r["u"] for r in rows] == ["x", None, None, None]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnot json\n')
    assert docs.read_json_lines(spark, str(tmp_path / "b.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception):
        docs.read_json_lines(spark, str(tmp_path / "b.jsonl")).collect()
    errors = docs.file_errors(spark, str(tmp_path / "b.jsonl"), docs.json_text(F.col("doc"), "text").isNotNull()).orderBy("line_number").collect()
    assert [(r["line_number"], r["error"]) for r in errors] == [(1, "sample failed schema validation"), (2, "invalid JSON")]


def test_classify_file(spark, jsonl, tmp_path):
    verbs.classify_file(spark, jsonl, str(tmp_path / "out"))
    out = {x.get("id"): x for x in read(tmp_path / "out")}
    assert out[1]["_classification"]["category"] == "prose" and out[1]["deep"] == {"t": "x"} and "sub_type" not in out[1]["_classification"]
    assert out[2] == {"id": 2, "text": 5} and out[None] == {}


def test_filter_features_labels_validate(spark, tmp_path):
    src = tmp_path / "f.jsonl"
    code = "def f(x):\n" + "\n".join(f"    y[{i}] = g(x) + {{'a': {i}}} * (x % {i + 1})" for i in range(12))
    src.write_text("\n".join(json.dumps(x) for x in [{"text": PROSE, "label": "prose"}, {"text": code, "label": "code"}, {"text": code, "expected_category": "prose"}]))
    verbs.filter_file(spark, str(src), str(tmp_path / "p"), str(tmp_path / "s"), ("text",))
    assert len(read(tmp_path / "p")) == 1 and len(read(tmp_path / "s")) == 2
    verbs.features_file(spark, str(src), str(tmp_path / "c"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "c")).columns) == 41
    verbs.label_corpus(spark, str(src), str(tmp_path / "l"), features=True)
    assert {x["label"] for x in read(tmp_path / "l")} == {"prose", "code"} and "features" in read(tmp_path / "l")[0]
    v = verbs.validate(spark, str(src))
    assert v["total"] == 3 and v["correct"] == 2 and v["tier_1_count"] == 3


def test_parquet_swap_append_conform(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).withColumn("x", F.lit("a")).write.parquet(path)
    docs.replace_parquet(spark.read.parquet(path).where("id > 0"), path)
    docs.append_parquet(spark.createDataFrame([(9,)], "id int"), path)
    assert sorted((r["id"], r["x"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "a"), (9, None)]
    with pytest.raises(ValueError):
        docs.append_parquet(spark.range(1).withColumnRenamed("id", "zz"), path)


def test_text_folder_and_first_available(spark, tmp_path):
    (tmp_path / "prose").mkdir()
    (tmp_path / "prose" / "plain.txt").write_text("a\nb")
    r = docs.read_text_folder(spark, str(tmp_path)).first()
    assert (r["text"], r["category"], r["sub_type"]) == ("a\nb", "prose", "plain")
    with pytest.raises(FileNotFoundError):
        docs.first_available(spark, [str(tmp_path / "none")])


@pytest.mark.parametrize("kind", list(gen.KINDS))
def test_generators_do_not_depend_on_partitions(spark, kind):
    a = gen.generate(spark, kind, 12, partitions=1).collect()
    b = gen.generate(spark, kind, 12, partitions=5).orderBy("id").collect()
    assert sorted(a) == sorted(b) and all(len(r["text"]) >= gen.KINDS[kind][3] for r in a)


def test_perturbed(spark):
    d = spark.createDataFrame([(1, 0.5), (2, 0.0)], "id long, f double")
    p = gen.perturbed(d, "id", ["f"])
    n = {r["id"]: r["n"] for r in p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(10 <= k <= 15 for k in n.values()) and p.where("f < 0").isEmpty()


def test_stream(spark, small):
    from prosewright.plans import catalogue

    a = {r["category"]: r["n"] for r in catalogue.stream_categories(spark, small).groupBy("category").agg(F.sum("n").alias("n")).collect()}
    b = {r["category"]: r["n"] for r in catalogue.tier1_classify(spark, small).groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert a == b


def test_queries_classify_whole_texts(spark, tmp_path, monkeypatch):
    """A text whose first 10,000 bytes are of another category than the whole."""
    import datetime as dt

    from prosewright.operators.rules import classify
    from prosewright.plans import catalogue

    text = "The river was closed for the winter, and the people of the town walked along it. " * 130 + "\n" + "\n".join(f"        if (x[{i}] == y->{{z}}) {{ a += b[{i}] * (c & 0x{i:x}); }}" for i in range(3000))
    docs = spark.createDataFrame([(1, text, dt.datetime(2024, 1, 1))], "doc_id long, text string, fetched_at timestamp")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (whole,), (part,) = (classify(docs, sample_bytes=n).select("classification.category").first() for n in (None, 10_000))
    assert whole != part
    assert [(r["category"], r["n"]) for r in catalogue.stream_categories(spark, str(tmp_path)).collect()] == [(whole, 1)]
    monkeypatch.setattr(catalogue.generators, "KINDS", ["long"])
    monkeypatch.setattr(catalogue.generators, "generate", lambda *_: docs.selectExpr("doc_id AS id", "'x' AS source", "'y' AS sub_type", "text"))
    assert [r["category"] for r in catalogue.generated_documents(spark, str(tmp_path)).collect()] == [whole]


def test_entry_and_names(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_standard_input_and_cleaning_up(spark, capsys, monkeypatch, tmp_path):
    import io
    import os

    from prosewright import session
    from prosewright.plans import verbs
    from prosewright.sources import documents

    lines = ['{"text": "The old bridge was closed. Nobody minded the longer way home that year.", "n": 1}', '{"n": 2}', ""]
    path = documents.from_stream(spark, io.StringIO("\n".join(lines)), batch=1)
    assert documents.read_json_lines(spark, path).count() == 2
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(lines)))
    verbs.main(["file", "-", "-o", str(tmp_path / "out")])
    assert documents.read_json_lines(spark, str(tmp_path / "out")).where("try_variant_get(doc, '$._classification.category', 'string') = 'prose'").count() == 1
    assert not os.path.exists(session._own_folder(spark))
    monkeypatch.setattr("sys.stdin", io.StringIO("The old bridge was closed. Nobody minded the longer way home that year."))
    verbs.main(["text", "-", "--human"])
    assert capsys.readouterr().out.startswith("prose (")
    verbs.main(["text", "a b c d e f", "--sample-bytes", "0"])
    assert '"category":"prose"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        verbs.main(["text", "a", "--model", "x.onnx"])
