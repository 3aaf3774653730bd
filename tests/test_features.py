"""Features against hand-made texts and the definitions' edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from prosewright.functions import textprims as tp
from prosewright.functions.features import FEATURES, with_features


def feats(spark, *texts, **kw):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.asDict() for r in with_features(d, **kw).orderBy("i").collect()]


def test_order_and_number():
    assert len(FEATURES) == 41
    assert list(FEATURES)[:3] == ["line_length_cv", "char_entropy", "leading_whitespace_ratio"]
    assert list(FEATURES)[-1] == "shebang_present"


def test_null_and_empty_are_zero(spark):
    for r in feats(spark, None, ""):
        assert r["line_count"] == 0
        assert all(r[f] == 0 for f in FEATURES)


def test_lines(spark):
    rows = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\r\nb\n\n",), ("\n",)], "t string").select(tp.lines(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in rows] == [[], ["a"], ["a"], ["a", "b", ""], [""]]


def test_byte_prefix_keeps_characters_whole(spark):
    d = spark.createDataFrame([("aé",), ("a🙂b",), ("abc",)], "t string")
    assert [r[0] for r in d.select(tp.byte_prefix(F.col("t"), 2)).collect()] == ["a", "a", "ab"]


def test_crlf_and_literal_newlines_count_alike(spark):
    a, b, c = feats(spark, "one two\nthree\n", "one two\r\nthree\r\n", "one two\\nthree\\n")
    for f in ("line_uniqueness", "avg_words_per_line", "line_count", "short_line_ratio"):
        assert a[f] == b[f] == c[f]


@pytest.mark.parametrize(
    "name, text, value",
    [
        ("line_length_cv", "aa\naaaa", 1 / 3),
        ("line_length_cv", "one", 0.0),
        ("char_entropy", "aabb", 1.0),
        ("leading_whitespace_ratio", "\tx\n  y\n   z\nw", 0.5),
        ("tab_density", "a\tb\t", 0.5),
        ("sentence_punctuation_rate", "One two. It is 3.14 now!", 2 / 6),
        ("paragraph_break_rate", "a\n\nb", 1 / 3),
        ("alpha_ratio", "ab 1-", 0.8),
        ("symbol_ratio", "a→b – ok", 0.0),
        ("symbol_ratio", "a#b$", 0.5),
        ("delimiter_consistency", "a,b,c\n1,2,3\n4,5,6", 1.0),
        ("delimiter_consistency", "a,b\n1,2", 0.0),
        ("json_brace_depth", "{[]}", 1.0),
        ("key_value_ratio", "a: b\nc:d\ne=f\ng=", 0.5),
        ("xml_tag_ratio", "<a>\nx < y", 0.5),
        ("log_line_ratio", "2024-01-01 x\n12:00:01 y\n[2024 z\nn", 0.75),
        ("comment_ratio", "# a\n// b\nc\n-- d", 0.75),
        ("numeric_field_ratio", "1,000 2.5 x -3e4 1_0", 0.6),
        ("repetitive_structure_score", "a b\nc d\ne f g", 2 / 3),
        ("hyphenated_line_break_ratio", "infor-\nmation\nX", 0.5),
        ("short_repeated_line_ratio", "a\na\nb", 2 / 3),
        ("page_number_density", "12\nPage 3 of 9\n4 / 7\ntext", 0.75),
        ("label_value_line_ratio", "Name: Ada\nplain text\nSize - 3", 2 / 3),
        ("table_fragment_score", "a,b,c\nx  y\nplain", 2 / 3),
        ("uppercase_header_ratio", "SECTION ONE\nbody\nAB", 1 / 3),
        ("encoding_error_ratio", "cafÃ©�", 2 / 6),
        ("repeated_ngram_ratio", "a b c a b c", 1 / 3),
        ("sentence_coherence_score", "One two.\nthree.\nFour", 1 / 3),
        ("avg_words_per_line", "a b c\n\nd", 2.0),
        ("operator_density", "a == b => c", 2 / 11 * 1000),
        ("inline_markup_count", "**b** `c` *i* [t](u)", 4 / 20 * 1000),
        ("indentation_consistency", "  a\n    b\n   c\nd", 2 / 3),
        ("markup_heading_ratio", "# Head\n=====\ntext\n#no", 0.5),
        ("code_fence_density", "```\nx\ny\n```\nz", 0.4),
        ("prose_paragraph_ratio", "\n".join(["x" * 41] * 3 + ["short"]), 0.75),
        ("semicolon_line_ending_ratio", "a;\nb\n\nc; ", 2 / 3),
        ("list_item_ratio", "- a\n1. b\n*c\nd", 0.5),
        ("parenthesis_density", "(a)b", 500.0),
        ("section_header_ratio", "[a.b-c]\n[x!]\ny", 1 / 3),
        ("json_lines_ratio", '{"a":1}\n\n{"b":2}\nx', 2 / 3),
        ("shebang_present", "  #!/bin/sh", 1.0),
    ],
)
def test_values(spark, name, text, value):
    got = feats(spark, text, names=[name])[0][name]
    assert math.isclose(got, value, rel_tol=1e-5, abs_tol=1e-6), (name, got, value)


def test_dictionary(spark):
    assert feats(spark, "The cat, (dog) -- xyz", names=["dictionary_word_ratio"], wordlist=["the", "dog"])[0]["dictionary_word_ratio"] == pytest.approx(0.5)


def test_sample_is_bounded_by_bytes_only_if_asked(spark):
    text = "a" * 20_000 + "\n" * 100
    assert feats(spark, text)[0]["line_count"] == 1
    assert feats(spark, text, sample_bytes=None)[0]["line_count"] == 100


def test_clashing_columns_survive(spark):
    d = spark.createDataFrame([(1, "a b", 5)], "id int, text string, line_length_cv int")
    assert with_features(d, names=["alpha_ratio"]).columns == ["id", "text", "line_length_cv", "alpha_ratio", "line_count"]


def test_metamorphic_blank_lines(spark):
    a, b = feats(spark, "One is here.\nTwo is there.", "One is here.\n\n\nTwo is there.")
    for f in ("sentence_coherence_score", "avg_words_per_line", "markup_heading_ratio"):
        assert a[f] == b[f]
