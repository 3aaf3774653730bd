"""Mixing, splitting, sampling, consensus, tokens, profiles, residue."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosewright.llm import consensus, cube, group_split, mix, profiles, residue, token_ids
from prosewright.operators import subsets


def plan(spark, *rows):
    return spark.createDataFrame(rows, "name string, target_count long, category string, sub_type string, synthetic boolean, notes string, max_repeat int")


PLAN = [("big", 60, "prose", "plain", False, None, 2), ("small", 30, "code", "sql", False, "x", 3), ("small", 30, "code", "sql", False, "x", 3), ("made", 10, "structured", "csv", True, None, 5), (None, 5, None, None, None, None, None), ("none", 20, "code", "go", False, None, 1)]


def golden(spark, n=300):
    r = random.Random(2)
    rows = [(i, "word " * r.randint(1, 30) if i % 20 else None, ["Big", " small", "made", "other"][0 if i % 3 else i % 4], ["Prose", "code"][i % 2], ["plain", "SQL"][i % 2]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, " ", "big", "prose", "plain")], "row_id long, text string, source string, category string, sub_type string")


def test_mix_report(spark):
    p, g = mix.distinct_plan(plan(spark, *PLAN)), golden(spark)
    rows = mix.usable_rows(g, p)
    rep = {r["name"]: r for r in mix.mix_report(rows, p).collect()}
    n = {"big": 0, "small": 0, "made": 0, "none": 0}
    for r in g.collect():
        s = r["source"].strip().lower()
        if r["text"] and r["text"].strip() and s in n:
            n[s] += 1
    total, repeat, share = sum(n.values()), {"big": 2, "small": 3, "made": 1, "none": 1}, {"big": 60, "small": 30, "made": 10, "none": 20}
    for k in n:
        assert rep[k]["n_rows"] == n[k]
        assert rep[k]["short"] == (n[k] * repeat[k] < total * share[k] / 120)
        assert min(total * share[k] / 120, n[k] * repeat[k]) <= rep[k]["drawn_units"] <= n[k] * repeat[k]


def test_mix_fills_each_slot_once(spark):
    p = mix.distinct_plan(plan(spark, *PLAN))
    rows = mix.usable_rows(golden(spark), p)
    totals, slots = mix.mix_slots(rows, p, block=2, shard_slots=8)
    need = {r["name"]: r["slots"] for r in totals.collect()}
    got = {}
    for r in slots.collect():
        got.setdefault(r["name"], []).extend(range(r["first"], r["first"] + r["n"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in need.items() if n}
    per = slots.groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in per) == sum(need.values()) and max(r["n"] for r in per) <= 8


def test_mix_never_repeats_too_often(spark):
    p = mix.distinct_plan(plan(spark, *PLAN))
    rows = mix.usable_rows(golden(spark), p, weight=mix.words_weight())
    m = mix.mix_sources(rows, p, block=50)
    most = {r["name"]: r["max_repeat"] for r in p.collect()}
    used = m.groupBy("name", "block", "id", "from").agg(F.count(F.lit(1)).alias("n")).collect()
    assert used and all(r["n"] <= most[r["name"]] for r in used)
    size = m.groupBy("name", "slot").agg(F.sum(F.col("to") - F.col("from")).alias("s")).collect()
    assert all(r["s"] <= 50 for r in size)


def test_blocks_cover_every_unit_once(spark):
    p = mix.distinct_plan(plan(spark, *PLAN))
    rows = mix.usable_rows(golden(spark), p, weight=mix.words_weight())
    b = mix.pack_blocks(rows, 40)
    got = {r["id"]: r["s"] for r in b.groupBy("id").agg(F.sum(F.col("to") - F.col("from")).alias("s")).collect()}
    assert got == {r["id"]: r["w"] for r in rows.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    j = np.arange(n)
    got = mix.permute(j, np.full(n, n), np.full(n, 12345))
    assert sorted(got) == list(range(n))


def test_mix_of_nothing(spark):
    p = mix.distinct_plan(plan(spark, *PLAN))
    rows = mix.usable_rows(golden(spark).limit(0), p)
    assert mix.mix_sources(rows, p).isEmpty() and mix.mix_report(rows, p).where("short").isEmpty()
    assert mix.mix_report(rows, mix.distinct_plan(plan(spark).limit(0))).isEmpty()


def test_groups(spark):
    rows = [(1, "T-1", "a/M:x", "d"), (2, "t_1", "b/m", None), (3, "T1", None, "D"), (4, "T1", "z", "d!"), (5, "t2", "m", "d"), (6, None, "m", "d"), (7, "t1", None, None), (8, "!!", "m", "d"), (4, "T1", "z", "d!")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "sample_id long, prompt_template string, model string, content_domain string, root string")
    got = {r["id"]: r["root"] for r in group_split.related_groups(d).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8}
    assert group_split.related_groups(d.limit(0)).isEmpty()


def test_groups_of_a_hot_template(spark):
    """Nine tenths of the rows share their keys, others have none."""
    rows = [(i, "T", "m", "d") if i % 10 else (i, None, "m", "d") for i in range(500)]
    d = spark.createDataFrame(rows, "sample_id long, prompt_template string, model string, content_domain string")
    got = {r["id"]: r["root"] for r in group_split.related_groups(d).collect()}
    assert got == {i: 1 if i % 10 else i for i in range(500)}


def test_split_keeps_groups_and_proportions(spark):
    r = random.Random(4)
    rows = [(i, f"t{min(40, int(r.expovariate(0.05)))}", f"m{r.randrange(3)}", None) for i in range(400)]
    d = spark.createDataFrame(rows, "sample_id long, prompt_template string, model string, content_domain string")
    s = group_split.group_split(d, {"train": 0.7, "validation": 0.15, "test": 0.15})
    assert s.count() == 400 and s.groupBy("root").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    n = {x["split"]: x["n"] for x in s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(n["test"] - 60) <= 3 and abs(n["validation"] - 60) <= 3
    assert group_split.group_split(d.limit(0)).isEmpty()


def test_closest_counts_are_closest():
    from itertools import product

    for sizes, target in (({5: 2, 3: 3}, 9), ({7: 1}, 3), ({1: 4, 10: 1}, 6), ({}, 5), ({4: 3}, 6)):
        (took,) = subsets.closest_counts(sizes, [target])
        best = min((abs(sum(k * s for k, s in zip(c, sizes)) - target) for c in product(*[range(n + 1) for n in sizes.values()])), default=target)
        assert abs(sum(s * k for s, k in took.items()) - target) == best and all(k <= sizes[s] for s, k in took.items())
    assert sum(s * k for s, k in subsets.closest_counts({10**6: 100}, [3 * 10**7], max_bits=1000)[0].items()) == 3 * 10**7


def test_closest_counts_of_more_than_a_million_records():
    r = random.Random(6)
    for _ in range(5):
        sizes = {r.randrange(100_001, 200_000, 2): 1 for _ in range(18)}
        target = sum(r.sample(sorted(sizes), 8))
        assert sum(sizes) > 1 << 20
        (took,) = subsets.closest_counts(sizes, [target])
        assert sum(s * k for s, k in took.items()) == target


def test_cube(spark):
    cells = cube.plan_cells(plan(spark, ("a", 60, "prose", "plain", False, None, 1), ("b", 40, "code", "SQL", False, None, 1), ("c", 1, "code", "go", False, None, 1)))
    g = golden(spark)
    rows = cube.cell_rows(g, cells)
    t = cube.cell_targets(rows, cells, least=5)
    s = cube.cube_sample(rows.repartition(5), t)
    rep = {(r["category"], r["sub_type"]): r for r in cube.cube_report(s, t).collect()}
    assert s.select("id").distinct().count() == s.count()
    assert all(abs(r["residual"]) <= 1.0 for r in rep.values())
    assert rep["code", "go"]["short"] and rep["code", "go"]["n_rows"] == 0
    assert all(abs(x["residual"]) < 1 for x in rep.values())
    assert cube.cube_sample(rows.limit(0), cube.cell_targets(rows.limit(0), cells)).isEmpty()


def votes(spark, rows):
    schema = "vote_id long, row_id long, annotator string, original_sub_type string, tier1_agrees boolean, tier2_agrees boolean, new_sub_type string, sub_type string, voted_at timestamp, received_at timestamp"
    return spark.createDataFrame(rows, schema)


def test_vote_labels_and_last_votes(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    rows = [
        (1, 1, "A-x", "csv", False, None, None, " TSV", t[0], t[1]),
        (2, 1, " a_X", "csv", True, None, None, None, t[2], t[2]),
        (3, 1, "b", "csv", False, True, None, None, t[0], t[0]),
        (4, 1, "c", "csv", False, False, "Pipe-Table", None, t[0], t[0]),
        (5, 1, "d", "csv", False, None, None, None, t[0], t[0]),
        (6, None, "d", "csv", True, None, None, None, t[0], t[0]),
        (7, 2, None, "csv", True, None, None, "csv", t[0], t[0]),
        (2, 1, " a_X", "csv", True, None, None, None, t[2], t[2]),
    ]
    got = {(r["annotator"], r["label"]) for r in consensus.last_votes(votes(spark, rows)).collect()}
    assert got == {("a_x", "csv"), ("b", "csv"), ("c", "pipe_table")}


def test_consensus_trusts_those_who_know(spark):
    """Six annotators who know with 0.9, three who always keep the shown label, two who guess."""
    r, labels, rows, truth = random.Random(7), [f"l{i}" for i in range(8)], [], {}
    for row in range(500):
        right = r.choice(labels)
        shown = right if r.random() < 0.85 else r.choice(labels)
        truth[row] = right
        for a in r.sample(range(11), 5):
            label = (right if r.random() < 0.9 else r.choice(labels)) if a < 6 else shown if a < 9 else r.choice(labels)
            rows.append((row, f"a{a}", label, shown))
    v = spark.createDataFrame(rows, "row_id long, annotator string, label string, original string").persist()
    trust = consensus.reliability(v)
    rel = {x["annotator"]: x["reliability"] for x in trust.collect()}
    assert min(rel[f"a{i}"] for i in range(6)) > 0.5 > 0.4 > max(rel[f"a{i}"] for i in range(6, 11))
    c = consensus.consensus(v, trust, 8, 0.14).collect()
    weighted = sum(x["label"] == truth[x["row_id"]] for x in c)
    from collections import Counter

    plain = sum(Counter(y[2] for y in rows if y[0] == row).most_common(1)[0][0] == truth[row] for row in truth)
    assert len(c) == 500 and weighted > plain and weighted > 460


@pytest.mark.parametrize("bipartite", [False, True])
def test_power_steps_reach_the_leading_eigenvector(bipartite):
    r = np.random.default_rng(3)
    n = r.integers(1, 50, (12, 12))
    n = np.triu(n, 1) + np.triu(n, 1).T
    if bipartite:  # annotators of one half share rows with the other half only: an equally large negative eigenvalue
        n[:6, :6] = n[6:, 6:] = 0
    know = r.random(12)
    s, d = n * np.outer(know, know), n.sum(axis=1)
    x, *_ = consensus._leading(lambda x: (s @ x, n @ (x * x), d), 12, 1e-9, 500)
    root = np.sqrt(d)
    u = np.linalg.eigh(s / np.outer(root, root))[1][:, -1]
    got = root * x
    assert np.abs(got / np.linalg.norm(got) - u * np.sign(u.sum())).max() < 1e-6
    with pytest.raises(RuntimeError):
        consensus._leading(lambda x: (s @ x, n @ (x * x), d), 12, 0.0, 3)


def test_consensus_of_nothing(spark):
    v = spark.createDataFrame([], "row_id long, annotator string, label string, original string")
    trust = consensus.reliability(v)
    assert trust.isEmpty() and consensus.consensus(v, trust, 0).isEmpty()
    one = spark.createDataFrame([(1, "a", "x", None)], "row_id long, annotator string, label string, original string")
    assert consensus.consensus(one, consensus.reliability(one), 1).first()["label"] == "x"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_token_ids_equal_the_library(spark, library):
    r = random.Random(1)
    texts = ["", " ", "\n\n  x", "a" * 3000, "abc" * 500 + " " * 40 + "z", "it's we'll <|endoftext|> ok", "　日本\t\n x", "🙂👩‍👩‍👧" * 20, "क्षत्रिय ١²½", None]
    texts += ["".join(r.choice("abcde\n \té日١²'sreLL.,-_") for _ in range(400)) for _ in range(30)]
    d = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {x["doc_id"]: list(x["ids"]) for x in token_ids.encode_column(d).collect()}
    assert got == {i: library(t) if t else [] for i, t in enumerate(texts)}
    assert token_ids.encode_column(d.limit(0)).isEmpty()


def test_forced_boundaries_never_lie_inside_a_token():
    e = token_ids.encoder(token_ids.default_vocabulary())
    assert e.fragments(b"") == [b""] and b"".join(e.fragments("naïve日本語 text".encode())) == "naïve日本語 text".encode()
    assert all(len(e.fragments(t)) == 1 for t in list(e.ranks)[:20_000])


def test_profiles_find_structure(spark, small):
    words = profiles.dictionary(spark.read.parquet(f"{small}/wordlist.parquet"))
    fitted = profiles.fit_profiles(spark.read.parquet(f"{small}/golden_train.parquet"), words)
    prose = "The river was closed for the winter and the people of the town walked along it. It had been the same in the years before, but this time they had no boat."
    table = "\n".join("a1b2,17,3.5,x_y" for _ in range(12))
    d = spark.createDataFrame([(1, prose), (2, table), (3, None), (4, " "), (5, prose + "\n\n" + table[:40]), (6, table + "\n\n" + prose[:40])], "doc_id long, text string")
    s = {r["id"]: r["prose_share"] for r in profiles.structure(d, fitted, words).collect()}
    assert set(s) == {1, 2, 5, 6} and s[1] > 0.5 and s[2] < 0.5 and s[5] > 0.5 and s[6] < 0.5
    assert profiles.structure(d.limit(0), fitted, words).isEmpty()


def test_profile_statistics(spark, small):
    words = profiles.Dictionary([("the", "en", 1), ("and", "en", 2), ("river", "en", None)])
    fitted = profiles.fit_profiles(spark.read.parquet(f"{small}/golden_train.parquet"), words)
    texts = ["The river rose, and the\ntown said: \"No more!\"\r\n\r\n  12 a_b\rEnd.", None, "", " \n\t", "###", "The river.\n\nThe the and xyz"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in profiles.structure(d, fitted, words, statistics=True).collect()}
    assert set(got) == set(range(6))
    r = got[0]
    assert (r["n_words"], r["n_paragraphs"], r["line_end_ratio"]) == (13, 2, 0.5) and r["mean_word_length"] == pytest.approx(39 / 13) and r["common_word_ratio"] == pytest.approx(3 / 13)
    assert got[5]["common_word_ratio"] == pytest.approx(4 / 6) and got[5]["dictionary_word_ratio"] == pytest.approx(5 / 6) and got[5]["line_end_ratio"] == 0.5
    for i in (1, 2, 3):
        assert [got[i][c] for c in ("profile", "divergence", "prose_share")] == [None] * 3
        assert [got[i][c] for c in ("n_paragraphs", "n_words", "mean_word_length", "line_end_ratio", "common_word_ratio", "symbol_ratio", "dictionary_word_ratio")] == [0] * 7
    assert got[4]["n_words"] == 0 and got[4]["profile"] and got[4]["symbol_ratio"] > 0 and got[4]["line_count"] == 1
    plain = {x["id"]: x for x in profiles.structure(d, fitted, words).collect()}
    assert set(plain) == {0, 4, 5} and all(plain[i][c] == got[i][c] for i in plain for c in plain[i].asDict())
    assert profiles.structure(d.where("doc_id in (1, 2)"), fitted, words, statistics=True).count() == 2


def test_profiles_query_gives_every_document_its_statistics(spark, small):
    from prosewright.llm.queries import p7_profiles

    got, docs = p7_profiles(spark, small), spark.read.parquet(f"{small}/documents.parquet")
    assert {*profiles.STORED, "n_words", "mean_word_length", "line_end_ratio", "common_word_ratio"} <= set(got.columns) and got.count() == docs.count()


def test_divergence():
    p = np.array([[0.5, 0.5], [1.0, 0.0]])
    assert profiles.divergence(p, p).round(6).tolist() == [[0.0, 0.311278], [0.311278, 0.0]]


def test_residue(spark):
    sentence = "The {} bridge was measured in the {} and nobody minded the longer way home that year."
    normal = [(i, " ".join(sentence.format(a, b) for a in ("old", "new") for b in (f"spring{i}", "autumn"))) for i in range(80)]
    cases = [
        (1000, "404 Not Found"), (1001, "Please enable JavaScript to view this page."), (1002, "Dear {{ first_name }},\n\n" + sentence.format("old", "spring")), (1003, "Lorem ipsum dolor sit amet consectetur."),
        (1004, "HTTP 503: Service unavailable\nThe page x_1 is resting now."), (1005, "404 Not Found\n\nThe page x_2 is resting now."), (1006, "HTTP 404: Page missing\nThe page x_3 is resting now."), (1007, "The page x_4 is resting now."),
        (1008, "Your text goes here."), (1009, "The seat for [YOUR NAME] is kept until noon."),
        (1010, '"We {0} the visitor," said the guide, "and left the town in the evening." ' + sentence.format("old", "spring")), (1011, "Too many requests from your network."),
    ]
    plain = [
        (2000, "from jinja import Template\nx = Template('Hello {{ name }}')\ny = render(x)\nprint(y)"), (2001, "\n".join(f"10.0.0.{i} - - [2024-01-01 10:00:00] \"GET /a HTTP/1.1\" 404 12" for i in range(9))),
        (2002, sentence.format("old", "spring") + ' Printers used the words "lorem ipsum" to test the page long before anyone wrote the real text for the books they sold in the town. ' + sentence.format("new", "autumn")),
        (2003, None), (2004, ""), (2005, " "),
    ]
    d = spark.createDataFrame(normal + cases + plain, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["id"] for r in residue.template_residue(d).collect()}
    assert {i for i, _ in cases} - {1007} <= got and not got & {i for i, _ in normal + plain}
    assert residue.template_residue(d.limit(0)).isEmpty()


def test_residue_in_long_paragraphs(spark):
    """Messages in a long paragraph or a page squeezed to one line are found; the same ones quoted there are not."""
    r, words = random.Random(8), "old harbour bridge river market winter garden letter baker sailor field morning stone lantern".split()
    sentence = lambda: "The " + " ".join(r.choices(words, k=9)) + " stayed."
    messages = ["Please enable JavaScript to view this page.", "Too many requests from your network.", "Access denied by the server."]
    quoting = "The sign on the door said \"{}\" and people wrote about it."
    rows = [(i, messages[i % 3]) for i in range(90)] + [(100 + i, " ".join(sentence() for _ in range(8))) for i in range(300)]
    found = [(1000 + i, " ".join([sentence(), sentence(), sentence(), m, sentence(), sentence()])) for i, m in enumerate(messages)]
    found += [(1003, " ".join([*(sentence() for _ in range(5)), "Sed elit magna tempor labore sit aliqua."]))]
    quoted = [(2000 + i, " ".join([sentence(), sentence(), sentence(), quoting.format(m[:-1]), sentence(), sentence()])) for i, m in enumerate(messages)]
    d = spark.createDataFrame(rows + found + quoted, "doc_id long, text string")
    got = {x["id"] for x in residue.template_residue(d).collect()}
    assert got == {*range(90), *(i for i, _ in found)}


def test_residue_in_records_of_shaped_lines(spark):
    """A template below program text and a message among records are found; the code's own templates and logged errors aren't."""
    r, words = random.Random(9), "old harbour bridge river market winter garden letter baker sailor field morning stone lantern".split()
    code = lambda: "\n".join(f"def f{r.randrange(99)}(x): return '{{{{ name }}}}' + x[{r.randrange(9)}]" for _ in range(5))
    log = lambda: "\n".join(f"2024-01-0{r.randrange(1, 9)} 10:00:0{r.randrange(9)} worker: 404 Not Found /a{r.randrange(99)}" for _ in range(5))
    plain = [(i, code() if i % 2 else log()) for i in range(60)] + [(1000 + i, " ".join("The " + " ".join(r.choices(words, k=9)) + " stayed." for _ in range(8))) for i in range(300)]
    residue_ = [(200 + i, ["Dear {{ first_name }},\n\nYour visit is kept until noon.", "Please enable JavaScript to view this page.", "Too many requests from your network."][i % 3]) for i in range(60)]
    mixed = [(300, code() + "\n\nDear {{ first_name }},\n\nYour visit is kept until noon."), (301, log() + "\n\nPlease enable JavaScript to view this page.")]
    d = spark.createDataFrame(plain + residue_ + mixed, "doc_id long, text string")
    got = {x["id"] for x in residue.template_residue(d).collect()}
    assert got == {i for i, _ in residue_ + mixed}


def test_residue_learning_must_settle(spark):
    d = spark.createDataFrame([(i, "Access denied." if i % 3 else "The harbour was measured again in the spring.") for i in range(30)], "doc_id long, text string")
    with pytest.raises(RuntimeError):
        residue.residue_scores(d, most_steps=1)
