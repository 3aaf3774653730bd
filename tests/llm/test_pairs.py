"""Near-duplicates, cross-split overlaps and leaked passages against brute force; edge cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prosewright.llm import leakage, near_dup, overlap

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "nar tel vis rok pum dal".split()]


def bag(t):
    return Counter(re.findall(r"[^\W_]+", (t or "").lower()))


def similarity(a, b):
    x, y = bag(a), bag(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def long_enough(t):
    return sum(bag(t).values()) >= 40


def corpus(n, seed):
    """Random texts, each with some reworked copies: words replaced, moved, dropped, added; plus blanks and short ones."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = [r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.6 else "") for _ in range(r.randint(40, 120))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 6)):
                k = r.randrange(len(w))
                w[k] = r.choice(["x" + str(r.randrange(999)), w[k]])
            if r.random() < 0.3:
                h = r.randrange(len(w))
                w = w[h:] + w[:h]
            out.append((", " if r.random() < 0.5 else "\n").join(w).title() if r.random() < 0.3 else " ".join(w))
    return out + [None, "", " \n", "too short", out[0], out[0]]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(corpus(60, 1), 100))


def frame(spark, rows, id_="row_id"):
    return spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows], f"{id_} long, text string, cls string, a double")


def test_near_duplicates_equal_brute_force(spark, rows):
    got = {tuple(r) for r in near_dup.row_pairs(*near_dup.near_duplicates(frame(spark, rows).select("row_id", "text"))).collect()}
    ok = [(i, t) for i, t in rows if t and long_enough(t)]
    want = {(i, j) for k, (i, t) in enumerate(ok) for j, u in ok[k + 1 :] if similarity(t, u) >= 0.7}
    assert got <= want and len(want - got) <= 0.01 * len(want) and len(want) > 50


def test_near_duplicate_groups(spark, rows):
    g = {r["id"]: (r["group_id"], r["n_links"]) for r in near_dup.near_duplicate_groups(frame(spark, rows)).collect()}
    assert set(g) == {i for i, t in rows if t and long_enough(t)}
    pairs = near_dup.row_pairs(*near_dup.near_duplicates(frame(spark, rows))).collect()
    assert all(g[r["row_id_a"]][0] == g[r["row_id_b"]][0] for r in pairs)
    assert all(v[0] <= k for k, v in g.items())


def test_near_duplicates_of_nothing(spark, rows):
    for d in (frame(spark, rows).limit(0), frame(spark, [(1, None), (2, "short")])):
        members, links = near_dup.near_duplicates(d)
        assert members.isEmpty() and links.isEmpty() and near_dup.row_pairs(members, links).isEmpty()


def test_copies_are_one_class(spark):
    t = " ".join(f"w{i}" for i in range(50))
    members, links = near_dup.near_duplicates(frame(spark, [(i, t if i % 2 else t.upper()) for i in range(30)]))
    assert members.select("cls").distinct().count() == 1 and links.isEmpty() and members.count() == 30


def test_very_long_text(spark):
    t = " ".join(f"w{i % 5000}" for i in range(60_000))
    got = near_dup.row_pairs(*near_dup.near_duplicates(frame(spark, [(1, t), (2, t + " more")]))).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_odd_sketch_tracks_similarity():
    import numpy as np

    from prosewright.functions.words import WordCodes

    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join(base[k:] + [f"n{j}" for j in range(k)]) for k in (5, 20, 60, 200)]
    t = near_dup.Texts(texts, WordCodes(), 40)
    mul, add, _ = near_dup._parameters(1)
    s = near_dup.odd_sketches(near_dup.minhashes(t.tokens, t.starts, mul, add))
    pops = [int(np.bitwise_count(s[0] ^ x).sum()) for x in s[1:]]
    assert pops == sorted(pops) and pops[0] < near_dup.MAX_POP < pops[-1]


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_a_hot_text_is_one_class(spark, rows, monkeypatch, broadcast):
    """Nine tenths of the rows are copies of one text."""
    monkeypatch.setattr(near_dup, "BROADCAST_CLASSES", broadcast)
    texts = [t for _, t in rows if t and long_enough(t)][:40]
    d = frame(spark, [(i, texts[0] if i % 10 else texts[i // 10]) for i in range(400)]).repartition(5)
    members, links = near_dup.near_duplicates(d)
    assert members.groupBy("cls").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] >= 360
    want = {(min(a, b), max(a, b)) for a in texts for b in texts if a != b and similarity(a, b) >= 0.7 and bag(a) != bag(b)}
    assert links.count() <= len(want) and members.count() == 400
    with pytest.raises(ValueError):
        near_dup.near_duplicates(d, threshold=0.5)


def test_overlaps_equal_brute_force(spark, rows):
    train = frame(spark, rows[: len(rows) // 2 + 20])
    evals = frame(spark, [(i - 100, t) for i, t in rows[len(rows) // 3 :]], "sample_id").drop("a")
    got = {(r["sample_id"], r["row_id"]) for r in overlap.cross_split_overlaps(evals, train).collect()}
    ok = lambda xs: [(i, t) for i, t in xs if t and long_enough(t)]
    want = {(i - 100, j) for i, t in ok(rows[len(rows) // 3 :]) for j, u in ok(rows[: len(rows) // 2 + 20]) if similarity(t, u) >= 0.7}
    assert got <= want and len(want - got) <= 0.02 * len(want) and len(want) > 30


def test_overlaps_with_no_passage_intact(spark):
    """Edits that break all or nearly all passages: a new word at every sixth place, new words anywhere, words in another order."""
    r, evals, train = random.Random(3), [], []
    for i in range(60):
        base = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.choice([40, 41, 77, 120]))]
        kinds = ([f"new{i}x{k}" if k % 6 == 3 else w for k, w in enumerate(base)], [f"new{i}x{k}" if r.random() < 0.17 else w for k, w in enumerate(base)], r.sample(base, len(base)))
        evals.append((i, " ".join(kinds[i % 3])))
        train.append((1000 + i, " ".join(base)))
    got = {(x["sample_id"], x["row_id"]) for x in overlap.cross_split_overlaps(frame(spark, evals, "sample_id"), frame(spark, train)).collect()}
    want = {(i, j) for i, t in evals for j, u in train if similarity(t, u) >= 0.7}
    assert got == want and len(want) > 45


def test_prefix_index_loses_no_pair(monkeypatch):
    import numpy as np

    from prosewright.functions.words import WordCodes

    monkeypatch.setattr(overlap, "LOOKUP_ENTRIES", 50)
    r = random.Random(9)
    texts = []
    for _ in range(40):
        base = [r.choice(WORDS[:20]) for _ in range(r.randint(40, 60))]
        texts += [" ".join(base), " ".join(base[r.randint(0, 16) :] + ["q"] * r.randint(0, 12))]
    texts = [t for t in texts if long_enough(t)]
    t = near_dup.Texts(texts, WordCodes(), 40)
    short = (t.tokens >> np.uint64(32)).astype(np.uint32)
    for threshold in (0.5, 0.7, 1.0):
        index = overlap.PrefixIndex([short[a : a + n] for a, n in zip(t.starts, t.lengths)], threshold, step=7)
        got = set(zip(*(x.tolist() for x in index.candidates(short, t.lengths))))
        want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if similarity(a, b) >= threshold}
        assert want <= got and len(want) >= len(texts)


def _one_vocabulary(r, n, near):
    """Evaluation and training texts of the same 220 words, alike by 0.2 to 0.5, but for the first `near` of each, which are reworked."""
    texts = [[r.choice(WORDS) + str(int(r.paretovariate(1)) % 9) for _ in range(r.randint(60, 90))] for _ in range(2 * n)]
    for i in range(near):
        texts[n + i] = [w if r.random() > 0.12 else r.choice(texts[-1]) for w in texts[i]]
    return [" ".join(x) for x in texts[:n]], [" ".join(x) for x in texts[n:]]


def test_texts_of_one_vocabulary_are_seldom_candidates():
    import numpy as np

    from prosewright.functions.words import WordCodes

    evals, train = _one_vocabulary(random.Random(4), 400, 40)
    e, t = (near_dup.Texts(x, WordCodes(), 40) for x in (evals, train))
    a, b = ((x.tokens >> np.uint64(32)).astype(np.uint32) for x in (e, t))
    index = overlap.PrefixIndex([a[s : s + n] for s, n in zip(e.starts, e.lengths)], 0.7)
    got = {(int(j), int(i)) for i, j in zip(*index.candidates(b, t.lengths))}
    want = {(j, i) for j, x in enumerate(evals) for i, y in enumerate(train) if similarity(x, y) >= 0.7}
    assert want <= got and len(want) > 20 and len(got) < 0.005 * 400 * 400


def test_many_candidates_and_very_long_texts(tmp_path, monkeypatch):
    """A shard's file gives what its texts say; lookups are halved where candidates are many; lengths beyond 65535 words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from prosewright.functions.words import WordCodes

    r = random.Random(6)
    evals, train = _one_vocabulary(r, 60, 30)
    long = [f"u{k}" for k in range(70_000)]
    evals += [" ".join(long), evals[0]]
    train += [" ".join(long[: 60_000] + ["z"] * 20), " ".join(long[: 40_000]), evals[0], evals[0] + " more"]
    e, t = (near_dup.Texts(x, WordCodes(), 40) for x in (evals, train))
    (tmp_path / "e/shard=3").mkdir(parents=True)
    codes = [e.codes[s : s + n].tobytes() for s, n in zip(e.starts, e.lengths)]
    pq.write_table(pa.table({"cls": e.classes(), "codes": pa.array([*codes[:-1], None], pa.binary())}), tmp_path / "e/shard=3/x.parquet")
    counts = np.ones(overlap.COUNTS, np.uint16)  # any order of words will do
    overlap._Shard.build(str(tmp_path / "e"), 3, f"file://{tmp_path}/built/one", 0.7, counts)
    s, short = overlap._Shard(f"file://{tmp_path}/built/one", 0.7, counts), (t.tokens >> np.uint64(32)).astype(np.uint32)
    cls = e.classes().tolist()
    want = {(i, cls[j]) for j, x in enumerate(evals) for i, y in enumerate(train) if similarity(x, y) >= 0.7}
    assert len(want) > 15 and (60, cls[60]) in want and (61, cls[60]) not in want
    for pairs, parts in ((1 << 22, 1), (1, 8)):
        monkeypatch.setattr(overlap, "LOOKUP_PAIRS", pairs)
        monkeypatch.setattr(overlap, "LEAST_TEXTS", 4)
        found = list(overlap._near(s, t, short, overlap.histograms(t), overlap.Lookup(short, t.lengths, 0.7, counts), 0.7, counts))
        got = set()
        for own, ev in found:
            keep, _ = overlap._similar(s, t, short, own, ev, 0.7)
            got |= {(int(own[k]), int(s.cls[ev[k]])) for k in keep}
        assert got == want and len(found) >= parts


def test_overlaps_of_nothing(spark, rows):
    some = frame(spark, rows[:5])
    for e, g in ((some.limit(0), some), (some, some.limit(0)), (frame(spark, [(1, None)]), some)):
        assert overlap.cross_split_overlaps(e.withColumnRenamed("row_id", "sample_id"), g).isEmpty()


def test_coverage_of_evaluation_texts(spark):
    base = [f"w{k}" for k in range(60)]
    evals = frame(spark, [(1, " ".join(base)), (2, " ".join(base[:30] + ["new"] + base[31:]))], "sample_id")
    train = frame(spark, [(10, " ".join(base)), (11, " ".join(["x"] * 8 + base)), (12, " ".join(base[30:] + base[:30])), (13, " ".join(base[::-1]))])
    got = {(r["sample_id"], r["row_id"]): r["coverage"] for r in overlap.cross_split_overlaps(evals, train).collect()}
    assert got == {(1, 10): 1, (1, 11): 1, (1, 12): 1, (1, 13): 0, (2, 10): pytest.approx(59 / 60, abs=1e-6), (2, 11): pytest.approx(59 / 60, abs=1e-6), (2, 12): pytest.approx(59 / 60, abs=1e-6), (2, 13): 0}


def test_overlaps_of_hot_texts(spark):
    """Nine tenths of both sides are copies of one text."""
    base = " ".join(f"w{k}" for k in range(50))
    rows = lambda n, at: [(at + i, base if i % 10 else " ".join(f"v{i}x{k}" for k in range(50))) for i in range(n)]
    got = overlap.cross_split_overlaps(frame(spark, rows(60, 0), "sample_id"), frame(spark, rows(100, 1000)).repartition(4))
    assert got.count() == 54 * 90 + 6


def test_overlap_shards_agree(spark, rows, monkeypatch):
    d = frame(spark, rows[:80])
    e = d.withColumnRenamed("row_id", "sample_id")
    one = overlap.cross_split_overlaps(e, d).select("sample_id", "row_id")
    monkeypatch.setattr(overlap, "SHARD_WORDS", 1500)
    many = overlap.cross_split_overlaps(e, d).select("sample_id", "row_id")
    assert not [r for r in overlap.cross_split_overlaps(e, d).where("similarity = 1 and sample_id = row_id").collect() if r["coverage"] != 1]
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty() and not one.isEmpty()


def _leaks(items, docs, n):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(x[k : k + n]) for x in [w(t)] for k in range(len(x) - n + 1)}
    return {(i, d) for i, t in items for d, u in docs if grams(t) & grams(u)}


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    items = [(i, " ".join(r.choices(WORDS, k=30))) for i in range(12)] + [(90, None), (91, "a b"), (92, " ".join("a" * 1 for _ in range(20)))]
    docs = []
    for d in range(60):
        words = r.choices(WORDS, k=40)
        if d % 3 == 0:
            k = r.randint(10, 16)
            a = r.randrange(30 - k)
            words[5:5] = items[d % 12][1].split()[a : a + k]
        docs.append((1000 + d, (" ".join(words) if d % 2 else ",\n ".join(words)).title()))
    docs += [(2000, None), (2001, ""), (2002, "a " * 15), (2003, "a " * 12), (2004, items[0][1]), (2005, "x" + items[0][1] + "y")]
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["item_id"], x["doc_id"]) for x in leakage.leaked_passages(d, i).collect()}
    assert got == _leaks(items, docs, 13)
    assert (92, 2002) in got and (92, 2003) not in got


def _edits(a, text):
    """The least edits with which a stands anywhere in text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def _edited(r, text, n):
    """n single-character edits, spread evenly."""
    at = [round((k + 0.5) * len(text) / n) for k in range(n)]
    for k in reversed(at):
        kind = r.randrange(3)
        text = text[:k] + ("" if kind == 0 else r.choice("qxz")) + text[k + (kind < 2) :]
    return text


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_leaks_with_edits_equal_brute_force(spark, edits):
    r = random.Random(edits)
    short = ["a", "bo", "cat", "dune", "el", "fir", "go", "hi", "ink", "jo", "kit", "lo"]
    items = [(i, " ".join(r.choices(short if i % 2 else WORDS, k=13 + i % 3))) for i in range(16)]
    docs = []
    for d in range(64):
        w = " ".join(items[d % 16][1].split()[:13])
        docs.append((1000 + d, " ".join(r.choices(WORDS, k=6)) + " " + _edited(r, w, 1 + d // 16) + " " + " ".join(r.choices(WORDS, k=6))))
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["item_id"], x["doc_id"]) for x in leakage.leaked_passages(d, i, edits=edits, exact=False).collect()}
    flat = {x: " ".join(re.findall(r"[^\W_]+", t.lower())) for x, t in docs}
    want = set()
    for k, t in items:
        w = t.split()
        for s in range(len(w) - 12):
            want |= {(k, x) for x, u in flat.items() if (k, x) not in want and x % 1000 % 16 == k and _edits(" ".join(w[s : s + 13]), u) <= edits}
    assert got >= want and {g for g in got if g[1] % 1000 % 16 == g[0]} == want
    assert len(want) >= 14 * edits
    assert all(any(_edits(" ".join(dict(items)[k].split()[s : s + 13]), flat[x]) <= edits for s in range(len(dict(items)[k].split()) - 12)) for k, x in got - want)


def test_leaks_with_edits(spark):
    item = "the old harbour wall was measured again in spring and found to be sound by all who looked at it closely"
    doc = "They say the old harbour wal was measured again in spring and found to be sound by all who lookd at it closely indeed"
    i, d = spark.createDataFrame([(1, item)], "item_id long, text string"), spark.createDataFrame([(5, doc), (6, "nothing of the kind here at all")], "doc_id long, text string")
    assert [tuple(r) for r in leakage.leaked_passages(d, i, edits=2, q=8, exact=False).collect()] == [(1, 5, 21)]
    assert [tuple(r) for r in leakage.leaked_passages(d, i).collect()] == [(1, 5, 13)]


def test_leaks_with_many_hits(spark, monkeypatch):
    """A text that repeats what every item holds is taken up a few items at a time."""
    monkeypatch.setattr(leakage, "HITS", 500)
    same = " ".join(WORDS[:20])
    items = [(k, same + f" end{k}") for k in range(9)] + [(9, "b " * 30)]
    docs = [(100, (same + " ") * 12), (101, "b " * 400), (102, same), (103, "b " * 12)]
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {(x["item_id"], x["doc_id"]) for x in leakage.leaked_passages(d, i).collect()}
    assert got == {(k, x) for k in range(9) for x in (100, 102)} | {(9, 101)}


def test_leaks_of_nothing(spark):
    i, d = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert leakage.leaked_passages(d, i).isEmpty() and leakage.leaked_passages(d.limit(0), i).isEmpty()
    with pytest.raises(ValueError):
        leakage.leaked_passages(d, i, min_words=5, q=24)


def test_item_blocks(spark):
    item = " ".join(WORDS[:20])
    i = spark.createDataFrame([(k, item) for k in range(6)], "item_id long, text string")
    d = spark.createDataFrame([(1, item)], "doc_id long, text string")
    assert leakage.leaked_passages(d, i, max_items_mb=0.0001).count() == 6
    assert leakage.leaked_passages(d.union(d), i).count() == 6


def test_hot_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Texts that differ by one word each share their buckets; with small limits these are put aside and cut into blocks."""
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:30] + [f"n{k}"] + base[30:])) for k in range(120)]
    monkeypatch.setattr(near_dup, "HOT", 25)
    monkeypatch.setattr(near_dup, "HELD_MB", 0.01)
    got = {tuple(r) for r in near_dup.row_pairs(*near_dup.near_duplicates(frame(spark, rows).repartition(6))).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120)}
