import random
import re

import pytest
from pyspark.sql import functions as F
from vectide.llm import decontam, licenses, mixing, native

PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(t):
    return re.findall(PLAIN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_words_of_every_character(spark):
    rows = [("".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) + "AbZ",) for a in range(0, 0x110000, 64)]
    cut = spark.createDataFrame(rows, "text string").withColumn("words", native.words(F.col("text")))
    plain = F.regexp_extract_all(F.translate("text", native.UPPER, native.LOWERED), F.lit(native.WORD), F.lit(0))
    assert cut.filter(F.col("words") != plain).count() == 0


def test_hits_match_brute_force(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short phrase"), (3, None), (10, "A b c d e f g h i j")]
    docs = [(1, "x One two, three four five six seven eight nine ten eleven y"), (2, "short-phrase short phrase"), (3, None), (4, "a b c d e f g h i j a b c d e f g h i j"), (5, "two three four"), (6, ""), (6, "short phrase")]
    got = decontam.contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, t in docs:
        w, hit, who = tokens(t), set(), set()
        for item, u in items:
            v = tokens(u)
            size = min(10, len(v))
            for s in range(len(v) - size + 1 if size else 0):
                for k in range(len(w) - size + 1):
                    if w[k : k + size] == v[s : s + size]:
                        hit |= set(range(k, k + size))
                        who.add(str(item))
        want.append((i, len(w), len(hit), len(who), bool(hit)))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got), key=key) == sorted(want, key=key)


def test_proximity_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{int(40 * rng.random() ** 3)}" for _ in range(200)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.choice([1, 2, 4, 6]))) for k in range(12)]
    docs = [(k, make(rng.randrange(60))) for k in range(60)] + [(60, items[3][1]), (60, "w1 w1"), (None, items[3][1])]
    often = {}
    for _, t in docs:
        for w in tokens(t):
            often[w] = often.get(w, 0) + 1
    want = set()
    for item, u in items:
        v = tokens(u)
        for window in (v[s : s + 4] for s in range(len(v) - min(4, len(v)) + 1)):
            ranked = sorted((often.get(w, 0), w, k) for k, w in enumerate(window))
            if not ranked[0][0]:
                continue
            rare, other = ranked[0][1], ranked[min(1, len(ranked) - 1)][1]
            for i, t in docs:
                w = tokens(t)
                if any(w[a] == rare and w[b] == other and abs(a - b) < 4 and (a != b or len(window) == 1) for a in range(len(w)) for b in range(len(w))):
                    want.add((i, t, str(item)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    mark = {r["mark"]: r["text"] for r in frame.select("text", F.xxhash64("text").alias("mark")).collect()}
    found = decontam.proximity(spark, frame, spark.createDataFrame(items, "item_id long, text string"), within=4)
    assert {(r["doc_id"], mark[r["mark"]], r["item"]) for r in found.collect()} == want and len(want) > 20


def test_a_passage_in_many_rows_is_found_in_each(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(k, f"a{k} {passage} b{k}" if k % 3 else f"a{k} plain") for k in range(600)], "doc_id long, text string")
    got = decontam.contamination(spark, docs, spark.createDataFrame([(5, passage + " eleven")], "item_id long, text string")).collect()
    assert len(got) == 600 and all((r["n_hit"], r["contaminated"]) == ((10, True) if r["doc_id"] % 3 else (0, False)) for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "phrase or short"), (2, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(2, "short phrase")], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.proximity(spark, docs, items).collect()} == {1}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(7, "quick brown fox"), (None, "the lazy dog")], "item_id long, text string")
    got = decontam.contamination(spark, odd, items).collect()
    assert len(got) == 13 and {r["doc_id"] for r in got if r["contaminated"]} == {1, 2, 6, 10, None}
    assert decontam.contamination(spark, none, items).count() == 0
    assert decontam.contamination(spark, odd, items.limit(0)).filter("contaminated").count() == 0
    assert len(licenses.scan(spark, odd).collect()) == 13 and licenses.scan(spark, none).count() == 0


def test_licences(spark):
    docs = [(1, "Released under the MIT License."), (2, "CC-BY and all rights, reserved; cc by"), (3, "the mit of license"), (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"), (5, None)]
    by = {r["doc_id"]: r for r in licenses.scan(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert by[1]["labels"] == "mit" and by[1]["n_base"] == 0 and by[3]["labels"] == "" and by[5]["n_words"] == 0
    assert (by[2]["n_base"], by[2]["first_word"], by[2]["last_word"], by[2]["base_labels"]) == (3, 0, 6, "cc-by,reserved")
    assert by[4]["labels"] == "mit" and 0 < by[4]["score"] <= 1


def test_base_phrases_match_brute_force(spark):
    rng = random.Random(7)
    parts = ["cc", "by", "CC-BY", "general", "public", "license", "General Public License", "all", "rights", "reserved", "All rights, reserved", "é", "nc", "4.0", "mit"]
    docs = [(k, "".join(rng.choice(parts) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(rng.randrange(40)))) for k in range(150)] + [(150, None), (7, "cc by")]
    got = licenses.scan(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = []
    for i, t in docs:
        w = tokens(t)
        at = [(k, label) for label, phrase in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({label for _, label in at}))))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got)


def shares(found, axis):
    """Each value's share of the sample's expected tokens."""
    got, whole = {}, sum(r["p"] * r["n_tokens"] for r in found)
    for r in found:
        got[r[axis]] = got.get(r[axis], 0) + r["p"] * r["n_tokens"] / whole
    return got


def test_marginals_are_met_by_the_sample(spark):
    rows = [(k, "w " * (1 + k % 5), "en" if k % 3 else "de", "a" if k % 2 else "b", 1) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    goal = {"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 1.0}}
    targets = {axis: spark.createDataFrame(list(v.items()), f"{axis} string, target double") for axis, v in goal.items()}
    found = mixing.mixed(spark, docs, targets, budget=0.4).collect()
    for axis, v in goal.items():
        assert shares(found, axis) == pytest.approx(v, abs=1e-6)
        assert {x: sum({(r["source"], r["lang"]): r["weight"] for r in found if r[axis] == x}.values()) for x in v} == pytest.approx(v, abs=1e-6)
    whole = sum(r["n_tokens"] for r in found)
    assert sum(r["p"] * r["n_tokens"] for r in found) / whole == pytest.approx(0.4, abs=1e-6) and found[0]["residual"] <= mixing.TOLERANCE
    # A budget beyond what the targets allow gives way to them.
    found = mixing.mixed(spark, docs, targets, budget=1.0).collect()
    assert all(shares(found, axis) == pytest.approx(v, abs=1e-6) for axis, v in goal.items()) and max(r["p"] for r in found) <= 1
    assert 0.4 < sum(r["p"] * r["n_tokens"] for r in found) / whole < 1


def test_targets_without_tokens_and_values_without_targets(spark):
    rows = [(k, "w w" if k < 90 else None, "en", "abc"[k % 3], 1) for k in range(99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    goal = {"source": [("a", 0.2), ("b", 0.2), ("z", 0.6)], "lang": [("en", 1.0)], "topic": [("prose", 1.0)]}
    found = mixing.mixed(spark, docs, {axis: spark.createDataFrame(v, f"{axis} string, target double") for axis, v in goal.items()}).collect()
    assert shares(found, "source") == pytest.approx({"a": 0.5, "b": 0.5, "c": 0.0}) and len(found) == 99
    # Targets that can't be met together leave a residual, and an end.
    apart = spark.createDataFrame([(k, "w", "de" if k < 50 else "en", "a" if k < 50 else "b", 1) for k in range(100)], docs.schema)
    goal = {"source": [("a", 0.9), ("b", 0.1)], "lang": [("de", 0.1), ("en", 0.9)], "topic": [("prose", 1.0)]}
    found = mixing.mixed(spark, apart, {axis: spark.createDataFrame(v, f"{axis} string, target double") for axis, v in goal.items()}).collect()
    assert len(found) == 100 and found[0]["residual"] > 0.1


def test_many_cells_are_raked_alike(spark, monkeypatch):
    rows = [(k, "w " * (1 + k % 7), ("en", "de", "fr")[k % 3], f"s{k * k % 41}", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    take = lambda: {r["row"]["doc_id"]: (round(r["p"], 9), r["sampled"]) for r in mixing.mixed(spark, docs, carry=("doc_id",)).collect()}
    one = take()
    monkeypatch.setattr(mixing, "ONE_TASK", 3)
    assert take() == one and len({p for p, _ in one.values()}) > 40


def test_mixing_odd_rows(spark, odd, none):
    got = mixing.mixed(spark, odd).collect()
    assert len(got) == 13 and mixing.mixed(spark, none).count() == 0
    assert set(mixing.sample(spark, odd).columns) == set(odd.columns)
    assert mixing.mixed(spark, odd.filter("text = ''")).first()["p"] == mixing.BUDGET
