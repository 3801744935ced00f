import random
import re

import numpy as np
from vectide.llm import exact, jaccard


def test_fingerprints_combine():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    whole = 0
    for b in data.tolist():
        whole = (whole * exact.BASE + b + 1) % exact.PRIME
    assert exact.fingerprints(data, np.array([0, len(data)]))[0] == whole
    parts = [exact.chunk_hashes(data, np.array([a]), np.array([b]))[0] for a, b in ((0, 5), (5, 60_000))]
    assert exact.combine((parts[0], 5), (parts[1], 59_995))[0] == exact.chunk_hashes(data, np.array([0]), np.array([60_000]))[0]


def test_collisions_are_told_apart(spark):
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "cc", "aa", ""])]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), modulus=1).collect()}
    assert got == {0: (6, 3, False), 2: (6, 3, False), 6: (6, 3, True), 1: (4, 2, False), 4: (4, 2, True), 3: (5, 2, False), 5: (5, 2, True), 7: (7, 1, True)}


def test_long_texts_are_compared_beyond_their_first_chunk(spark):
    """Copies of several chunks, and texts that differ in the last one alone, with one fingerprint for all and without."""
    long = "é long line of text " * 5000
    rows = [(1, long), (2, long), (2, long), (3, long[:-1] + "x"), (4, long[:-1] + "y"), (5, "short"), (None, long), (None, "none"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 1, True), (None, 2, 4, False), (None, None, 2, True), (None, None, 2, True)], key=str)
    for options in ({}, {"modulus": 1}, {"huge": 30_000}, {"huge": 30_000, "modulus": 1}):
        got = exact.exact_duplicates(spark, docs, **options).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str) == want, options


def test_one_large_group(spark):
    docs = spark.createDataFrame([(k, "the same" if k % 3 else f"other {k}") for k in range(3000)], "doc_id long, text string")
    got = exact.exact_duplicates(spark, docs).filter("group_size > 1").collect()
    assert len(got) == 2000 and {(r["keep_id"], r["group_size"]) for r in got} == {(2999, 2000)}


def test_odd_rows(spark, odd, none):
    got = exact.exact_duplicates(spark, odd).collect()
    assert len(got) == 13 and exact.exact_duplicates(spark, none).count() == 0
    by = {(r["doc_id"]): r for r in got}
    assert by[1]["keep_id"] == 2 and by[1]["group_size"] == 4 and by[3]["keep_id"] == 4 and by[None]["kept"] is False


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(12):
        source = [rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 30, 80, 160]))]
        for _ in range(rng.choice([1, 3, 40])):
            copy = list(source)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):  # chains, and copies on both sides of the threshold
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                source = copy
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == brute(rows)


def test_one_id_on_two_texts_keeps_the_links_of_both(spark):
    texts = {c: [f"{c}{k}" for k in range(40)] for c in "xy"}
    near = {c: " ".join([*t[:-1], "z"]) for c, t in texts.items()}
    rows = [(1, " ".join(texts["x"])), (1, " ".join(texts["y"])), (2, near["x"]), (3, near["y"]), (4, " ".join(texts["y"])), (5, "x0 y0")]
    documents, links = jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in documents.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    assert sorted(sorted((r["a"], r["b"])) for r in links.collect()) == [[1, 2], [1, 3]]


def test_rows_without_ids_link_like_others(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:-1], "x"])), (9, " ".join([*words[:-1], "y"])), (None, "v0 v1 v2 v3 v4 v5"), (None, "V0 v1 v2 v3 v4 v5")]
    got = jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert sorted((str(r["component_id"]), r["n_shingles"]) for r in got) == [("9", 36)] * 3 + [("None", 2)] * 2
    assert len({r["component"] for r in got}) == 2


def test_sets_of_many_sizes_in_hot_lists(spark):
    """A passage in all rows, more or less of each row: links of different sizes and positions, none lost."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(160):
        size, own = rng.choice([20, 40, 50, 55, 60]), rng.randrange(14)
        rows.append((k, " ".join([f"o{rng.randrange(30)}" for _ in range(own)] + passage[:size])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == brute(rows)


def test_odd_sets(spark, odd, none):
    got = jaccard.jaccard_components(spark, odd)[0].collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 13 and by[10]["component_id"] == by[6]["component_id"] == by[None]["component_id"] == 1
    assert by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[7]["n_shingles"] == 1
    assert jaccard.jaccard_components(spark, none)[0].count() == 0


def test_workers_release_what_a_kernel_freed(monkeypatch):
    from vectide.llm import common

    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(1))
    assert list(common._released(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and done == [1]
