import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "eins zwei drei")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(spark, stage(spark, docs, str(tmp_path)), name)
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        assert set(odd.columns) <= set(docs.columns)
    # Language ID rejects texts without letters alone, and keeps a row without an id and one that stands twice.
    assert sorted(map(str, kept[0])) == sorted(["1", "2", "2", "6", "7", "9", "10", "11", "None"])
    # Of ids 1, 2, 2 and none on one text, 2 stays once.
    assert sorted(kept[1]) == [2, 6, 7, 9, 10, 11]
    assert sorted(kept[2]) == [2, 7, 9, 11]
    assert sorted(kept[3]) == [2, 7, 9]
    assert set(kept[4]) <= set(kept[3])


def rows_of(spark, stage, rows, tmp_path):
    if not (tmp_path / "benchmark.parquet").exists():
        spark.createDataFrame([(1, "eins zwei drei")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path)).collect()), key=str)


def test_exact_dedup_decides_by_row(spark, tmp_path):
    assert rows_of(spark, "exact_dedup", [(2, "a b c"), (2, "a b c")], tmp_path) == [(2, "a b c")]
    assert rows_of(spark, "exact_dedup", [(3, "x y"), (3, "only here"), (9, "x y")], tmp_path) == [(3, "only here"), (9, "x y")]
    assert rows_of(spark, "exact_dedup", [(None, "x y"), (None, "x y"), (None, "z"), (4, "q"), (None, "q")], tmp_path) == [(4, "q"), (None, "x y"), (None, "z")]


def test_near_duplicates_decide_by_row(spark, tmp_path):
    words = [f"w{k}" for k in range(30)]
    one, two, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{k}" for k in range(30))
    assert rows_of(spark, "near_duplicates", [(5, one), (5, other), (3, two), (5, other)], tmp_path) == [(3, two), (5, other)]
    assert rows_of(spark, "near_duplicates", [(None, one), (None, two), (None, other), (8, "a b"), (7, "")], tmp_path)[:2] == [(7, ""), (8, "a b")]
    assert len(rows_of(spark, "near_duplicates", [(None, one), (None, two), (None, other), (8, "a b"), (8, "a b"), (7, "")], tmp_path)) == 4


def test_decontamination_decides_by_row(spark, tmp_path):
    assert rows_of(spark, "decontaminate", [(1, "eins zwei drei"), (1, "clean"), (1, "clean"), (None, "eins zwei drei"), (None, "vier")], tmp_path) == [(1, "clean"), (1, "clean"), (None, "vier")]


def test_the_run_is_its_stages(spark):
    """On the smallest tables: what each stage keeps is checked with plain means, row for row."""
    import re

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(spark, stage(spark, docs, d), name)
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        kept.append(set(ids))
    assert {i for i, t in text.items() if not any(c.isalpha() for c in t)}.isdisjoint(kept[0]) and len(kept[0]) > 0.95 * len(text)
    most = {}
    for i in kept[0]:
        most[text[i]] = max(i, most.get(text[i], i))
    assert kept[1] == set(most.values())
    sets = {}
    for i in kept[1]:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i]))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    assert kept[2] == {i for i in sets if find(i) == i}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() for w in [cut(r["text"])] for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    assert kept[3] == {i for i in kept[2] if not any(tuple(w[k : k + n]) in windows for w in [cut(text[i])] for n in sizes for k in range(len(w) - n + 1))}
    assert kept[4] <= kept[3]
    p = {(r["source"], r["lang"]): r["mix_p"] for r in docs.filter(F.col("text").isNotNull()).collect()}
    assert all(0 < x <= 1 for x in p.values())


def test_the_run_leaves_one_table_behind(spark):
    from vectide.plans import store

    before = set(store._written)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    names = sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(store._written) - before)
    assert "decontaminate" in names and not {"language_id", "exact_dedup", "near_duplicates", "sketches", "postings", "fingerprints"} & set(names)
    assert out.count() > 0 and "mix_p" in out.columns


def test_stages_on_no_rows(spark, none, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(spark, stage(spark, docs, str(tmp_path)), name)
    assert docs.count() == 0


def test_no_shared_folder_is_an_error_on_a_cluster(monkeypatch, spark):
    from types import SimpleNamespace

    from vectide.plans import store

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(cluster)


def test_stages_begin_with_lean_heaps(spark, monkeypatch):
    """Garbage in the executors' heaps goes, and each stage sees to it before anything else."""
    from vectide.llm.common import shrink_heaps

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = [b for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep"))]
    before = sum(b.getCollectionCount() for b in old)
    shrink_heaps(spark)
    assert old and sum(b.getCollectionCount() for b in old) > before

    class Begun(Exception):
        pass

    def begun(_):
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "shrink_heaps", begun)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, "")
