"""The reference's contracts on seeded data, checked with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import basis as bases
from vectide.functions import vec
from vectide.operators import cluster, search, searchers, text
from vectide.operators import points as pts
from vectide.plans import catalog, experiments
from vectide.plans.store import keep
from vectide.sources import files, generate
from vectide.streaming.sketch import feed

SMALL = "/root/testdata/sf0.001"


def frame(spark, x, w=None):
    return spark.createDataFrame([(i, float(1 if w is None else w[i]), [float(c) for c in r]) for i, r in enumerate(x)], "id long, w double, v array<double>")


def queries(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "query_id long, q array<double>")


def test_unrolled_and_folded_distances_agree(spark):
    x = np.random.default_rng(1).normal(size=(50, 7))
    df = frame(spark, x).select(vec.l2("v", vec.literal(x[0]), 7).alias("a"), vec.l2("v", vec.literal(x[0])).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


def test_self_query_and_order(spark):
    x = np.random.default_rng(2).normal(size=(300, 20))
    got = search.brute(frame(spark, x), queries(spark, x[:20]), 5, dim=20).collect()
    first = {r["query_id"]: r for r in got if r["rank"] == 1}
    second = {r["query_id"]: r for r in got if r["rank"] == 2}
    assert all(first[q]["neighbor_id"] == q and first[q]["distance"] < 1e-6 < second[q]["distance"] for q in range(20))


def test_grid_distances(spark):
    grid = generate.grid(spark)
    got = search.brute(grid, grid.select(F.col("id").alias("query_id"), F.col("v").alias("q")), 3).collect()
    assert [sorted({round(r["distance"], 8) for r in got if r["rank"] == k}) for k in (1, 2, 3)] == [[0.0], [0.5], [1.0]]


def test_limits(spark):
    x = np.ones((3, 2))
    p, q = frame(spark, x), queries(spark, x[:1])
    assert [r["neighbor_id"] for r in search.brute(p, q, 9).orderBy("rank").collect()] == [0, 1, 2]
    assert search.brute(p.limit(0), q, 2).count() == 0
    assert search.projection(p.limit(0), q, 2, bases.gaussian(2, 2)).count() == 0
    with pytest.raises(ValueError):
        search.brute(p, q, 0)
    with pytest.raises(Exception, match="a vector of 3"):
        pts.validated(p, 3).collect()


def test_expansion_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 5))
    points, asked = frame(spark, x), queries(spark, x[:40])
    take = lambda found: sorted((r["query_id"], r["rank"], r["neighbor_id"], round(r["distance"], 9)) for r in found.collect())
    monkeypatch.setattr(search, "MAX_BROADCAST", 7)
    got = take(search.expansion(points, asked, 3))
    assert len(got) == 120 and got == take(search.brute(points, asked, 3, "sqeuclidean", 5))


def test_remove_is_strict_and_single(spark):
    p = frame(spark, [[0.0], [1.0], [1.0]])
    assert pts.remove_nearest(p, [0.0], 1.0).count() == 2
    assert sorted(r["id"] for r in pts.remove_nearest(p, [1.0], 0.5).collect()) == [0, 2]
    assert pts.remove_nearest(p, [9.0], 1.0).count() == 3


def test_projection_recall_and_pending(spark):
    rows = generate.lumpy(spark, 1500, 10, seed=4)
    q = rows.filter("id < 20").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = search.brute(rows, q, 20, dim=10)
    index = search.FastIndex(rows, bases.gaussian(10, 10, 3), 20)
    assert search.overlap(index.search(q, 30), exact).agg(F.avg("overlap")).first()[0] > 7
    assert index.add(rows.withColumn("id", F.col("id") + 5000)).due() and index.size() == 1500
    assert index.remove([99.0] * 10, 0.1).size() == 1500


def test_ranks_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(5).normal(size=(200, 4))
    b = bases.gaussian(3, 4, 7)
    one = {(r["basis_id"], r["id"]): r["pos"] for r in search.ranked(spark, search.project(frame(spark, x).repartition(1), b)).collect()}
    many = {(r["basis_id"], r["id"]): r["pos"] for r in search.ranked(spark, search.project(frame(spark, x).repartition(9), b)).collect()}
    p = x @ np.array(b).T
    assert one == many == {(j, i): int(k) + 1 for j in range(3) for k, i in enumerate(np.argsort(p[:, j]))}


def test_hash_by_columns_and_by_batches(spark):
    x = np.random.default_rng(6).normal(size=(60, 5))
    b = bases.gaussian(64, 5, 8)
    both = search.hashed(frame(spark, x), b).select("hash", vec.sign_hash("v", b).alias("again"))
    assert all(r["hash"] == r["again"] for r in both.collect())
    assert search.hashed(frame(spark, np.ones((4, 5))), b, dedup=True).count() == 1


def test_hypercube_sketch(spark):
    points, means = generate.hypercube(spark, 8000, 3, seed=9)
    got = cluster.streaming_kmeans(points, 8, shards=4, cutoff=0.01, seed=1)
    c = np.array([r["v"] for r in got.collect()])
    assert got.agg(F.sum("w")).first()[0] == pytest.approx(8000, abs=1e-6)
    for corner in means.collect():
        assert np.sqrt(((c - corner["v"]) ** 2).sum(1)).min() < 0.05
    assert [r["weight"] for r in cluster.weight_by_mean(got, means).collect()] == pytest.approx([1000.0] * 8)
    again = cluster.streaming_kmeans(points.repartition(11), 8, shards=4, cutoff=0.01, seed=1)
    assert np.allclose(np.sort(c, 0), np.sort(np.array([r["v"] for r in again.collect()]), 0))


@pytest.mark.parametrize("index", ["brute", "projection", "hash"])
def test_corners_over_three_indexes(spark, index):
    points, means = generate.hypercube(spark, 8000, 3, seed=9)
    got = cluster.streaming_kmeans(points, 8, cutoff=0.01, seed=1, index=index)
    c = np.array([r["v"] for r in got.collect()])
    assert got.agg(F.sum("w")).first()[0] == pytest.approx(8000, abs=1e-6)
    assert all(np.sqrt(((c - corner["v"]) ** 2).sum(1)).min() < 0.05 for corner in means.collect())


@pytest.mark.parametrize("kind", sorted(searchers.SEARCHERS))
def test_searchers(kind):
    x = np.random.default_rng(3).normal(size=(400, 6))
    index = searchers.create(kind, 6)
    assert index.nearest(x[0]) == (-1, math.inf) and not index.remove(x[0], 9.0)
    assert index.add_all(x) == list(range(400)) and index.size() == 400 == len(list(index))
    exact = [np.sqrt(((x - q) ** 2).sum(1)).argmin() for q in x + 0.01]
    assert all(index.nearest(x[k]) == (k, 0.0) for k in range(400))
    assert np.mean([index.nearest(q)[0] == e for q, e in zip(x + 0.01, exact, strict=True)]) > 0.9
    assert index.remove(x[7], 0.1) and index.size() == 399 and index.nearest(x[7])[0] != 7
    assert not index.remove(x[8] + 100, 1.0)
    index.move(9, x[9] + 50)
    assert index.nearest(x[9] + 50) == (9, 0.0) and index.nearest(x[9])[0] != 9
    found = index.search(x[3], 5)
    assert [d for _, d in found] == sorted(d for _, d in found) and found[0] == (3, 0.0)
    index.clear()
    assert index.size() == 0 and index.search(x[0], 2) == []
    searchers.register("mine", searchers.BruteSearcher)
    assert isinstance(searchers.create("mine", 2), searchers.BruteSearcher) and searchers.SEARCHERS.pop("mine")


def test_fast_index_clears(spark):
    index = search.FastIndex(frame(spark, np.ones((3, 2))), bases.gaussian(2, 2), 5).clear()
    assert index.size() == 0 and index.search(queries(spark, np.ones((1, 2))), 2).count() == 0


def test_sign_hashes_look_within_the_cutoff_alone(spark):
    """Distances computed are the candidates, and blocks of queries change nothing."""
    x = np.random.default_rng(12).normal(size=(400, 8))
    points, asked, bits = frame(spark, x), queries(spark, x[:20]), bases.gaussian(64, 8, 5)
    plan = search.lsh_candidates(points, asked, bits, 30)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "bit_count" in plan.split("BroadcastNestedLoopJoin", 1)[1].split("\n")[0]
    hashes = [sum((float(np.dot(v, b)) > 0) << k for k, b in enumerate(bits)) for v in x]
    got = {}
    for r in search.lsh_candidates(points, asked, bits, 30).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    for q in range(20):
        apart = np.array([(hashes[q] ^ h).bit_count() for h in hashes])
        cutoff = min(64, int(np.sort(apart)[30]) + 1)
        assert got[q] == set(np.flatnonzero(apart <= cutoff).tolist())


def test_queries_in_blocks_find_the_same(spark, monkeypatch):
    x = np.random.default_rng(12).normal(size=(200, 8))
    points, asked, bits = frame(spark, x), queries(spark, x[:20]), bases.gaussian(64, 8, 5)
    take = lambda: sorted((r["query_id"], r["rank"], r["neighbor_id"]) for r in search.lsh(points, asked, 4, bits, 30, 0.3).collect())
    whole = take()
    monkeypatch.setattr(search, "MAX_BROADCAST", 7)
    assert take() == whole


def test_recall_with_structure(spark):
    """Sign hashes and projections on data with clusters, at sizes that reach nine tenths."""
    rows = generate.lumpy(spark, 1500, 10, seed=4)
    q = rows.filter("id < 30").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = search.brute(rows, q, 10, dim=10)
    mean = lambda found: search.overlap(found, exact).agg(F.avg("overlap")).first()[0] / 10
    assert mean(search.lsh(rows, q, 10, bases.gaussian(64, 10, 3), 200)) >= 0.9
    assert mean(search.projection(rows, q, 10, bases.gaussian(10, 10, 3), 60)) >= 0.9


def test_nearest_without_shuffles(spark):
    x, c = np.random.default_rng(3).normal(size=(300, 5)), np.random.default_rng(4).normal(size=(9, 5))
    c[5] = c[2]
    points, centres = frame(spark, x, w=1 + np.arange(300) % 3), frame(spark, c)
    for metric in ("euclidean", "manhattan", "cosine", "sqeuclidean"):
        found = cluster.nearest(points, centres, metric)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        vec.register("plain", vec.METRICS[metric])
        other = {r["id"]: (r["centroid_id"], round(r["distance"], 9)) for r in cluster.nearest(points, centres, "plain").collect()}
        assert {r["id"]: (r["centroid_id"], round(r["distance"], 9)) for r in found.collect()} == other
        step = lambda m: {r["id"]: (r["w"], np.round(r["v"], 9).tolist()) for r in cluster.ball_step(points, centres.filter("id <> 5"), 0.9, m).collect()}
        assert step(metric) == step("plain")
    vec.METRICS.pop("plain")
    assert cluster.nearest(points, centres.limit(0)).count() == 0


def test_singular_values(spark):
    x = np.random.default_rng(3).normal(size=(70, 5))
    assert np.allclose(cluster.singular_values(frame(spark, x).repartition(4)), np.linalg.svd(x, compute_uv=False))
    assert cluster.singular_values(frame(spark, x).limit(0)) == []


def test_split_towards_clusters_a_split(spark):
    points, _ = generate.hypercube(spark, 4000, 3, seed=9)
    got = cluster.split_kmeans(points, 8, 3, cutoff=0.01, seed=1)
    assert got.agg(F.sum("w")).first()[0] == pytest.approx(4000, abs=1e-6) and 8 <= got.count()


def test_ball_kmeans_finds_the_axes(spark):
    got = cluster.ball_kmeans(generate.cubish(spark, 0.01), 6, 8, seed=2)
    norms = sorted(round(math.sqrt(sum(x * x for x in r["v"])), 1) for r in got.collect())
    assert norms == [0.0] + [6.0] * 5


def test_sketch_merges_and_zero_cutoff():
    s = cluster.Sketch(5, 0.0)
    s.extend(np.zeros((4, 2)), np.ones(4))
    assert s.w == [4.0]
    assert cluster.Sketch(5, 1.0).centroids()[1].size == 0


def test_cutoff_of_few_points(spark):
    assert cluster.distance_cutoff(frame(spark, [[1.0]])).first()[0] == math.inf
    assert cluster.gaps(frame(spark, [[1.0]])).first()["gap"] == math.inf


def test_mail_headers_and_quotes(spark):
    mail = "Subject: Tea\nX: y\n\nhello World\n> quoted\nIn article 5\nJoe writes:\n|>\n|> kept"
    docs = spark.createDataFrame([(1, mail), (2, None)], "doc_id long, text string")
    for end in ("\n", "\r\n", "\r"):
        mixed = docs.withColumn("text", F.regexp_replace("text", "\n", end))
        words = {r["word"] for r in text.tokens(mixed, ["subject"], keep_quotes=False, has_headers=True).collect()}
        assert words == {"tea", "hello", "world", "kept"}
    assert text.tokens(docs.filter("text is null")).count() == 0
    plain = {(r["doc_id"], r["word"], r["tf"]) for r in text.tokens(docs).collect()}
    assert plain == {(r["doc_id"], r["word"], r["tf"]) for r in text.counted(text.parts(docs, False).select("doc_id", "line")).collect()}


def test_files(spark, tmp_path):
    (tmp_path / "in/sci").mkdir(parents=True)
    (tmp_path / "in/sci/a").write_text("one two")
    row = files.text_files(spark, str(tmp_path / "in")).first()
    assert (row["label"], row["text"]) == ("sci", "one two")
    files.write_sequence(frame(spark, [[1.0, 2.0]]), str(tmp_path / "seq"), "id")
    assert spark.sparkContext.sequenceFile(str(tmp_path / "seq")).collect() == [("0", "1.0,2.0")]


def test_experiments_on_small_sizes(spark, tmp_path):
    got = experiments.overlap(spark, 3000, 5, 4, 40).collect()
    assert len(got) == 4 and all(0.9 <= r["overlap"] <= 1 and r["ratio"] >= 1 - 1e-9 for r in got)
    assert experiments.brute_speed(spark, 200, 8, 5, (1, 2), (1, 3)).count() == 4
    assert experiments.sketch_grid(spark, 400, 4, 3, (1, 2), ("brute", "hash")).count() == 4
    rows = experiments.projection_scaling(spark, 400, 5, 5, 60, (3, 20)).orderBy("dim").collect()
    assert [r["dim"] for r in rows] == [3, 20] and 1 <= rows[0]["distance_ratio"] <= rows[1]["distance_ratio"]
    quality = experiments.sketch_quality(spark, 600, 60, 6, 5, (1, 3))
    assert all(0 < r["rmse"] <= r["approximate"] + 1e-9 for r in quality.collect())
    files.write_report(quality, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == ["splits", "centroids", "rmse", "approximate"]


def test_generators(spark):
    x = np.array([r["v"] for r in generate.normal(spark, 4000, 3, seed=2).collect()])
    assert np.abs(x.mean(0)).max() < 0.06 and np.abs(np.cov(x.T) - np.eye(3)).max() < 0.08
    sampled = np.array([r["v"] for r in generate.lumpy(spark, 500, 30, radius=1.0, alpha=5.0, seed=3).collect()])
    again = np.array([r["v"] for r in generate.lumpy(spark, 500, 30, radius=1.0, alpha=5.0, seed=3).collect()])
    assert sampled.shape == (500, 30) and (sampled == again).all()
    tight = np.array([r["v"] for r in generate.lumpy(spark, 500, 30, radius=1e-9, alpha=5.0, seed=3).collect()])
    assert 5 <= len({tuple(v) for v in np.round(tight, 4).tolist()}) <= 60
    asked = queries(spark, np.zeros((300, 4)))
    noise = np.array([r["q"] for r in generate.perturbed(asked, 0.01, seed=4).collect()])
    assert 0.008 < noise.std() < 0.012
    points, means = generate.hypercube(spark, 64, 3)
    assert means.count() == 8 and points.count() == 64


def test_stream_feeds_an_index(spark, tmp_path):
    """Batches of points go to an index, which is compacted as it falls due."""
    x = np.random.default_rng(3).normal(size=(60, 4))
    source = frame(spark, x)
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = {"index": search.FastIndex(source.limit(0), bases.gaussian(4, 4, 3), 30), "batches": 0}

    def take(batch, n):
        state["index"] = state["index"].add(keep(spark, batch, "batch")).compacted()
        state["batches"] += 1

    feed(stream, take, str(tmp_path / "check")).awaitTermination()
    assert state["batches"] == 3 and state["index"].size() == 60 and state["index"].pending.count() == 0
    found = state["index"].search(queries(spark, x[:5]), 1).collect()
    assert all(r["neighbor_id"] == r["query_id"] and r["distance"] == 0 for r in found)


def test_sketch_state_survives():
    from vectide.streaming.sketch import _packed, _unpacked

    x = np.random.default_rng(3).normal(size=(300, 3))
    start = {"target": 5, "cutoff": 0.5, "seed": 2}
    whole = cluster.Sketch(**start).extend(x, np.ones(300))
    half = _unpacked(_packed(cluster.Sketch(**start).extend(x[:150], np.ones(150))), start).extend(x[150:], np.ones(150))
    assert np.allclose(whole.centroids()[0], half.centroids()[0]) and whole.w == half.w and sum(whole.w) == 300
    assert whole.cutoff == half.cutoff > 0.5 and whole.target == half.target


def test_samples_and_two_stages(spark):
    points = generate.cubish(spark, 0.01)
    one = {r["id"] for r in cluster.sample_rows(points, 50, seed=4).collect()}
    assert len(one) == 50 and one == {r["id"] for r in cluster.sample_rows(points.repartition(7), 50, seed=4).collect()}
    got = cluster.sketch_then_ball(points, 6, seed=1, iterations=5).collect()
    assert len(got) == 6 and sum(r["w"] for r in got) <= points.count()


def test_two_stages_of_one_shard(spark):
    """One shard's centroids aren't merged below k."""
    x = np.random.default_rng(7).normal(size=(2000, 64))
    points = frame(spark, x / np.sqrt((x * x).sum(1, keepdims=True))).coalesce(1)
    for seed in (1, 2, 3):
        assert cluster.sketch_then_ball(points, 10, seed=seed, iterations=2).count() == 10
    few = frame(spark, np.repeat(x[:10], 3, axis=0))
    assert cluster.sketch_then_ball(few, 10, iterations=2).count() == 10


def test_brute_by_manhattan_in_numpy(spark):
    """The k best of each batch, ties by id, without a join of points and queries; vectors that lack a component come
    first, as null distances do."""
    x = np.repeat(np.random.default_rng(4).normal(size=(60, 5)), 5, axis=0)
    points, asked = frame(spark, x).orderBy(F.desc("id")), queries(spark, x[:40:3])
    got = search.brute(points, asked, 7, "manhattan", 5)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    plain = search.top(search.paired(points, asked).select("query_id", "id", vec.manhattan("q", "v", 5).alias("distance")), 7)
    assert sorted(got.collect()) == sorted(plain.collect())
    odd = points.unionByName(spark.createDataFrame([(900, 1.0, [1.0]), (901, 1.0, None), (902, 1.0, [1.0, None, 2.0, 3.0, 4.0]), (903, 1.0, [0.0] * 4 + [math.nan])], points.schema)).coalesce(1)
    of = lambda got: sorted((r["query_id"], r["rank"], r["neighbor_id"], str(r["distance"])) for r in got.collect())
    assert of(search.brute(odd, asked, 7, "manhattan", 5)) == of(search.top(search.paired(odd, asked).select("query_id", "id", vec.manhattan("q", "v", 5).alias("distance")), 7))


def test_range_in_numpy(spark):
    x = np.random.default_rng(5).normal(size=(200, 5))
    points, asked = frame(spark, x), queries(spark, x[:20])
    got = pts.within(points, asked, 1.5, dim=5)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(pts.within(points, asked, 1.5).collect())


def test_sums_and_differences_in_numpy(spark):
    got = catalog.vec_add_sub(spark, SMALL)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    p = catalog.vectors(spark, SMALL)
    plain = search.paired(p, catalog.asked(p)).select("query_id", "id", catalog.r9(vec.norm1(vec.add("q", "v")), "plus"), catalog.r9(vec.norm1(vec.subtract("q", "v")), "minus"))
    assert sorted(got.collect()) == sorted(plain.collect())


def test_dots_in_numpy(spark, monkeypatch):
    got = catalog.vec_dot(spark, SMALL)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    p = catalog.vectors(spark, SMALL)
    whole = sorted(got.collect())
    assert whole == sorted(search.paired(p, catalog.asked(p)).select("query_id", "id", catalog.r9(vec.dot("q", "v"), "dot")).collect())
    monkeypatch.setattr(search, "MAX_BROADCAST", 3)
    assert sorted(catalog.vec_dot(spark, SMALL).collect()) == whole


def test_strategies_share_a_search(spark):
    """Each strategy's cutoffs let through what its own search computes."""
    x = np.random.default_rng(12).normal(size=(400, 8))
    points, asked, bits = frame(spark, x), queries(spark, x[:20]), bases.gaussian(64, 8, 5)
    cutoffs, histogram, _ = search.lsh_cutoffs(points, asked, bits, 30, [-0.1, 0.0, 0.6])
    n = histogram.join(cutoffs, "query_id").filter("h <= cutoff").groupBy("query_id", "i").agg(F.sum("n").alias("evaluations"))
    for i, strategy in enumerate([-0.1, 0.0, 0.6]):
        alone = search.evaluations(search.lsh_candidates(points, asked, bits, 30, strategy))
        assert sorted(n.filter(F.col("i") == i).select("query_id", "evaluations").collect()) == sorted(alone.collect())
