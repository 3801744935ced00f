"""Queries against their DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from vectide.plans import catalog

D = "/root/testdata/sf0.001"
FAST = ["vec_dot", "vec_norms", "vec_cosine", "vec_col_stats", "range_within_eps", "searcher_add_size", "searcher_remove", "knn_brute_l2", "knn_batch", "knn_expansion", "proj_index", "knn_projection", "knn_fast_pending", "lsh_hash", "knn_lsh", "knn_lsh_raise", "recall_lsh", "distance_cutoff", "nearest_centroid", "centroid_gap", "seed_first_probability", "ball_iteration_1", "streaming_kmeans_weight", "streaming_incremental", "lsh_sweep", "knn_single_projection", "overlap_at_depth", "rmse_exact_and_approximate", "singular_value_energy", "streaming_kmeans_weight_hash", "split_blocks", "hypercube_corners", "csv_sink_roundtrip", "tok_counts", "tfidf_lic", "tfidf_xxx", "header_split", "quoted_line_filter"]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


def rows(names, got):
    order = sorted(names)
    return sorted(tuple(plain(r[names.index(c)]) for c in order) for r in got)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, D)
    want = duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as registry

    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
