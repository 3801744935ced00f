"""Every registered query of the vector, clustering and text operators, with its DuckDB SQL.

Searches take as queries all vectors whose id is divisible by 50, against all vectors. Means and gaps use the
labels' mean vectors as centroids. Numbers are rounded to nine digits, sums over
words to six, as they may differ in the last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import basis as bases
from vectide.functions import vec
from vectide.operators import cluster, search, text
from vectide.operators import points as pts
from vectide.plans.store import keep, shared_dir
from vectide.sources import files, generate
from vectide.streaming import sketch

DIM, K, EPS = 64, 10, 1.25
P, S = 4, 20
BASIS = bases.gaussian(P, DIM, seed=11, unit=True)
BITS = bases.gaussian(64, DIM, seed=13)
SEARCH, STRATEGY = 50, 0.5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- inputs -----------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings as points; weights 1, 2, 3 by id."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), (1.0 + F.pmod("vec_id", F.lit(3))).alias("w"), F.col("embedding").cast("array<double>").alias("v"))


def asked(points: DataFrame) -> DataFrame:
    return points.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def label_means(spark: SparkSession, d: str) -> DataFrame:
    """One centroid a label: (id, w, v)."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("long").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    m = e.groupBy("id", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return m.groupBy("id").agg(F.max("n").cast("double").alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def r9(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 9).alias(name) if name else F.round(c, 9)


def _neighbors(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "neighbor_id", r9("distance", "distance"))


# --- SQL pieces -------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id AS id, 1.0::DOUBLE + vec_id % 3 AS w, embedding::DOUBLE[] AS v, label FROM embeddings)"
_Q = "q AS (SELECT id AS query_id, v AS q FROM e WHERE id % 50 = 0)"


def _zip(a: str, b: str, each: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {each}))"


def _d2(a: str, b: str) -> str:
    return _zip(a, b, "(z[1] - z[2]) * (z[1] - z[2])")


def _dot(a: str, b: str) -> str:
    return _zip(a, b, "z[1] * z[2]")


def _topk(frm: str, distance: str, k: int = K) -> str:
    return f"SELECT query_id, rank, id AS neighbor_id, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM (SELECT query_id, id, {distance} AS distance FROM {frm})) WHERE rank <= {k}"


_PAIRS = f"pair AS (SELECT query_id, id, sqrt({_d2('q', 'v')}) AS distance FROM e, q)"
_BRUTE = f"ex AS (SELECT * FROM (SELECT query_id, id AS neighbor_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pair) WHERE rank <= {K})"
_MEANS = "part AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), cm AS (SELECT label::BIGINT AS id, pos, avg(x) AS x, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT id, max(n)::DOUBLE AS w, list(x ORDER BY pos) AS v FROM cm GROUP BY id)"
_NEAR = f"near AS (SELECT id, arg_min(cid, (d, cid)) AS centroid_id, min(d) AS distance FROM (SELECT e.id, c.id AS cid, sqrt({_d2('e.v', 'c.v')}) AS d FROM e, c) GROUP BY id)"
_GAP = f"gap AS (SELECT a.id AS centroid_id, min(sqrt({_d2('a.v', 'b.v')})) AS gap FROM c a, c b WHERE a.id <> b.id GROUP BY a.id)"
_BASIS = f"b(basis_id, bv, wt) AS {bases.values(BASIS)}"
_BITS = f"b(basis_id, bv, wt) AS {bases.values(BITS)}"


def _places(points: str = "e", below: int = S, above: int = S, cte: str = "cand") -> str:
    """CTEs up to candidates (query_id, id) of a projection search."""
    return f"""pr AS (SELECT basis_id, id, {_dot('v', 'bv')} AS p FROM {points}, b),
        place AS (SELECT basis_id, id, row_number() OVER (PARTITION BY basis_id ORDER BY p, id) AS pos FROM pr),
        qp AS (SELECT basis_id, query_id, {_dot('q', 'bv')} AS p FROM q, b),
        tagged AS (SELECT basis_id, id, p, 1 AS kind FROM pr UNION ALL SELECT basis_id, query_id, p, 0 FROM qp),
        ran AS (SELECT basis_id, id, kind, sum(kind) OVER (PARTITION BY basis_id ORDER BY p, kind, id ROWS UNBOUNDED PRECEDING) AS pos FROM tagged),
        lt AS (SELECT basis_id, id AS query_id, coalesce(pos, 0) AS lt FROM ran WHERE kind = 0),
        {cte} AS (SELECT DISTINCT query_id, id FROM lt JOIN place USING (basis_id) WHERE pos BETWEEN lt - {below - 1} AND lt + {above})"""


_HASH = f"h AS (SELECT id, bit_or(CASE WHEN {_dot('v', 'bv')} > 0 THEN wt ELSE 0 END) AS hash FROM e, b GROUP BY id)"
_HAM = "hp AS (SELECT a.id AS query_id, h.id, bit_count(xor(a.hash, h.hash))::INT AS h FROM h a, h WHERE a.id % 50 = 0)"
_CUT = f"""hist AS (SELECT query_id, h, count(*) AS n FROM hp GROUP BY ALL),
        upto AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY h) AS upto FROM hist),
        cut AS (SELECT query_id, least(coalesce(min(CASE WHEN upto > {SEARCH} THEN h END) + 1, 64), 64)::INT AS cutoff FROM upto GROUP BY query_id)"""
_LSH = f"{_E}, {_Q}, {_BITS}, {_HASH}, {_HAM}, {_CUT}, {_PAIRS}, lc AS (SELECT query_id, id, distance FROM pair JOIN hp USING (query_id, id) JOIN cut USING (query_id) WHERE h <= cutoff)"

# --- vector functions -------------------------------------------------------------------------------------


@query(f"WITH {_E}, {_Q} SELECT query_id, id, round({_dot('q', 'v')}, 9) AS dot FROM e, q")
def vec_dot(spark, d):
    p = vectors(spark, d)
    return search.measured(p, asked(p), {"dot": "dot"}, DIM).select("query_id", "id", r9("dot", "dot"))


@query(f"WITH {_E} SELECT id, round(list_sum(list_transform(v, lambda x: abs(x))), 9) AS l1, round({_dot('v', 'v')}, 9) AS len2, round(sqrt({_dot('v', 'v')}), 9) AS l2 FROM e")
def vec_norms(spark, d):
    return vectors(spark, d).select("id", r9(vec.norm1("v"), "l1"), r9(vec.norm2("v"), "len2"), r9(vec.norm("v"), "l2"))


@query(f"WITH {_E} SELECT id, pos - 1 AS pos, round(x / len, 9) AS x FROM (SELECT id, sqrt({_dot('v', 'v')}) AS len, unnest(v) AS x, generate_subscripts(v, 1)::INT AS pos FROM e)")
def vec_normalize(spark, d):
    return vectors(spark, d).select("id", F.posexplode(vec.normalize("v")).alias("pos", "x")).select("id", "pos", r9("x", "x"))


@query(f"WITH {_E}, {_Q} SELECT query_id, id, round({_dot('q', 'v')} / sqrt({_dot('q', 'q')} * {_dot('v', 'v')}), 9) AS cosine FROM e, q")
def vec_cosine(spark, d):
    p = vectors(spark, d)
    return search.paired(p, asked(p)).select("query_id", "id", r9(vec.cosine("q", "v"), "cosine"))


@query(f"WITH {_E}, {_Q} SELECT query_id, id, round(list_sum(list_transform(list_zip(q, v), lambda z: abs(z[1] + z[2]))), 9) AS plus, round(list_sum(list_transform(list_zip(q, v), lambda z: abs(z[1] - z[2]))), 9) AS minus FROM e, q")
def vec_add_sub(spark, d):
    p = vectors(spark, d)
    return search.measured(p, asked(p), {"plus": "plus", "minus": "manhattan"}, DIM).select("query_id", "id", r9("plus", "plus"), r9("minus", "minus"))


@query(f"WITH {_E} SELECT pos - 1 AS pos, min(x) AS least, max(x) AS most, round(sum(x), 9) AS total, round(sum(abs(x)), 9) AS l1 FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1)::INT AS pos FROM e) GROUP BY pos")
def vec_col_stats(spark, d):
    return vectors(spark, d).select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("least"), F.max("x").alias("most"), r9(F.sum("x"), "total"), r9(F.sum(F.abs("x")), "l1"))


@query(f"WITH {_E}, {_Q}, {_PAIRS} SELECT query_id, id, round(distance, 9) AS distance FROM pair WHERE distance < {EPS}")
def range_within_eps(spark, d):
    p = vectors(spark, d)
    return pts.within(p, asked(p), EPS, dim=DIM).select("query_id", "id", r9("distance", "distance"))


# --- index maintenance ------------------------------------------------------------------------------------


@query("SELECT 2 * count(*) AS n, sum(1.0::DOUBLE + vec_id % 3) + count(*) AS weight FROM embeddings")
def searcher_add_size(spark, d):
    p = vectors(spark, d)
    more = pts.add_rows(p, p.select((F.col("id") + 1_000_000).alias("id"), "v"))
    return more.agg(F.count("*").alias("n"), F.sum("w").alias("weight"))


_TARGET = [1.0] + [0.0] * (DIM - 1)
_TARGET_SQL = "[" + ", ".join(f"{x:.1f}" for x in _TARGET) + "]::DOUBLE[]"


@query(f"WITH {_E}, victim AS (SELECT id FROM e WHERE sqrt({_d2('v', _TARGET_SQL)}) < {EPS} ORDER BY id LIMIT 1) SELECT id, w FROM e WHERE id NOT IN (SELECT id FROM victim)")
def searcher_remove(spark, d):
    return pts.remove_nearest(vectors(spark, d), _TARGET, EPS).select("id", "w")


@query(f"WITH {_E}, victim AS (SELECT id FROM e WHERE sqrt({_d2('v', _TARGET_SQL)}) < {EPS} ORDER BY sqrt({_d2('v', _TARGET_SQL)}), id LIMIT 1) SELECT id FROM e WHERE id NOT IN (SELECT id FROM victim)")
def projection_remove(spark, d):
    return pts.remove_nearest(vectors(spark, d), _TARGET, EPS, first="distance").select("id")


@query(f"WITH {_E}, victim AS (SELECT id FROM e WHERE sqrt({_d2('v', _TARGET_SQL)}) < {EPS} ORDER BY sqrt({_d2('v', _TARGET_SQL)}), id LIMIT 1) SELECT id FROM e WHERE id NOT IN (SELECT id FROM victim) UNION ALL SELECT id + 1000000 FROM e")
def fast_remove(spark, d):
    p = vectors(spark, d)
    index = search.FastIndex(p, BASIS, S).remove(_TARGET, EPS)
    return index.add(p.withColumn("id", F.col("id") + 1_000_000)).compacted().points().select("id")


@query(f"WITH {_E} SELECT id FROM e WHERE v NOT IN (SELECT v FROM e WHERE id % 50 = 0)")
def lsh_remove(spark, d):
    p = vectors(spark, d)
    return pts.remove_equal(p, asked(p).select(F.col("q").alias("v"))).select("id")


# --- exact search -----------------------------------------------------------------------------------------


def _brute_sql(distance: str) -> str:
    return f"WITH {_E}, {_Q} {_topk('e, q', distance)}"


@query(_brute_sql(f"sqrt({_d2('q', 'v')})"))
def knn_brute_l2(spark, d):
    p = vectors(spark, d)
    return _neighbors(search.brute(p, asked(p), K, dim=DIM))


@query(_brute_sql(_d2("q", "v")))
def knn_brute_sql2(spark, d):
    p = vectors(spark, d)
    return _neighbors(search.brute(p, asked(p), K, "sqeuclidean", DIM))


@query(_brute_sql(_zip("q", "v", "abs(z[1] - z[2])")))
def knn_brute_manhattan(spark, d):
    p = vectors(spark, d)
    return _neighbors(search.brute(p, asked(p), K, "manhattan", DIM))


@query(f"WITH {_E}, {_Q}, {_PAIRS}, {_BRUTE} SELECT query_id, string_agg(neighbor_id::VARCHAR, ',' ORDER BY rank) AS neighbors FROM ex GROUP BY query_id")
def knn_batch(spark, d):
    p = vectors(spark, d)
    lists = search.nested(search.brute(p, asked(p), K, dim=DIM))
    return lists.select("query_id", F.array_join(F.transform("neighbors", lambda n: n["neighbor_id"].cast("string")), ",").alias("neighbors"))


@query(f"WITH {_E}, {_Q} SELECT query_id, rank, neighbor_id, round(distance, 6) AS distance FROM ({_topk('e, q', _d2('q', 'v'))})")
def knn_expansion(spark, d):
    p = vectors(spark, d)
    found = search.expansion(p, asked(p), K)
    return found.select("query_id", "rank", "neighbor_id", (F.round("distance", 6) + 0.0).alias("distance"))


# --- projections ------------------------------------------------------------------------------------------


@query(f"WITH {_E}, {_BASIS}, pr AS (SELECT basis_id, id, {_dot('v', 'bv')} AS p FROM e, b) SELECT basis_id, id, round(p, 9) AS p, row_number() OVER (PARTITION BY basis_id ORDER BY p, id) AS pos FROM pr")
def proj_index(spark, d):
    return search.ranked(spark, search.project(vectors(spark, d), BASIS)).select("basis_id", "id", r9("p", "p"), "pos")


_RERANK = "met AS (SELECT query_id, e.id, q, v FROM cand JOIN e USING (id) JOIN q USING (query_id))"


@query(f"WITH {_E}, {_Q}, {_BASIS}, {_places()}, {_RERANK} {_topk('met', f'sqrt({_d2(chr(113), chr(118))})')}")
def knn_projection(spark, d):
    p = vectors(spark, d)
    return _neighbors(search.projection(p, asked(p), K, BASIS, S))


@query(f"WITH {_E}, {_Q}, {_BASIS}, {_places(above=S + 1)}, {_RERANK} {_topk('met', f'sqrt({_d2(chr(113), chr(118))})')}")
def knn_fast_projection(spark, d):
    p = vectors(spark, d)
    return _neighbors(search.FastIndex(p, BASIS, S).search(asked(p), K))


_NEW = "new AS (SELECT vec_id + 1000000 AS id, list_transform(embedding::DOUBLE[], lambda x: -x) AS v FROM embeddings)"


@query(f"WITH {_E}, {_Q}, {_NEW}, {_BASIS}, {_places(above=S + 1, cte='c0')}, alive AS (SELECT id, v FROM e WHERE id % 7 <> 0 UNION ALL SELECT id, v FROM new), cand AS (SELECT query_id, id FROM c0 UNION SELECT query_id, id FROM q, new), met AS (SELECT query_id, id, q, v FROM cand JOIN alive USING (id) JOIN q USING (query_id)) {_topk('met', f'sqrt({_d2(chr(113), chr(118))})')}")
def knn_fast_pending(spark, d):
    """Every seventh point deleted, and a mirror image of each waiting: none compacted yet."""
    p = vectors(spark, d)
    waiting = p.select((F.col("id") + 1_000_000).alias("id"), "w", F.transform("v", lambda x: -x).alias("v"))
    return _neighbors(search.FastIndex(p, BASIS, S, pending=waiting, gone=p.filter("id % 7 = 0").select("id")).search(asked(p), K))


# --- sign hashes ------------------------------------------------------------------------------------------


@query(f"WITH {_E}, {_BITS}, {_HASH} SELECT id, hash FROM h")
def lsh_hash(spark, d):
    return search.hashed(vectors(spark, d), BITS).select("id", "hash")


@query(f"WITH {_E}, {_BITS}, {_HASH} SELECT id, hash & 4294967295 AS hash FROM h")
def lsh_hash_masked(spark, d):
    return search.hashed(vectors(spark, d), BITS).select("id", vec.masked("hash", 32).alias("hash"))


@query(f"WITH {_E}, {_BITS}, {_HASH}, {_HAM} SELECT query_id, h, count(*) AS n FROM hp GROUP BY ALL")
def lsh_hamming_hist(spark, d):
    p = vectors(spark, d)
    return search.hamming_histogram(p, asked(p), BITS)


@query(f"WITH {_E}, {_Q}, {_BITS}, {_HASH}, {_HAM}, {_PAIRS} SELECT query_id, h, count(*) AS n, round(min(distance), 9) AS least, round(quantile_cont(distance, 0.25), 9) AS quartile FROM pair JOIN hp USING (query_id, id) GROUP BY query_id, h")
def lsh_levels(spark, d):
    p = vectors(spark, d)
    pairs = search._hash_pairs(p, asked(p), BITS).select("query_id", "h", vec.l2("q", "v", DIM).alias("distance"))
    return search.levels(pairs).select("query_id", "h", "n", r9("least", "least"), r9("quartile", "quartile"))


@query(f"WITH {_LSH}, {_RERANK.replace('FROM cand', 'FROM lc')} {_topk('met', f'sqrt({_d2(chr(113), chr(118))})')}")
def knn_lsh(spark, d):
    p = vectors(spark, d)
    return _neighbors(search.lsh(p, asked(p), K, BITS, SEARCH))


_RAISED = f"""WITH {_LSH},
        worst AS (SELECT query_id, max(distance) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM lc) WHERE rank <= {SEARCH} GROUP BY query_id),
        lev AS (SELECT query_id, h, count(*) AS n, min(distance) AS least, quantile_cont(distance, 0.25) AS quartile FROM pair JOIN hp USING (query_id, id) WHERE h <= 32 GROUP BY query_id, h),
        chain AS (SELECT query_id, h, cutoff, NOT (n > 10 AND {STRATEGY} * quartile + {1 - STRATEGY} * least < worst) AS stays, h - row_number() OVER (PARTITION BY query_id ORDER BY h) + 1 = cutoff AS steady FROM lev JOIN worst USING (query_id) JOIN cut USING (query_id) WHERE h >= cutoff AND h < 32),
        good AS (SELECT query_id, max((stays OR NOT steady)::INT) OVER (PARTITION BY query_id ORDER BY h) AS bad FROM chain),
        up AS (SELECT query_id, count(*) AS up FROM good WHERE bad = 0 GROUP BY query_id),
        cut2 AS (SELECT query_id, cutoff + coalesce(up, 0) AS cutoff FROM cut LEFT JOIN up USING (query_id)),
        lc2 AS (SELECT query_id, id, distance FROM pair JOIN hp USING (query_id, id) JOIN cut2 USING (query_id) WHERE h <= cutoff)"""


@query(f"{_RAISED} {_topk('lc2', 'distance')}")
def knn_lsh_raise(spark, d):
    p = vectors(spark, d)
    return _neighbors(search.lsh(p, asked(p), K, BITS, SEARCH, STRATEGY))


@query(f"{_RAISED} SELECT query_id, plain.n AS plain, raised.n AS raised FROM (SELECT query_id, count(*) AS n FROM lc GROUP BY 1) plain JOIN (SELECT query_id, count(*) AS n FROM lc2 GROUP BY 1) raised USING (query_id)")
def lsh_eval_count(spark, d):
    p = vectors(spark, d)
    count = lambda strategy, name: search.evaluations(search.lsh_candidates(p, asked(p), BITS, SEARCH, strategy)).withColumnRenamed("evaluations", name)
    return count(-1.0, "plain").join(count(STRATEGY, "raised"), "query_id")


@query(f"WITH {_E}, {_Q}, {_BITS}, {_HASH}, {_HAM} SELECT h, count(*) AS n, round(avg({_dot('q', 'v')} / sqrt({_dot('q', 'q')} * {_dot('v', 'v')})), 9) AS cosine FROM hp JOIN e USING (id) JOIN q USING (query_id) GROUP BY h")
def hamming_cosine(spark, d):
    p = vectors(spark, d)
    return search._hash_pairs(p, asked(p), BITS).groupBy("h").agg(F.count("*").alias("n"), r9(F.avg(vec.cosine("q", "v")), "cosine"))


@query(f"WITH {_LSH} SELECT round((SELECT count(*) FROM pair) / (SELECT count(*) FROM lc), 9) AS speedup")
def lsh_speedup(spark, d):
    p = vectors(spark, d)
    done = search.lsh_candidates(p, asked(p), BITS, SEARCH).agg(F.count("*").alias("n"))
    every = search.paired(p.select("id"), asked(p).select("query_id")).agg(F.count("*").alias("m"))
    return done.crossJoin(every).select(r9(F.col("m") / F.col("n"), "speedup"))


_CHAIN = f"""lev AS (SELECT query_id, h, count(*) AS n, min(distance) AS least, quantile_cont(distance, 0.25) AS quartile FROM pair JOIN hp USING (query_id, id) WHERE h <= 32 GROUP BY query_id, h),
        worst AS (SELECT query_id, max(distance) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM lc) WHERE rank <= {SEARCH} GROUP BY query_id),
        st AS (SELECT i, (i - 1) / 10.0::DOUBLE AS strategy FROM range(12) t(i)),
        chain AS (SELECT i, query_id, h, strategy < 0 OR NOT (n > 10 AND strategy * quartile + (1 - strategy) * least < worst) AS stays, h - row_number() OVER (PARTITION BY i, query_id ORDER BY h) + 1 = cutoff AS steady FROM st, lev JOIN worst USING (query_id) JOIN cut USING (query_id) WHERE h >= cutoff AND h < 32),
        good AS (SELECT i, query_id, max((stays OR NOT steady)::INT) OVER (PARTITION BY i, query_id ORDER BY h) AS bad FROM chain),
        up AS (SELECT i, query_id, count(*) AS up FROM good WHERE bad = 0 GROUP BY i, query_id),
        cut3 AS (SELECT i, query_id, cutoff + coalesce(up, 0) AS cutoff FROM st CROSS JOIN cut LEFT JOIN up USING (i, query_id)),
        done AS (SELECT i, query_id, id, row_number() OVER (PARTITION BY i, query_id ORDER BY distance, id) AS rank FROM cut3 JOIN hp USING (query_id) JOIN pair USING (query_id, id) WHERE h <= cutoff),
        o AS (SELECT i, query_id, count(ex.neighbor_id) AS overlap FROM done LEFT JOIN ex ON ex.query_id = done.query_id AND ex.neighbor_id = done.id AND done.rank <= {K} GROUP BY i, done.query_id)"""


@query(f"WITH {_LSH.replace(_PAIRS, _PAIRS + ', ' + _BRUTE)}, {_CHAIN} SELECT i::INT AS strategy, quantile_cont(overlap, 0.25) AS q1, quantile_cont(overlap, 0.5) AS q2, quantile_cont(overlap, 0.75) AS q3, round((SELECT count(*) FROM pair) / any_value(n), 6) AS speedup FROM o JOIN (SELECT i, count(*) AS n FROM done GROUP BY i) USING (i) GROUP BY i".replace("SELECT i, query_id, count(ex.neighbor_id) AS overlap FROM done", "SELECT i, done.query_id, count(ex.neighbor_id) AS overlap FROM done"))
def lsh_sweep(spark, d):
    """Twelve strategies from -0.1 to 1.0, in one search: quartiles of the overlap with exact search, and how many times
    fewer distances are computed."""
    p = vectors(spark, d)
    q = asked(p)
    cutoffs, histogram, hashes = search.lsh_cutoffs(p, q, BITS, SEARCH, [(i - 1) / 10.0 for i in range(12)])
    exact = search.brute(p, q, K, dim=DIM).select("query_id", F.col("neighbor_id").alias("id")).join(hashes, "id")
    mine = search.hashed(q.select(F.col("query_id").alias("id"), F.col("q").alias("v")), BITS).select(F.col("id").alias("query_id"), F.col("hash").alias("qhash"))
    exact = exact.join(mine, "query_id").select("query_id", vec.hamming("hash", "qhash").alias("h"))
    # Exact neighbours within a cutoff are the nearest within it, too: these are what the two searches share.
    shared = exact.join(cutoffs, "query_id").filter("h <= cutoff").groupBy("query_id", "i").agg(F.count("*").alias("overlap"))
    n = histogram.join(cutoffs, "query_id").filter("h <= cutoff").groupBy("query_id", "i").agg(F.sum("n").alias("evaluations")).join(shared, ["query_id", "i"], "left")
    pairs = p.count() * q.count()
    quartile = lambda x: F.percentile(F.coalesce("overlap", F.lit(0)), F.lit(x))
    return n.groupBy(F.col("i").alias("strategy")).agg(quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"), F.round(F.lit(pairs) / F.sum("evaluations"), 6).alias("speedup"))


# --- quality ----------------------------------------------------------------------------------------------

_AP = f"ap AS (SELECT query_id, rank, id AS neighbor_id, distance FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM cand JOIN pair USING (query_id, id)) WHERE rank <= {K})"
_QUALITY = f"WITH {_E}, {_Q}, {_PAIRS}, {_BRUTE}, {_BASIS}, {_places()}, {_AP}"
_OVERLAP = "SELECT query_id, count(ap.neighbor_id) AS overlap FROM ex LEFT JOIN ap USING (query_id, neighbor_id) GROUP BY query_id"


def _both(spark, d):
    p = vectors(spark, d)
    q = asked(p)
    return search.projection(p, q, K, BASIS, S), search.brute(p, q, K, dim=DIM)


@query(f"{_QUALITY} {_OVERLAP}")
def recall_projection(spark, d):
    return search.overlap(*_both(spark, d))


@query(f"WITH {_LSH}, {_BRUTE}, ap AS (SELECT query_id, id AS neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM lc) WHERE rank <= {K}) {_OVERLAP}")
def recall_lsh(spark, d):
    p = vectors(spark, d)
    return search.overlap(search.lsh(p, asked(p), K, BITS, SEARCH), search.brute(p, asked(p), K, dim=DIM))


@query(f"{_QUALITY} SELECT query_id, round(a / x, 9) AS ratio FROM (SELECT query_id, max(distance) AS a FROM ap GROUP BY 1) JOIN (SELECT query_id, max(distance) AS x FROM ex GROUP BY 1) USING (query_id)")
def radius_ratio(spark, d):
    return search.radius_ratio(*_both(spark, d)).select("query_id", r9("ratio", "ratio"))


@query(f"{_QUALITY} SELECT query_id, round(ap.distance / ex.distance, 9) AS ratio FROM ap JOIN ex USING (query_id) WHERE ap.rank = 2 AND ex.rank = 2")
def distance_ratio(spark, d):
    return search.distance_ratio(*_both(spark, d), rank=2).select("query_id", r9("ratio", "ratio"))


@query(f"{_QUALITY} SELECT ap.query_id, ex.rank::INT AS depth FROM ap LEFT JOIN ex USING (query_id, neighbor_id) WHERE ap.rank = 1")
def rank_depth(spark, d):
    return search.rank_depth(*_both(spark, d))


@query(f"{_QUALITY}, o AS ({_OVERLAP}) SELECT quantile_cont(overlap, 0.25) AS q1, quantile_cont(overlap, 0.5) AS q2, quantile_cont(overlap, 0.75) AS q3 FROM o")
def overlap_quartiles(spark, d):
    return search.quartiles(search.overlap(*_both(spark, d)), "overlap")


DEEP, WIDE = 50, 100


@query(f"WITH {_E}, {_Q}, {_PAIRS}, {_BRUTE.replace(f'rank <= {K}', f'rank <= {DEEP}')}, {_BASIS}, {_places(below=WIDE, above=WIDE + 1)}, {_AP.replace(f'rank <= {K}', f'rank <= {DEEP}')}, far AS (SELECT query_id, max(distance) AS far FROM ex GROUP BY 1), near AS (SELECT query_id, max(distance) AS near FROM ap GROUP BY 1) SELECT query_id, count(ap.neighbor_id) AS overlap, round(any_value(near) / any_value(far), 9) AS ratio FROM ex LEFT JOIN ap USING (query_id, neighbor_id) JOIN far USING (query_id) JOIN near USING (query_id) GROUP BY query_id")
def overlap_at_depth(spark, d):
    """Exact search by expansion against the fast projection index at depth 50: neighbours that both give, and the ratio of
    the radii."""
    p = vectors(spark, d)
    q = asked(p)
    exact = search.expansion(p, q, DEEP).withColumn("distance", F.sqrt("distance"))
    found = keep(spark, search.FastIndex(p, BASIS, WIDE).search(q, DEEP), "found")
    exact = keep(spark, exact, "exact")
    return search.overlap(found, exact).join(search.radius_ratio(found, exact), "query_id").select("query_id", "overlap", r9("ratio", "ratio"))


@query(f"""WITH {_E}, {_Q}, {_BASIS}, pr AS (SELECT id, {_dot('v', 'bv')} AS p FROM e, b WHERE basis_id = 0),
        place AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS pos FROM pr),
        lt AS (SELECT q.query_id, count(*) FILTER (pr.p < me.p) AS lt, count(*) FILTER (pr.p <= me.p) AS le FROM q JOIN pr me ON me.id = q.query_id, pr GROUP BY q.query_id),
        cand AS (SELECT query_id, id FROM lt, place WHERE pos BETWEEN lt - {S - 1} AND lt OR pos BETWEEN le + 1 AND le + {S}),
        met AS (SELECT query_id, e.id, q, v FROM cand JOIN e USING (id) JOIN q USING (query_id)) {_topk('met', f'sqrt({_d2(chr(113), chr(118))})')}""")
def knn_single_projection(spark, d):
    p = vectors(spark, d)
    return _neighbors(search.single_projection(p, asked(p), K, BASIS[0], S))


# --- clustering -------------------------------------------------------------------------------------------


@query(f"WITH {_E}, s AS (SELECT * FROM e ORDER BY id LIMIT 100) SELECT round(min(sqrt({_d2('a.v', 'b.v')})), 9) AS cutoff FROM s a, s b WHERE a.id < b.id")
def distance_cutoff(spark, d):
    return cluster.distance_cutoff(vectors(spark, d)).select(r9("cutoff", "cutoff"))


@query(f"WITH {_E}, {_MEANS}, {_NEAR} SELECT id, centroid_id, round(distance, 9) AS distance FROM near")
def nearest_centroid(spark, d):
    return cluster.nearest(vectors(spark, d), label_means(spark, d), dim=DIM).select("id", "centroid_id", r9("distance", "distance"))


@query(f"WITH {_E}, {_MEANS}, {_GAP} SELECT centroid_id, round(gap, 9) AS gap FROM gap")
def centroid_gap(spark, d):
    return cluster.gaps(label_means(spark, d)).select("centroid_id", r9("gap", "gap"))


@query(f"WITH {_E}, {_MEANS}, {_NEAR} SELECT centroid_id, sum(w) AS weight FROM near JOIN e USING (id) GROUP BY centroid_id")
def corner_weight(spark, d):
    return cluster.weight_by_mean(vectors(spark, d), label_means(spark, d))


@query(f"WITH {_E}, {_MEANS}, {_NEAR} SELECT round(sqrt(avg(distance * distance) / {DIM}), 9) AS rmse FROM near")
def rmse_quantization(spark, d):
    return cluster.rmse(vectors(spark, d), label_means(spark, d), DIM).select(r9("rmse", "rmse"))


_NEAR2 = f"""lines AS (SELECT basis_id, c.id, {_dot('c.v', 'bv')} AS p FROM c, b), place AS (SELECT basis_id, id, p, row_number() OVER (PARTITION BY basis_id ORDER BY p, id) AS pos FROM lines),
        mine AS (SELECT basis_id, e.id, {_dot('e.v', 'bv')} AS p FROM e, b), lt AS (SELECT m.basis_id, m.id, count(*) FILTER (l.p < m.p) AS lt FROM mine m JOIN lines l USING (basis_id) GROUP BY ALL),
        met AS (SELECT DISTINCT lt.id, place.id AS cid FROM lt JOIN place USING (basis_id) WHERE pos BETWEEN lt AND lt + 1),
        near2 AS (SELECT met.id, min(sqrt({_d2('e.v', 'c.v')})) AS distance FROM met JOIN e ON e.id = met.id JOIN c ON c.id = cid GROUP BY met.id)"""


@query(f"WITH {_E}, {_MEANS}, {_NEAR}, {_BASIS}, {_NEAR2} SELECT round((SELECT sqrt(avg(distance * distance) / {DIM}) FROM near), 9) AS rmse, round((SELECT sqrt(avg(distance * distance) / {DIM}) FROM near2), 9) AS approximate")
def rmse_exact_and_approximate(spark, d):
    """Nearest centroids by exact search, and by one neighbour on either side of each projection."""
    found = cluster.rmse_both(vectors(spark, d), keep(spark, label_means(spark, d), "means"), BASIS, 1)
    return found.select(r9("rmse", "rmse"), r9("approximate", "approximate"))


@query(f"WITH {_E} SELECT {DIM} AS n, round(sum({_dot('v', 'v')}), 6) AS energy FROM e")
def singular_value_energy(spark, d):
    """The squares of all singular values add up to those of all components."""
    values = cluster.singular_values(vectors(spark, d))
    return spark.createDataFrame([(len(values), round(sum(x * x for x in values), 6))], "n int, energy double")


def _sketch_weight(index: str):
    def run(spark, d):
        return pts.total_weight(cluster.streaming_kmeans(vectors(spark, d), K, seed=3, index=index)).select(F.round("total_weight", 6).alias("total_weight"))

    run.__name__ = f"streaming_kmeans_weight_{index}"
    query("SELECT round(sum(1.0::DOUBLE + vec_id % 3), 6) AS total_weight FROM embeddings")(run)


for _index in ("projection", "hash"):
    _sketch_weight(_index)


@query("SELECT round(sum(1.0::DOUBLE + vec_id % 3), 6) AS total_weight FROM embeddings")
def split_kmeans_weight(spark, d):
    """The sketch over four blocks, towards four times K centroids."""
    return pts.total_weight(cluster.split_kmeans(vectors(spark, d), K, 4, seed=3)).select(F.round("total_weight", 6).alias("total_weight"))


@query(f"WITH {_E} SELECT sum(w) AS total_weight FROM e")
def total_weight(spark, d):
    return pts.total_weight(vectors(spark, d))


_MEAN = "p AS (SELECT id, w, unnest(v) AS x, generate_subscripts(v, 1)::INT - 1 AS pos FROM e), m AS (SELECT pos, sum(w * x) / sum(w) AS x FROM p GROUP BY pos), mv AS (SELECT list(x ORDER BY pos) AS c FROM m)"


@query(f"WITH {_E}, {_MEAN} SELECT pos, round(x, 9) AS x FROM m")
def weighted_centroid(spark, d):
    return cluster.centroid(vectors(spark, d)).select("pos", r9("x", "x"))


@query(f"WITH {_E}, {_MEAN} SELECT round(sum({_d2('v', 'c')}), 6) AS radius FROM e, mv")
def total_radius(spark, d):
    p = vectors(spark, d)
    return cluster.total_radius(p, cluster.mean_of(p)).select(F.round("radius", 6).alias("radius"))


@query(f"WITH {_E}, {_MEAN}, dd AS (SELECT id, w, {_d2('v', 'c')} AS d FROM e, mv), t AS (SELECT sum(w * d) AS r, sum(w) AS s FROM dd) SELECT id, round(w * (r + s * d) / (2 * r * s), 9) AS p FROM dd, t")
def seed_first_probability(spark, d):
    return cluster.seed_probabilities(vectors(spark, d)).select("id", r9("p", "p"))


def _ball_sql(steps: int) -> str:
    out = [_E, _MEANS.replace("c AS (SELECT id, max", "c0 AS (SELECT id, max")]
    for n in range(steps):
        c = f"c{n}"
        out.append(f"g{n} AS MATERIALIZED (SELECT a.id AS cid, min(sqrt({_d2('a.v', 'b.v')})) AS gap FROM {c} a, {c} b WHERE a.id <> b.id GROUP BY a.id)")
        out.append(f"n{n} AS MATERIALIZED (SELECT id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM (SELECT e.id, x.id AS cid, sqrt({_d2('e.v', 'x.v')}) AS d FROM e, {c} x) GROUP BY id)")
        out.append(f"r{n} AS (SELECT cid, w, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM n{n} JOIN g{n} USING (cid) JOIN e USING (id) WHERE d < 0.9 * gap)")
        out.append(f"m{n} AS (SELECT cid, list(x ORDER BY pos) AS v, max(w) AS w FROM (SELECT cid, pos, sum(w * x) / sum(w) AS x, sum(w) AS w FROM r{n} GROUP BY ALL) GROUP BY cid)")
        out.append(f"c{n + 1} AS MATERIALIZED (SELECT x.id, coalesce(m.w, 0.0::DOUBLE) AS w, coalesce(m.v, x.v) AS v FROM {c} x LEFT JOIN m{n} m ON x.id = m.cid)")
    return f"WITH {', '.join(out)} SELECT id, w, pos - 1 AS pos, round(x, 6) AS x FROM (SELECT id, w, unnest(v) AS x, generate_subscripts(v, 1)::INT AS pos FROM c{steps})"


def _long(c: DataFrame) -> DataFrame:
    return c.select("id", "w", F.posexplode("v").alias("pos", "x")).select("id", "w", "pos", (F.round("x", 6) + 0.0).alias("x"))


@query(_ball_sql(1))
def ball_iteration_1(spark, d):
    return _long(cluster.ball_step(vectors(spark, d), keep(spark, label_means(spark, d), "means"), dim=DIM))


@query(_ball_sql(5))
def ball_iterations_5(spark, d):
    return _long(cluster.ball_kmeans(vectors(spark, d), K, 5, start=keep(spark, label_means(spark, d), "means"), tolerance=-1.0))


@query()
def ball_kmeans(spark, d):
    return _long(cluster.ball_kmeans(vectors(spark, d), K, seed=3))


@query()
def streaming_kmeans(spark, d):
    return _long(cluster.streaming_kmeans(vectors(spark, d), K, seed=3))


@query("SELECT round(sum(1.0::DOUBLE + vec_id % 3), 6) AS total_weight FROM embeddings")
def streaming_kmeans_weight(spark, d):
    """A sketch conserves weight, whatever its centroids."""
    return pts.total_weight(cluster.streaming_kmeans(vectors(spark, d), K, seed=3)).select(F.round("total_weight", 6).alias("total_weight"))


@query()
def streaming_then_ball(spark, d):
    return _long(cluster.sketch_then_ball(vectors(spark, d), K, seed=3))


@query("SELECT vec_id % 4 AS shard, count(*) AS count, sum(1.0::DOUBLE + vec_id % 3) AS total_weight FROM embeddings GROUP BY 1")
def streaming_incremental(spark, d):
    """The stateful operator over a stream of the table; what it conserves is checked by SQL."""
    source = vectors(spark, d)
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source.repartition(3).write.parquet(f"{at}/points")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/points")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states = sketch.streaming_sketches(stream, {"target": K, "cutoff": 1.0}, 4)

        def put(df: DataFrame, n: int) -> None:
            df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")

        run = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(f"{at}/out")
    return out.groupBy("shard").agg(F.max("count").alias("count"), F.max_by("total_weight", "batch").alias("total_weight")).select("shard", "count", F.round("total_weight", 6).alias("total_weight"))


# --- generators, split, sinks -----------------------------------------------------------------------------


@query("SELECT i AS id, pos, ((i >> (2 - pos)) & 1)::DOUBLE AS x FROM range(8) t(i), range(3) p(pos)")
def hypercube_corners(spark, d):
    return generate.corners(spark, 3).select("id", F.posexplode("v").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT corner, 12500 AS n FROM range(8) t(corner)")
def hypercube_points(spark, d):
    """All generated points lie nearest to the corner that made them."""
    points, means = generate.hypercube(spark, 100_000, 3, seed=5)
    hit = cluster.nearest(points, means).filter(F.pmod("id", F.lit(8)) == F.col("centroid_id"))
    return hit.groupBy(F.col("centroid_id").alias("corner")).agg(F.count("*").cast("int").alias("n"))


@query("WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS at, count(*) OVER () AS n FROM embeddings) SELECT count(*) AS n, 4 AS parts, true AS even, true AS apart FROM r")
def split_blocks(spark, d):
    """Blocks are contiguous, and none is over half as large again as an even one."""
    each = cluster.split(vectors(spark, d), 4).groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    before = F.lag("hi").over(Window.orderBy("lo"))
    each = each.withColumn("apart", F.coalesce(F.col("lo") > before, F.lit(True)))
    return each.agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("parts"), (F.max("n") <= 1.5 * F.sum("n") / 4).alias("even"), F.bool_and("apart").alias("apart"))


@query()
def row_sample(spark, d):
    return cluster.sample_rows(vectors(spark, d), 100, seed=2).select("id")


@query("SELECT vec_id AS id, pos - 1 AS pos, round(x, 5) AS x FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1)::INT AS pos FROM embeddings)")
def csv_sink_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(vectors(spark, d), path, ["id"])
    return files.read_csv(spark, path, ["id"]).select(F.col("id").cast("long").alias("id"), F.posexplode("v").alias("pos", "x")).withColumn("x", F.col("x") + 0.0)


# --- text -------------------------------------------------------------------------------------------------

_TOK = r"tok AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}./:]+')) AS word FROM documents) GROUP BY ALL)"
_DF = "df AS (SELECT word, count(*) AS df FROM tok GROUP BY word)"
_TERMS = {"l": "ln(1 + tf)", "t": "tf::DOUBLE", "s": "sqrt(tf)", "x": "1.0::DOUBLE"}
FEATURES = 1024


def _features_sql(scheme: str, idf: str = "int") -> str:
    ratio = "(n + 1) / (df + 1)"
    rate = f"ln(floor({ratio}))" if idf == "int" else f"ln({ratio})"
    weigh = f"w AS (SELECT doc_id, word, {_TERMS[scheme[0]]} AS weight FROM tok)" if scheme[1] == "x" else f"{_DF}, nn AS (SELECT count(*) AS n FROM documents), w AS (SELECT doc_id, word, {_TERMS[scheme[0]]} * {rate} AS weight FROM tok JOIN df USING (word), nn)"
    f = f"f AS (SELECT doc_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % {FEATURES})::INT AS idx, sum(weight) AS val FROM w GROUP BY ALL)"
    if scheme[2] == "c":
        return f"WITH {_TOK}, {weigh}, {f}, l AS (SELECT doc_id, sqrt(sum(val * val)) AS len FROM f GROUP BY doc_id) SELECT doc_id, idx, round(CASE WHEN len <> 0 THEN val / len END, 6) AS val FROM f JOIN l USING (doc_id)"
    return f"WITH {_TOK}, {weigh}, {f} SELECT doc_id, idx, round(val, 6) AS val FROM f"


@query(f"WITH {_TOK} SELECT doc_id, word, tf FROM tok")
def tok_counts(spark, d):
    return text.tokens(documents(spark, d))


@query(f"WITH {_TOK}, {_DF} SELECT word, df FROM df")
def doc_freq(spark, d):
    return text.document_frequency(text.tokens(documents(spark, d)))


@query(_features_sql("xxx"))
def hashed_features(spark, d):
    return text.vectorize(documents(spark, d), "xxx", FEATURES).select("doc_id", "idx", F.round("val", 6).alias("val"))


def _scheme(scheme: str, idf: str = "int"):
    def run(spark, d):
        return text.vectorize(documents(spark, d), scheme, FEATURES, idf).select("doc_id", "idx", F.round("val", 6).alias("val"))

    run.__name__ = f"tfidf_{scheme}" + "_float" * (idf == "float")
    query(_features_sql(scheme, idf))(run)


for _t in text.TERM:
    for _c in "ix":
        for _n in "cx":
            _scheme(_t + _c + _n)
_scheme("lic", "float")


@query("SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE NOT regexp_full_match(line, '(In article .*)|(> .*)|(.*writes:)|(\\|>)') GROUP BY doc_id")
def quoted_line_filter(spark, d):
    return text.unquoted(text.lines(documents(spark, d))).groupBy("doc_id").agg(F.count("*").alias("lines"))


_MAIL = "m AS (SELECT doc_id, string_split('Subject: ' || doc_id::VARCHAR || chr(10) || 'From: x' || chr(10) || chr(10) || coalesce(text, ''), chr(10)) AS ln FROM documents)"


@query(f"WITH {_MAIL}, p AS (SELECT doc_id, unnest(ln) AS line, generate_subscripts(ln, 1) AS k, list_position(ln, '') AS b FROM m) SELECT doc_id, count(*) FILTER (WHERE k < b) AS header_lines, count(*) FILTER (WHERE k > b) AS body_lines, max(CASE WHEN k < b AND line LIKE 'Subject:%' THEN line[9:] END) AS subject FROM p GROUP BY doc_id")
def header_split(spark, d):
    """Each document behind two header lines, of which one is wanted."""
    mail = documents(spark, d).select("doc_id", F.concat(F.lit("Subject: "), F.col("doc_id").cast("string"), F.lit("\nFrom: x\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    counts = text.parts(mail).groupBy("doc_id").agg(F.sum(F.col("is_header").cast("long")).alias("header_lines"), F.sum((~F.col("is_header") & ~F.col("is_blank")).cast("long")).alias("body_lines"))
    return counts.join(text.headers(mail, ["Subject"]).select("doc_id", F.col("value").alias("subject")), "doc_id")
