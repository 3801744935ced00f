"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

Texts are cut into words once. Postings (document, word, position) of every word that some benchmark window holds are
stored in the shared folder, with each document's length as the posting of a word of its own. A window (ten consecutive
words; a shorter item is one window) is looked up by its rarest words, rarity being the count in the whole corpus: the
rarest word's list is met with the second rarest's near by, which gives the proximity matches; where the two stand as
far apart as in the window, the remaining words' lists, each moved by its place in the window, are intersected, which
gives the exact matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import forget, keep, table
from vectide.llm.native import LOWERED, UPPER, WORD, words

WINDOW = 10
#: The word whose posting stands where a document ends.
END = 0


def _windows(spark: SparkSession, items: DataFrame, window: int) -> DataFrame:
    """(wid, item, size, phrase): each item's distinct windows."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = w.withColumn("size", F.least(F.size("w"), F.lit(window)))
    each = cut.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("phrase")).distinct()
    return keep(spark, each.withColumn("wid", F.monotonically_increasing_id()), "windows")


def index(spark: SparkSession, docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored postings (doc_id, mark, word, pos) of the words in ``vocabulary`` (word, text), positions counting from 0;
    word END has each row's number of words. ``mark`` tells rows apart that repeat a doc_id with another text."""
    text = F.col("text").cast("string")
    key = (F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    # No word is empty. The outer form, which is the same here, spares a filter for which words would be cut twice.
    each = docs.select(*key, F.posexplode_outer(F.concat(words(text), F.array(F.lit("")))).alias("pos", "text"))
    return keep(spark, each.join(vocabulary, "text").select("doc_id", "mark", "word", "pos"), "postings")


def anchored(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, postings). A window row: wid, item, size, phrase (words in order), rare and next (the rarest and second
    rarest; one word is both), at and then (their places). Windows with a word that no document has are left out."""
    phrases = _windows(spark, items, window)
    spread = phrases.select("wid", F.posexplode("phrase").alias("at", "text"))
    vocabulary = spread.select("text").distinct().select((F.monotonically_increasing_id() + END + 1).alias("word"), "text")
    vocabulary = keep(spark, vocabulary.unionByName(spark.createDataFrame([(END, "")], "word long, text string")), "vocabulary")
    postings = index(spark, docs, vocabulary)
    counts = keep(spark, postings.groupBy("word").agg(F.count("*").alias("n")), "counts")
    rated = spread.join(vocabulary, "text").join(counts, "word", "left")
    by = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "text", "at", "word")
    ranked = rated.groupBy("wid").agg(F.sort_array(F.collect_list(by)).alias("r"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("p"))
    first, second = F.get("r", F.lit(0)), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    chosen = ranked.filter(first["n"] > 0).select("wid", F.transform("p", lambda x: x["word"]).alias("phrase"), first["word"].alias("rare"), first["at"].alias("at"), second["word"].alias("next"), second["at"].alias("then"))
    return keep(spark, chosen.join(phrases.select("wid", "item", "size"), "wid"), "anchors"), postings


def _same(left: DataFrame, right: DataFrame, *on: str) -> Column:
    """Rows of one document, alike in the columns ``on``."""
    same = left["doc_id"].eqNullSafe(right["doc_id"]) & (left["mark"] == right["mark"])
    for c in on:
        same &= left[c] == right[c]
    return same


def _near(spark: SparkSession, chosen: DataFrame, postings: DataFrame, within: int) -> DataFrame:
    """(doc_id, mark, wid, item, start, exact): where a window's two rarest words stand fewer than ``within`` words apart, in
    any order; ``exact`` if they stand as they do in the window, which would then begin at ``start``."""
    lists = postings.filter(F.col("word") != END)
    rare = lists.join(chosen.select("wid", "item", "size", F.col("rare").alias("word"), "at", "next", "then"), "word")
    # Places within reach stand in one block of 4 * within places, or in two.
    block = lambda place: F.floor(place / (4 * within))
    blocks = F.explode(F.sequence(block(F.col("pos") - within + 1), block(F.col("pos") + within - 1)))
    rare = keep(spark, rare.select("doc_id", "mark", "wid", "item", "size", "pos", (F.col("pos") - F.col("at")).alias("start"), "then", F.col("next").alias("word"), blocks.alias("block")), "rare")
    second = lists.join(chosen.select(F.col("next").alias("word")).distinct(), "word", "left_semi")
    other = second.select("doc_id", "mark", "word", F.col("pos").alias("place"), block(F.col("pos")).alias("block"))
    met = rare.join(other, _same(rare, other, "word", "block")).filter((F.abs(F.col("place") - F.col("pos")) < within) & ((F.col("place") != F.col("pos")) | (F.col("size") == 1)))
    found = met.select(rare["doc_id"], rare["mark"], "wid", "item", "start", (F.col("place") == F.col("start") + F.col("then")).alias("exact"))
    found = keep(spark, found.groupBy("doc_id", "mark", "wid", "item", "start").agg(F.bool_or("exact").alias("exact")), "near")
    forget(rare)
    return found


def _exact(spark: SparkSession, chosen: DataFrame, postings: DataFrame, near: DataFrame) -> DataFrame:
    """(doc_id, mark, item, start, size) of the windows all of whose words stand in place."""
    open_ = near.filter("exact").join(chosen.select("wid", "size", "phrase"), "wid").select("doc_id", "mark", "wid", "item", "start", "size", F.posexplode("phrase").alias("at", "word"))
    open_ = keep(spark, open_.withColumn("pos", F.col("start") + F.col("at")), "open")
    some = keep(spark, open_.select("doc_id", "mark").distinct(), "documents")
    lists = postings.join(some, _same(postings, some), "left_semi")
    met = open_.join(lists, _same(open_, lists, "word", "pos")).select(open_["doc_id"], open_["mark"], "wid", "item", "start", "size", "at")
    whole = met.groupBy("doc_id", "mark", "wid", "item", "start", "size").agg(F.size(F.collect_set("at")).alias("n")).filter("n = size")
    return whole.select("doc_id", "mark", "item", "start", "size")


def occurrences(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every exact occurrence: (doc_id, mark, item, start, size), start counting words from 0."""
    chosen, postings = anchored(spark, docs, items, window)
    return _exact(spark, chosen, postings, _near(spark, chosen, postings, window))


def proximity(spark: SparkSession, docs: DataFrame, items: DataFrame, within: int = WINDOW) -> DataFrame:
    """Items of which a window's two rarest words stand fewer than ``within`` words apart: (doc_id, mark, item)."""
    return _near(spark, *anchored(spark, docs, items, within), within).select("doc_id", "mark", "item").distinct()


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: (doc_id, mark, n_words, n_hit, n_items, n_near, items_sha256, contaminated).

    n_near counts the items that ``proximity`` finds; all else is of exact occurrences. Null and wordless texts have no
    words and no hits; wordless items have no windows. Rows that repeat a doc_id each keep a row, with their own text's
    hits. Null ids are kept, and a null item_id is no item. Empty tables give no rows or no hits. Other columns are not
    looked at.
    """
    chosen, postings = anchored(spark, docs, items.filter("item_id is not null"), window)
    near = _near(spark, chosen, postings, window)
    close = near.select("doc_id", "mark", "item").distinct().groupBy("doc_id", "mark").agg(F.count("*").alias("n_near"))
    hits = _exact(spark, chosen, postings, near).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    # The length of the union of the spans, walked by start.
    covered = F.expr("aggregate(array_sort(spans), named_struct('to', 0, 'n', 0L), (a, s) -> named_struct('to', greatest(a.to, s.start + s.size), 'n', a.n + greatest(0, s.start + s.size - greatest(a.to, s.start))), a -> a.n)")
    hits = hits.select("doc_id", "mark", covered.alias("hit"), "items")
    found = close.join(hits, _same(close, hits), "left").select(close["doc_id"], close["mark"], "n_near", "hit", "items")
    found = keep(spark, found, "hits")
    every = postings.filter(F.col("word") == END).select("doc_id", "mark", F.col("pos").cast("long").alias("n_words"))
    joined = every.join(found, _same(every, found), "left").select(every["doc_id"], every["mark"], "n_words", "n_near", "hit", "items")
    items_of, zero = F.coalesce("items", F.array().cast("array<string>")), F.lit(0).cast("long")
    n_hit = F.coalesce("hit", zero)
    return joined.select("doc_id", "mark", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.coalesce("n_near", zero).alias("n_near"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{WORD}')"
SQL = {
    "op8_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        cut AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM cut),
        sized AS (SELECT DISTINCT size FROM bw),
        spot AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sized),
        dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM spot),
        hit AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, k)),
        place AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit),
        n AS (SELECT doc_id, count(*) AS n_hit FROM place GROUP BY doc_id),
        who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id),
        tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        often AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
        term AS (SELECT item_id, size, k, unnest(string_split(k, ' ')) AS word, generate_subscripts(string_split(k, ' '), 1) AS ord FROM bw),
        ranked AS (SELECT item_id, size, k, word, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item_id, k ORDER BY coalesce(n, 0), word, ord) AS r FROM term LEFT JOIN often USING (word)),
        pair AS (SELECT DISTINCT a.item_id, a.size, a.word AS rare, b.word AS next FROM ranked a JOIN ranked b USING (item_id, k) WHERE a.r = 1 AND a.n > 0 AND b.r = least(2, a.size)),
        close AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM pair JOIN tok a ON a.word = rare JOIN tok b USING (doc_id) WHERE b.word = next AND abs(a.pos - b.pos) < 10 AND (a.pos <> b.pos OR size = 1) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(n_near, 0)::BIGINT AS n_near,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN who USING (doc_id) LEFT JOIN close USING (doc_id)"""
}
QUERIES = {"op8_decontaminate": op8_decontaminate}
