"""The corpus pipeline: language ID, exact dedup, near duplicates, decontamination and mixing, in this order.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the rows that stay,
with the columns of documents; the last adds ``mix_p``, the probability by which a row was sampled. Stages decide by
row: a doc_id that stands on several texts, or a null one, has each of its texts judged by itself. Of rows that repeat
both id and text, the two stages on duplicates keep one, whatever their other columns hold, and the others keep or drop
all. Null texts are rejected by the first stage. Empty tables go through as such.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import decontam, exact, jaccard, language, mixing
from vectide.llm.common import forget, keep, near_texts, shrink_heaps, table
from vectide.plans.store import scratch


def _lean(stage):
    """``stage``, begun with executors whose heaps hold no more than they need, whatever ran before."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


def _without(spark: SparkSession, docs: DataFrame, dropped: DataFrame, mark: Column, repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` but for the rows whose doc_id and ``mark`` are in ``dropped`` (id, mark), and with one row for each in
    ``repeated``. Both are written first, so that their size is known; few enough go to the rows."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))

    def met(other: DataFrame, how: str) -> DataFrame:
        other = near_texts(keep(spark, other.select(F.col("id").alias("of_id"), F.col("mark").alias("of")), "decided"))
        return rows.join(other, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of")), how)

    dropped = dropped.distinct()
    if repeated is None or (repeated := keep(spark, repeated, "repeated")).isEmpty():
        return met(dropped, "left_anti").select("row.*")
    alone = met(dropped.unionByName(repeated), "left_anti")
    return alone.unionByName(met(repeated, "left_semi").dropDuplicates(["id", "mark"])).select("row.*")


@_lean
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text has no letter or no language at a score of one half."""
    return language.accepted(spark, docs)


@_lean
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, once."""
    found = keep(spark, exact.exact_duplicates(spark, docs).select(F.col("doc_id").alias("id"), F.xxhash64("text_sha256").alias("mark"), "kept"), "found")
    repeated = found.filter("kept").groupBy("id", "mark").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    mark = F.xxhash64(F.sha2(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"), 256))
    return _without(spark, docs, found.filter("not kept").drop("kept"), mark, repeated)


@_lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays, once; of several texts of that id, one."""
    found = jaccard.jaccard_components(spark, docs)[0].filter("component is not null").select("component", F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), "mark").alias("row"))
    found = keep(spark, found, "found")
    first = keep(spark, found.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("size")).filter("size > 1"), "first")
    several = keep(spark, found.join(first, "component").select("row.id", "row.mark", (F.col("row") == F.col("first")).alias("kept")), "several")
    repeated = several.filter("kept").groupBy("id", "mark").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return _without(spark, docs, several.filter("not kept").drop("kept"), jaccard.mark_of(F.col("text")), repeated)


@_lean
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in which a benchmark window occurs."""
    found = decontam.contamination(spark, docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    return _without(spark, docs, found.select(F.col("doc_id").alias("id"), "mark"), jaccard.mark_of(F.col("text")))


@_lean
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples rows so that the sample's token shares of source, language and topic meet their targets."""
    return mixing.sample(spark, docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix)]
#: SQL can't express the first stage's model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as stays:  # what a stage wrote on its way goes once its rows are written
            stays.append(kept := keep(spark, stage(spark, docs, sf_dir), name))
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
