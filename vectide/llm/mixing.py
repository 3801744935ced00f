"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents fall into cells of (source, language, topic). A cell's documents are sampled with one probability; the
probabilities are raked to the three marginal targets in turn, each step scaling the cells of a marginal's value so
that their expected tokens meet the target and cutting what goes above one, until all marginals are met within a
tolerance. A value that holds little of the corpus bounds how large such a sample can be, so the budget gives way to
what the targets allow. ``weight`` is a cell's share of the sample's expected tokens.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import keep, table
from vectide.llm.native import SPACED

#: A marginal's target share is its token share to this power, scaled to one.
TEMPER = 0.5
#: Largest expected share of all tokens that the sample holds.
BUDGET = 0.8
#: Share of the largest budget at which every value alone could meet its target; close to the whole of it raking hardly converges.
ROOM = 0.9
#: Raking ends when no marginal's share is farther from its target than this, or when CYCLES more cycles leave over STALL of that distance.
TOLERANCE, STALL = 1e-7, 0.9
#: Cycles over all axes between two looks at the distance; one plan and one write each.
CYCLES = 5
#: Cells that one task rakes; more are spread over tasks by axis value.
ONE_TASK = 200_000
SEED = "mix-1"
AXES = ("source", "lang", "topic")

#: Fixed topic rules, first match first: (topic, pattern).
TOPICS = (("legal", "(?i)licen[sc]e|copyright|all rights reserved"), ("contact", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.]|[+][0-9]"), ("figures", "[0-9]{3}"))

#: Rules that are asked by parts: text that lacks a part's sign skips its pattern. The parts together match what the
#: rule matches; one character before the sign stands for any number of them.
PARTS = {"contact": (("@", "[A-Za-z0-9._%+-]@[A-Za-z0-9-]+[.]"), ("+", "[+][0-9]"))}


def topic_of(text: Column) -> Column:
    """A document's topic by the fixed rules; "prose" where none matches."""
    out, text = None, F.coalesce(text, F.lit(""))
    for name, pattern in TOPICS:
        hit = functools.reduce(Column.__or__, (text.contains(sign) & text.rlike(part) for sign, part in PARTS[name])) if name in PARTS else text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("prose")


def _cells(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, draw, axes, n_tokens): ``row`` holds the input's columns, or those in ``carry``, whatever their names; ``draw`` is
    the row's number in [0, 1), by doc_id, or by the text where that is null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    axes = (F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias(a) for a in AXES[:2])
    draw = uniform(F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))
    return docs.select(F.struct(*(carry or "*")).alias("row"), draw.alias("draw"), *axes, topic_of(text).alias("topic"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_tokens"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def aimed(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> tuple[DataFrame, float, float]:
    """Cells with tokens: (axes, tokens, to_source, to_lang, to_topic), the expected tokens that each value aims at; with
    the sample's share of all tokens, and its tokens.

    Without ``targets`` (axis: DataFrame of the axis and target) shares go by token counts to the power TEMPER. Targets
    of values without tokens are left out and the others scaled to one; a value without a target aims at none.
    """
    cells = cells.filter("tokens > 0")
    for a in AXES:
        cells = cells.withColumn(f"have_{a}", F.sum("tokens").over(Window.partitionBy(a)))
        if targets:
            cells = cells.join(targets[a].select(a, F.col("target").cast("double").alias(f"raw_{a}")), a, "left").withColumn(f"raw_{a}", F.coalesce(f"raw_{a}", F.lit(0.0)))
        else:
            cells = cells.withColumn(f"raw_{a}", F.pow(F.col(f"have_{a}").cast("double"), F.lit(TEMPER)))
    cells = keep(spark, cells, "aims")
    # A value's raw target is spread over its cells by their tokens, so that it counts once.
    whole = [F.sum(F.col(f"raw_{a}") * F.col("tokens") / F.col(f"have_{a}")).alias(f"whole_{a}") for a in AXES]
    tight = [F.min(F.when(F.col(f"raw_{a}") > 0, F.col(f"have_{a}") / F.col(f"raw_{a}"))).alias(f"tight_{a}") for a in AXES]
    got = cells.agg(F.sum("tokens").alias("n"), *whole, *tight).first()
    if not all(got[f"whole_{a}"] for a in AXES):
        return cells.select(*AXES, "tokens", *(F.lit(0.0).alias(f"to_{a}") for a in AXES)), budget, 0.0
    share = min([budget, *(ROOM * got[f"tight_{a}"] * got[f"whole_{a}"] / got["n"] for a in AXES)])
    return cells.select(*AXES, "tokens", *((F.col(f"raw_{a}") / got[f"whole_{a}"] * (share * got["n"])).alias(f"to_{a}") for a in AXES)), share, share * got["n"]


def rake(spark: SparkSession, cells: DataFrame, share: float, total: float) -> tuple[DataFrame, float]:
    """(axes, tokens, p) from what ``aimed`` gives, and the distance left: of a marginal's share of the sample's expected
    tokens from its target, at most. Targets that no probabilities can meet together leave one."""
    fitted, off, was = cells.withColumn("p", F.lit(share)), math.inf, math.inf
    small = cells.count() <= ONE_TASK  # in one task, no step needs a shuffle
    step, columns = "{fitted}", ", ".join([*cells.columns, "p"])
    for _ in range(CYCLES):
        for a in AXES:
            scaled = f"CASE WHEN have > 0 THEN least(1D, p * to_{a} / have) ELSE 0D END AS p"
            step = f"(SELECT {', '.join(cells.columns)}, {scaled} FROM (SELECT *, sum(p * tokens) OVER (PARTITION BY {a}) AS have FROM {step}))"
    far = ", ".join(f"abs(sum(p * tokens) OVER (PARTITION BY {a}) - to_{a})" for a in AXES)
    cycles = f"SELECT {columns}, greatest({far}) AS off FROM {step}"  # as one text, analysed once
    while total and off > TOLERANCE and not off > STALL * was:
        again = keep(spark, spark.sql(cycles, fitted=fitted.coalesce(1) if small else fitted), "raked")
        off, was = again.coalesce(1).agg(F.max("off")).first()[0] / total, off
        fitted = again.drop("off")
    return fitted.select(*AXES, "tokens", "p"), off if total else 0.0


def mixed(spark: SparkSession, docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (row, source, lang, topic, n_tokens, weight, p, residual, sampled); ``row`` is the input row.

    A caller who needs few of the columns names them in ``carry`` (doc_id among them): these rows are written to the
    shared folder and texts read once; whole rows aren't written, but measured twice.

    A null source or lang is the value "unknown"; null text is empty, has no tokens and gets its cell's probability, or
    the sample's share of all tokens where the cell has none. Rows that repeat a doc_id share its draw; rows without one
    draw by their texts. An empty table gives no rows. Extra columns stay in ``row`` and clash with nothing.
    """
    rows = _cells(docs, carry)
    if carry:
        rows = keep(spark, rows, "measured")
    cells = keep(spark, rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")), "cells")
    goals, share, total = aimed(spark, cells, targets, budget)
    fitted, residual = rake(spark, goals, share, total)
    rated = fitted.select(*AXES, "p", (F.col("p") * F.col("tokens") / (total or 1.0)).alias("weight"))
    p = F.coalesce("p", F.lit(share))
    return rows.join(rated, list(AXES), "left").select("row", *AXES, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), p.alias("p"), F.lit(residual).alias("residual"), (F.col("draw") < p).alias("sampled"))


def sample(spark: SparkSession, docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled input rows, with ``mix_p`` (a column of that name in the input gives way to it)."""
    picked = mixed(spark, docs, targets, budget).filter("sampled")
    return picked.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "mix_p"), F.col("p").alias("mix_p"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(spark, table(spark, sf_dir, "documents"), carry=("doc_id",))
    return found.select(F.col("row.doc_id").alias("doc_id"), *AXES, "n_tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "sampled")


def _sql() -> str:
    ask = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{pattern}') THEN '{name}'" for name, pattern in TOPICS)
    per = lambda each, axes=AXES: ", ".join(each.format(a=a) for a in axes)
    step = f"(SELECT * FROM r WHERE off > {TOLERANCE} AND NOT off > {STALL} * was)"
    for _ in range(CYCLES):
        for a in AXES:
            step = f"(SELECT * EXCLUDE (have) REPLACE (CASE WHEN have > 0 THEN least(1.0::DOUBLE, p * to_{a} / have) ELSE 0 END AS p) FROM (SELECT *, sum(p * tokens) OVER (PARTITION BY {a}) AS have FROM {step}))"
    off = f"(SELECT *, greatest({per('abs(sum(p * tokens) OVER (PARTITION BY {a}) - to_{a})')}) / total AS far FROM {step})"
    columns = f"source, lang, topic, tokens, {per('to_{a}')}, share, total"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, CASE {ask} ELSE 'prose' END AS topic, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::BIGINT AS n_tokens FROM documents),
        c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
        h AS (SELECT *, {per('sum(tokens) OVER (PARTITION BY {a}) AS have_{a}')} FROM c),
        k AS (SELECT sum(tokens) AS n, {per(f'sum(pow(have_{{a}}, {TEMPER}) * tokens / have_{{a}}) AS whole_{{a}}, min(have_{{a}} / pow(have_{{a}}, {TEMPER})) AS tight_{{a}}')} FROM h),
        g AS (SELECT least({BUDGET}::DOUBLE, {per(f'{ROOM}::DOUBLE * tight_{{a}} * whole_{{a}} / n')}) AS share FROM k),
        aim AS (SELECT source, lang, topic, tokens, {per(f'pow(have_{{a}}, {TEMPER}) / whole_{{a}} * (share * n) AS to_{{a}}')}, share, share * n AS total FROM h, k, g),
        r AS (SELECT 0 AS step, {columns}, share AS p, 'inf'::DOUBLE AS off, 'inf'::DOUBLE AS was FROM aim
            UNION ALL SELECT step + 1, {columns}, p, max(far) OVER () AS off, off AS was FROM {off}),
        f AS (SELECT * FROM r WHERE step = (SELECT max(step) FROM r))
        SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p * tokens / total, 0), 6) AS weight, round(coalesce(p, s.share), 6) AS p,
               ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < coalesce(p, s.share) AS sampled
        FROM d LEFT JOIN f USING (source, lang, topic), g s"""


SQL = {"op6_mix_sources": _sql()}
QUERIES = {"op6_mix_sources": op6_mix_sources}
