"""License scanning by a positional rare-token index, in DataFrame operations alone.

Licence notices are templates. Every file's words that occur in some template are stored with their positions; words
are rated by inverse document frequency over all files. The index has each template under the word of its mandatory
key phrase that has the highest IDF; a file's words are looked up there, a hit says where the template would start, and
the file's postings are intersected with the template's at that start. It counts when the key phrase stands word for
word and the words in place make up enough of the template's IDF weight. A base phrase is a template of one key phrase.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import keep, table
from vectide.llm.native import LOWERED, UPPER, WORD, words

#: Fixed values: (label, notice, mandatory key phrase). The first three are the base phrases.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
NOTICES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "confidential and proprietary unauthorized copying of this file is strictly prohibited", "unauthorized copying of this file"),
)
#: Share of a template's weight that a start must gather.
COVER = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # the key phrase's place: from, to
    base: bool

    @staticmethod
    def of(label: str, text: str, key: str, base: bool = False) -> Template:
        w, k = tuple(text.split()), tuple(key.split())
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        return Template(label, w, (at, at + len(k)), base)


TEMPLATES = [*(Template.of(label, text, text, True) for label, text in BASE), *(Template.of(*n) for n in NOTICES)]
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})
#: A posting is position * SLOTS + the word's number in VOCABULARY, from 1.
SLOTS = 1024
LONGEST = max(len(t.words) for t in TEMPLATES)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, hits): the postings of each file's licence words, by position."""
    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(VOCABULARY))
    numbers = F.array(*(F.lit(w) for w in VOCABULARY))
    return files.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform(placed, lambda x: x["i"].cast("long") * SLOTS + F.array_position(numbers, x["w"])).alias("hits"))


def frequencies(hits: DataFrame) -> tuple[list[float], int]:
    """(IDF of each word of VOCABULARY, files): ln(1 + (files + 1) / (files with the word + 1))."""
    held = F.array_distinct(F.transform("hits", lambda h: h % SLOTS))
    got = {r["word"]: r["n"] for r in hits.select(F.explode(F.concat(held, F.array(F.lit(0).cast("long")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most SLOTS rows
    files = got.get(0, 0)
    return [math.log(1 + (files + 1) / (got.get(k + 1, 0) + 1)) for k in range(len(VOCABULARY))], files


def _index(idf: list[float]) -> list[tuple]:
    """(anchor word, its place, label, base, postings of the template with their share of its weight, postings of its key)."""
    number = {w: k + 1 for k, w in enumerate(VOCABULARY)}
    out = []
    for t in TEMPLATES:
        weight = [idf[number[w] - 1] for w in t.words]
        at = max(range(*t.key), key=lambda i, weight=weight: (weight[i], -i))
        parts = [(i * SLOTS + number[w], weight[i] / sum(weight)) for i, w in enumerate(t.words)]
        out.append((number[t.words[at]], at, t.label, t.base, parts, [p for p, _ in parts[slice(*t.key)]]))
    return out


def _found(index: list[tuple]) -> Column:
    """Per file: array of (label, base, start, cover) of the templates that stand in it."""
    anchors = F.array(*(F.lit(x).cast("long") for x in sorted({entry[0] for entry in index})))
    looked = F.filter(F.transform("hits", lambda h, k: F.struct(h.alias("h"), k.alias("k"))), lambda x: F.array_contains(anchors, x["h"] % SLOTS))

    def at(x: Column, entry: tuple) -> Column:
        word, place, label, base, parts, key = entry
        start = F.floor(x["h"] / SLOTS) - place
        # Postings are by position: a template's words stand within LONGEST entries of its anchor.
        near = F.slice("hits", F.greatest(x["k"] - LONGEST, F.lit(0)) + 1, F.lit(2 * LONGEST + 1))
        has = lambda code: F.array_contains(near, start * SLOTS + F.lit(code))
        stands = functools.reduce(Column.__and__, (has(c) for c in key))
        cover = functools.reduce(Column.__add__, (F.when(has(c), share).otherwise(0.0) for c, share in parts))
        hit = F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), start.alias("start"), F.lit(1.0).alias("cover") if base else cover.alias("cover"))
        return F.when((x["h"] % SLOTS == word) & stands & (F.lit(True) if base else cover >= COVER), hit)

    met = F.flatten(F.transform(looked, lambda x: F.array_compact(F.array(*(at(x, e) for e in index)))))
    return met


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Null, empty and wordless texts have no words, no labels ("") and score 0. Rows that repeat a doc_id keep a
    row each, with their own text's matches; null ids are kept. An empty table gives no rows. Other columns
    are not looked at.
    """
    files = keep(spark, postings(docs), "licence-words")
    idf, _ = frequencies(files)
    hit = files.select("doc_id", "n_words", _found(_index(idf)).alias("found"))
    base = F.filter("found", lambda x: x["base"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["cover"])), F.lit(0.0))
    return hit.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("found")).alias("labels"), F.round(F.least(score, F.lit(1.0)), 9).alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"({k}, '{t.label}', {t.base}, {i}, '{w}', {t.key[0] <= i < t.key[1]})" for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.words))
    return f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{WORD}') AS w FROM documents),
        tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
        t(t, label, base, i, word, in_key) AS (VALUES {rows}),
        held AS (SELECT word, count(DISTINCT doc_id) AS n FROM tok WHERE word IN (SELECT word FROM t) GROUP BY word),
        rated AS (SELECT t.*, ln(1 + ((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)::DOUBLE) AS idf FROM t LEFT JOIN held USING (word)),
        part AS (SELECT *, idf / sum(idf) OVER (PARTITION BY t) AS share, sum(in_key::INT) OVER (PARTITION BY t) AS need FROM rated),
        met AS (SELECT doc_id, t, label, base, need, pos - i AS start, CASE WHEN base THEN 1.0::DOUBLE ELSE sum(share) END AS cover, sum(in_key::INT) AS got FROM tok JOIN part USING (word) GROUP BY doc_id, t, label, base, need, pos - i),
        ok AS (SELECT * FROM met WHERE got = need AND cover >= {COVER}),
        hit AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM ok GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, round(least(coalesce(score, 0), 1.0::DOUBLE), 9) AS score
        FROM d LEFT JOIN hit USING (doc_id)"""


SQL = {"op7_license_scan": _sql()}
QUERIES = {"op7_license_scan": op7_license_scan}
