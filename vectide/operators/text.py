"""Text to hashed, weighted vectors.

documents (doc_id, text) -> tokens (doc_id, word, tf) -> features (doc_id, idx, val). A scheme has three letters:
term weight (l, t, s, x), corpus weight (i, x) and normalisation (c or anything else for none).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line of a quoted message, matched whole, and a word.
QUOTED = r"^((^In article .*)|(^> .*)|(.*writes:$)|(^\|>))$"
WORD = r"[\p{L}\p{Nd}./:]+"
TERM: dict[str, Callable[[Column], Column]] = {"l": F.log1p, "t": lambda tf: tf.cast("double"), "s": F.sqrt, "x": lambda tf: F.lit(1.0)}


def cut(text: Column | str) -> Column:
    """The text's lines; a line ends with a line feed, with a carriage return, or with both."""
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")


def lines(docs: DataFrame) -> DataFrame:
    # The outer form, which is the same here as no text is without a line, spares a filter that would cut texts twice.
    return docs.select("doc_id", F.posexplode_outer(cut("text")).alias("line_no", "line"))


def parts(docs: DataFrame, has_headers: bool = True) -> DataFrame:
    """(doc_id, line_no, line, is_header, is_blank): lines up to the first empty one are headers."""
    split = docs.select("doc_id", cut("text").alias("lines"))
    first = F.when(F.lit(has_headers), F.coalesce(F.nullif(F.array_position("lines", F.lit("")), F.lit(0)) - 1, F.size("lines"))).otherwise(-1)
    out = split.select("doc_id", first.alias("body"), F.posexplode_outer("lines").alias("line_no", "line"))
    return out.select("doc_id", "line_no", "line", (F.col("line_no") < F.col("body")).alias("is_header"), (F.col("line_no") == F.col("body")).alias("is_blank"))


def headers(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc_id, name, value) of the wanted headers, names in lower case."""
    found = parts(docs).filter("is_header").select("doc_id", F.lower(F.substring_index("line", ":", 1)).alias("name"), F.regexp_replace("line", "^[^:]*:?", "").alias("value"))
    return found.filter(F.col("name").isin([w.lower() for w in wanted]))


def unquoted(body: DataFrame) -> DataFrame:
    """Lines that don't quote another message."""
    return body.filter(~F.col("line").rlike(QUOTED))


def counted(text: DataFrame) -> DataFrame:
    """(doc_id, word, tf) of rows (doc_id, line)."""
    found = text.select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower("line"), F.lit(WORD + "+"), F.lit(0))).alias("word"))
    return found.filter("word is not null").groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def tokens(docs: DataFrame, wanted: list[str] | None = None, keep_quotes: bool = True, has_headers: bool = False) -> DataFrame:
    """(doc_id, word, tf): words of the body, and of the values of wanted headers."""
    if keep_quotes and not wanted and not has_headers:  # every line counts, and no word goes beyond one
        return counted(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("line")))
    body = parts(docs, has_headers).filter("not is_header and not is_blank").select("doc_id", "line")
    text = body if keep_quotes else unquoted(body)
    if wanted:
        text = text.unionByName(headers(docs, wanted).select("doc_id", F.col("value").alias("line")))
    return counted(text)


def document_frequency(tokens_: DataFrame) -> DataFrame:
    """(word, df): documents that have the word."""
    return tokens_.groupBy("word").agg(F.count("*").alias("df"))


def weighted(tokens_: DataFrame, scheme: str, n_docs: int, idf: str = "int") -> DataFrame:
    """(doc_id, word, weight). The corpus weight is ln of (N + 1) / (df + 1), in whole numbers unless idf="float"."""
    term = TERM[scheme[0]](F.col("tf"))
    if scheme[1] == "x":
        return tokens_.select("doc_id", "word", term.alias("weight"))
    if scheme[1] != "i":
        raise ValueError(f"unknown corpus weight {scheme[1]!r}")
    ratio = F.lit(n_docs + 1) / (F.col("df") + 1)
    rated = document_frequency(tokens_).select("word", F.log(F.floor(ratio).cast("double") if idf == "int" else ratio).alias("rate"))
    return tokens_.join(rated, "word").select("doc_id", "word", (term * F.col("rate")).alias("weight"))


def bucket(word: Column, dim: int) -> Column:
    """The word's place in a vector: the first 32 bits of its MD5, modulo the dimension."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def hashed(weights: DataFrame, dim: int) -> DataFrame:
    """(doc_id, idx, val): weights added up at hashed places."""
    return weights.groupBy("doc_id", bucket(F.col("word"), dim).alias("idx")).agg(F.sum("weight").alias("val"))


def unit(features: DataFrame) -> DataFrame:
    """Values over their document's length; null where it is 0."""
    length = features.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("length"))
    return features.join(length, "doc_id").select("doc_id", "idx", F.try_divide("val", "length").alias("val"))


def vectorize(docs: DataFrame, scheme: str, dim: int, idf: str = "int", **options) -> DataFrame:
    """(doc_id, idx, val). Documents are counted only where the corpus weight needs it."""
    found = tokens(docs, **options)
    n = docs.count() if scheme[1] == "i" else 0
    out = hashed(weighted(found, scheme, n, idf), dim)
    return unit(out) if scheme[2:3] == "c" else out


def dense(features: DataFrame, dim: int) -> DataFrame:
    """(doc_id, v): features as dense arrays."""
    at = features.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("m"))
    return at.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))
