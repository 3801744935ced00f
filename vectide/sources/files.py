"""Text files in; labelled vectors out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, text): every file below ``path`` as one document, labelled by its folder."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    return df.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), F.col("value").alias("text"))


def csv_lines(df: DataFrame, head: list[str], v: str = "v") -> DataFrame:
    """(line): head columns, then each component with five decimals, comma-separated."""
    numbers = F.transform(v, lambda x: F.format_string("%.5f", x))
    return df.select(F.concat_ws(",", *(F.col(c).cast("string") for c in head), F.array_join(numbers, ",")).alias("line"))


def write_csv(df: DataFrame, path: str, head: list[str], v: str = "v") -> None:
    csv_lines(df, head, v).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, head: list[str]) -> DataFrame:
    parts = F.split("value", ",")
    names = [F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(head)]
    return spark.read.text(path).select(*names, F.slice(parts, len(head) + 1, F.greatest(F.size(parts) - len(head), F.lit(0))).cast("array<double>").alias("v"))


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_sequence(df: DataFrame, path: str, key: str, v: str = "v") -> None:
    """A Hadoop sequence file of (text, comma-joined vector), for readers that need one."""
    rows = df.select(F.col(key).cast("string"), F.array_join(F.col(v).cast("array<string>"), ","))
    rows.rdd.map(tuple).saveAsSequenceFile(path)


def write_report(df: DataFrame, path: str) -> None:
    """Measurements as one CSV file with a header, a few rows as they are."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
