"""Merkle fixity audit of archived records, in DataFrame operations.

Pages become WARC records in archive files of a fixed span of ids, each at an ordered offset range. A record's
digest is a leaf; FANOUT neighbouring nodes and their offset ranges make one of the next level, up to one root a file. Two replicas are
compared by roots; only below roots that differ are the next level's nodes compared, and so on down to the
records, so what is compared grows with the damage and not with the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import keep, table

#: Ids that one archive file spans, and children of a node.
SPAN, FANOUT, LEVELS = 4096, 16, 3


def record(url: Column, html: Column) -> Column:
    """A page as a WARC response record; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(file, slot, length, digest): one leaf an id. Repeated rows count once; several records of one id make one leaf."""
    text = record(F.col("url").cast("string"), F.col("html").cast("string"))
    each = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))
    one = each.distinct().groupBy("page_id").agg(F.sum("length").alias("length"), F.count("*").alias("n"), F.min("digest").alias("first"), F.array_sort(F.collect_set("digest")).alias("all"))
    slot = F.pmod("page_id", F.lit(SPAN))
    return one.select(((F.col("page_id") - slot) / SPAN).cast("long").alias("file"), slot.cast("long").alias("slot"), "length", F.when(F.col("n") == 1, F.col("first")).otherwise(F.sha2(F.array_join("all", ","), 256)).alias("digest"))


def parents(nodes: DataFrame) -> DataFrame:
    """(file, slot, length, digest) of the next level. A digest is of the children's slots, offset ranges and digests, in
    order; ranges count from the node's own start, so that what one record's length moves is told once, above it."""
    up = nodes.groupBy("file", F.floor(F.col("slot") / FANOUT).alias("slot")).agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("slot", "length", "digest"))).alias("cs"))

    def child(x: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("cs", F.lit(1), i), F.lit(0).cast("long"), lambda t, y: t + y["length"])
        return F.concat(x["slot"].cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), (start + x["length"]).cast("string"), F.lit(":"), x["digest"])

    return up.select("file", "slot", "length", F.sha2(F.array_join(F.transform("cs", child), ","), 256).alias("digest"))


def tree(spark: SparkSession, pages: DataFrame) -> list[DataFrame]:
    """The levels of all files' trees, records first, roots last."""
    levels = [keep(spark, leaves(pages), "leaves")]
    for _ in range(LEVELS):
        levels.append(keep(spark, parents(levels[-1]), "nodes"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, slot, a, b): nodes whose digests differ, or that one side lacks."""
    left = a.select("file", "slot", F.col("digest").alias("a"))
    right = b.select("file", "slot", F.col("digest").alias("b"))
    return left.join(right, ["file", "slot"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))


def audit(spark: SparkSession, primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records: (page_id, file, start, length, status, primary_root, replica_root).

    start and length are the record's range in the primary's file (null for a record that only the replica has);
    status is "corrupt", "missing" (in the replica) or "extra". Rows with a null page_id are no records; null url
    and html are empty. Equal replicas and empty tables give no rows; other columns are not looked at.
    """
    a, b = tree(spark, primary), tree(spark, replica)
    suspects = roots = keep(spark, _differing(a[-1], b[-1]), "suspects")
    for low_a, low_b in zip(a[-2::-1], b[-2::-1], strict=True):
        above = suspects.select("file", F.col("slot").alias("up"))
        below = lambda nodes, above=above: nodes.withColumn("up", F.floor(F.col("slot") / FANOUT)).join(above, ["file", "up"], "left_semi")
        suspects = keep(spark, _differing(below(low_a), below(low_b)), "suspects")
    # Offsets only of files with damage: at most SPAN records each.
    run = F.sum("length").over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = a[0].join(roots.select("file"), "file", "left_semi").select("file", "slot", "length", (run - F.col("length")).alias("start"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    found = suspects.withColumn("status", status).drop("a", "b").join(placed, ["file", "slot"], "left").join(roots.select("file", F.col("a").alias("primary_root"), F.col("b").alias("replica_root")), "file")
    return found.select((F.col("file") * SPAN + F.col("slot")).alias("page_id"), "file", "start", "length", "status", "primary_root", "replica_root")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with made-up damage, for the query: every 97th id overwritten at its start, every 101st lost, every 103rd cut short."""
    i = F.col("page_id")
    html = F.when(i % 97 == 0, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).when(i % 103 == 0, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    return pages.filter(i % 101 != 0).withColumn("html", html)


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(spark, pages, damaged(pages))


def _side(name: str, frm: str) -> str:
    levels = [f"{name}0 AS (SELECT page_id, page_id // {SPAN} AS file, page_id % {SPAN} AS slot, strlen(r)::BIGINT AS length, sha256(r) AS digest FROM (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM {frm}))"]
    for k in range(1, LEVELS + 1):
        levels.append(f"{name}r{k} AS (SELECT file, slot, length, digest, (sum(length) OVER (PARTITION BY file, slot // {FANOUT} ORDER BY slot))::BIGINT AS stop FROM {name}{k - 1})")
        levels.append(f"{name}{k} AS (SELECT file, slot // {FANOUT} AS slot, sum(length)::BIGINT AS length, sha256(string_agg(slot || ':' || (stop - length) || '-' || stop || ':' || digest, ',' ORDER BY slot)) AS digest FROM {name}r{k} GROUP BY file, slot // {FANOUT})")
    return ", ".join(levels)


SQL = {
    "op2_warc_fixity": f"""
        WITH other AS (SELECT page_id, url, CASE WHEN page_id % 97 = 0 THEN '#' || substr(html, 2) WHEN page_id % 103 = 0 THEN substr(html, 1, length(html) - 1) ELSE html END AS html FROM pages WHERE page_id % 101 <> 0),
        {_side('a', 'pages')}, {_side('b', 'other')},
        placed AS (SELECT page_id, file, length, digest, (sum(length) OVER (PARTITION BY file ORDER BY slot) - length)::BIGINT AS start FROM a0)
        SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file, b.file) AS file, a.start, a.length,
               CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' ELSE 'corrupt' END AS status, ra.digest AS primary_root, rb.digest AS replica_root
        FROM placed a FULL JOIN b0 b USING (page_id) LEFT JOIN a{LEVELS} ra ON ra.file = coalesce(a.file, b.file) LEFT JOIN b{LEVELS} rb ON rb.file = coalesce(a.file, b.file)
        WHERE a.digest IS DISTINCT FROM b.digest"""
}
QUERIES = {"op2_warc_fixity": op2_warc_fixity}
