"""Virtual documents: the texts of all links to a page, as one document with gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions left free between the texts of two links.
GAP = 64
LINK, HREF = r'(?is)<a\s[^>]*>.*?</a\s*>', r'(?is)^<a\s[^>]*?href\s*=\s*"([^"]*)"'


def resolved(href: Column, base: Column) -> Column:
    """The address that a link names, seen from a page: without fragment; from the host's root on, or beside the page."""
    href = F.regexp_replace(F.trim(href), "#.*$", "")
    host, page = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(page == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    whole = href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.when(href == "", F.lit(None)).when(whole, href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def links(pages: DataFrame) -> DataFrame:
    """(target, page_id, no, words): the links of pages (page_id, url, html) that have a text, numbered within their page."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(0))).alias("no", "link"))
    text = F.regexp_replace("link", "<[^>]*>", " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = found.select(resolved(F.regexp_extract("link", HREF, 1), F.col("url")).alias("target"), "page_id", "no", words.alias("words"))
    return rows.where(F.col("target").isNotNull() & (F.size("words") > 0))


def running_sums(spark: SparkSession, rows: DataFrame, group: str, order: list[str], size: str, path: str) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the rows of a group that come before in order.

    Rows are dealt by ranges of group and order, so a large group lies in many lots, written to ``path``; a window sums up each
    lot, and what lies in the group's lots before comes to a lot as one more row of its window. No task holds a whole group.
    """
    rows.repartitionByRange(F.xxhash64(group), *order).withColumn("lot", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    lots = spark.read.parquet(path)
    earlier = Window.partitionBy(group).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    heads = lots.groupBy(group, "lot").agg(F.sum(size).alias("n")).withColumn("head", F.sum("n").over(earlier)).where("head > 0").select(group, "lot", "head")
    own = Window.partitionBy(group, "lot").orderBy(F.col("head").isNull(), *order).rowsBetween(Window.unboundedPreceding, -1)
    both = lots.withColumn("head", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
    both = both.withColumn("before", F.coalesce(F.sum(F.coalesce("head", F.col(size).cast("long"))).over(own), F.lit(0)))
    return both.where("head is null").drop("head", "lot")


def virtual_postings(spark: SparkSession, pages: DataFrame, path: str, gap: int = GAP) -> DataFrame:
    """(target, term, page_id, positions): words in lower case of the links to each address, by page and link, GAP places apart.

    A posting is one page's share of a term in a virtual document, so no row grows with the number of links to an address.
    """
    rows = links(pages).withColumn("size", F.size("words") + gap)
    placed = running_sums(spark, rows, "target", ["page_id", "no"], "size", path)
    places = placed.select("target", "page_id", "before", F.posexplode("words").alias("i", "word"))
    return places.groupBy("target", F.lower("word").alias("term"), "page_id").agg(F.array_sort(F.collect_list(F.col("before") + F.col("i"))).alias("positions"))


def virtual_documents(postings: DataFrame) -> DataFrame:
    """(target, pages, words, size): how many pages link to an address, with how many words, and the length of its virtual document."""
    return postings.groupBy("target").agg(F.count_distinct("page_id").alias("pages"), F.sum(F.size("positions")).alias("words"), (F.max(F.element_at("positions", -1)) + 1).alias("size"))
