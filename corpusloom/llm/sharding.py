"""Shards by rendezvous hashing of record keys: a key goes to the shard with its highest weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a number, which a double holds whole.
DIGITS = 13


def number(text: Column) -> Column:
    """A number below 16**DIGITS that a text decides, the same in any engine that knows md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u) for a uniform u that key and shard decide: shards win keys in proportion to their weights."""
    u = (number(F.concat(key, F.lit(f":{shard}"))).cast("double") + 0.5) / float(16**DIGITS)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(scores: Column, n: int) -> Column:
    """Index of the highest of the first n scores. A further shard takes keys only to itself; no other key moves."""
    return (F.array_position(scores, F.array_max(F.slice(scores, 1, n))) - 1).cast("int")


def shard_documents(spark: SparkSession, docs: DataFrame, weights: list[float] | None = None, per_lot: int = 20_000) -> DataFrame:
    """One row for each row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key is doc_id alone, so equal texts may lie apart, and rows that repeat a doc_id lie together. grown_shard is
    the shard with one more of the mean weight. Slots are dealt by lots of a shard's records: equal records count as
    one with a count, lots are numbered one after the other, so no task holds a whole shard.

    A null text has size 1 and the crc32 of no bytes; a null doc_id is a key of its own. Other columns are ignored;
    an empty table gives no rows.
    """
    weights = weights or [1.0] * 16
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    lots = max(1, docs.count() // (per_lot * len(weights)))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("key", key)
    n = len(weights)
    scores = F.array(*[score(F.col("key"), i, w) for i, w in enumerate([*weights, sum(weights) / n])])
    rows = rows.withColumn("scores", scores)
    rows = rows.withColumn("shard", rendezvous(F.col("scores"), n)).withColumn("grown_shard", rendezvous(F.col("scores"), n + 1))
    rows = rows.withColumn("lot", number(F.concat_ws(":", "key", "size", "text_crc32")) % lots).drop("scores", "key")
    by_lot = rows.groupBy("shard", "lot").agg(F.sum("copies").alias("n"))
    upto = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    before = by_lot.select("shard", "lot", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "lot").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("copies").over(own), F.lit(0))).join(before, ["shard", "lot"])
    rows = rows.withColumn("first", F.col("first") + F.col("before")).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard")


_NUMBER = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"
SQL = f"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS c),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
r AS (SELECT doc_id, key, CAST(len(b) + 1 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, c[xor(a & 255, x) + 1])), 4294967295) AS BIGINT) AS text_crc32, list_transform(range(17), lambda i: {_NUMBER.format("key || ':' || i")}) AS u FROM d, c),
s AS (SELECT *, CAST(list_position(u, list_max(u[1:16])) - 1 AS INTEGER) AS shard, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS grown_shard, {_NUMBER.format("key || ':' || size || ':' || text_crc32")} % greatest(1, (SELECT count(*) FROM documents) // 320000) AS lot FROM r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY lot, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard FROM s
"""
