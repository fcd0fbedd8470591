"""Benchmark passages in documents: winnowed word-gram fingerprints find candidates, exact windows extend the hits. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, pack_row, small_side

WINDOW, GRAM = 10, 5
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text whose A-Z are in lower case; other letters stay as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(F.coalesce(low, F.lit("")), BETWEEN_WORDS), lambda w: w != "")


def grams(hashes: Column, n: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; empty if there are fewer."""
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(F.lit(size), *[hashes[i + k] for k in range(size)]))
    return F.when(n >= size, each).otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: Column, n: Column, window: int, gram: int) -> Column:
    """The least gram hash of each ``window`` words. Any two equal runs of ``window`` words share one."""
    span = window - gram + 1
    least = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - span), lambda i: F.least(*[g[i + k] for k in range(span)])))
    chosen = F.transform(F.array(grams(hashes, n, gram)), least)[0]
    return F.when(n >= window, chosen).otherwise(F.array().cast("array<bigint>"))


def with_words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))


def find_contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits (and the whole
    row as the struct ``row``, if ``carry`` asks for it).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. n_hit counts the words inside any
    occurrence of a window, ``hits`` has those ranges of words. Grams of every length that a shorter item has are looked
    up as well. Fingerprints only choose the documents whose windows are then compared word by word.

    Null and empty texts have no words; items without words have no windows. Repeated items count once by item_id; a null
    item_id is written as "null". Repeated documents each get their row. Other columns are ignored; an empty table of
    documents gives no rows, one of items no hits.
    """
    scratch = Scratch(spark)
    test = scratch.put(with_words(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")).where("n > 0").select("item", "words", "n"))
    short = sorted(r.n for r in test.where(F.col("n") < window).select("n").distinct().collect())

    hashed = lambda df: df.withColumn("g", F.transform("words", lambda w: F.xxhash64(w)))
    g, n = F.col("g"), F.col("n")
    own = winnowed(g, n, window, gram)
    for size in short:
        own = F.when(n == size, grams(g, n, size)).otherwise(own)
    prints = hashed(test).select(F.explode(own).alias("f")).distinct()
    all_ = F.concat(winnowed(g, n, window, gram), *[grams(g, n, size) for size in short])
    named = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    carried = [pack_row(docs).alias("row")] * carry
    seen = hashed(with_words(named)).select("doc_id", "h", F.explode(all_).alias("f"))
    candidates = scratch.put(seen.join(small_side(scratch.put(prints)), "f", "left_semi").select("doc_id", "h").distinct())

    runs = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice("words", i + 1, size), " ").alias("run"))))
    none = F.array().cast("array<struct<at:int,size:int,run:string>>")
    of_item = F.coalesce(runs(window), none)
    for size in short:
        of_item = F.when(n == size, runs(size)).otherwise(of_item)
    owners = test.select("item", F.explode(of_item).alias("w")).groupBy("w.size", "w.run").agg(F.array_sort(F.collect_set("item")).alias("items"))
    owners = scratch.put(owners.withColumn("owners", F.xxhash64("items")))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    dirty = named.alias("a").join(small_side(candidates).alias("b"), same("a", "b"), "left_semi").distinct()
    places = with_words(dirty).select("doc_id", "h", F.explode(F.concat(F.coalesce(runs(window), none), *[F.coalesce(runs(size), none) for size in short])).alias("w"))
    places = places.select("doc_id", "h", "w.at", "w.size", "w.run")
    found = scratch.put(places.join(small_side(owners.select("size", "run", "owners")), ["size", "run"]).select("doc_id", "h", "at", "size", "owners"))

    spans = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop")))).alias("s"))
    merged = F.aggregate("s", F.array().cast("array<struct<start:int,stop:int>>"), lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["stop"] >= x["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(out, F.array(x))))
    spans = spans.select("doc_id", "h", merged.alias("hits"))
    groups = owners.select("owners", "items").dropDuplicates(["owners"])
    lists = found.select("doc_id", "h", "owners").distinct().join(groups, "owners").groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    told = scratch.put(spans.alias("a").join(lists.alias("b"), same("a", "b")).select("a.doc_id", "a.h", "hits", "items"))
    scratch.drop_all_but(told)
    out = docs.select("doc_id", F.xxhash64("text").alias("h"), *carried, F.size(words_of(F.col("text"))).cast("long").alias("n_words")).alias("a").join(small_side(told, 200_000).alias("b"), same("a", "b"), "left")
    hit = F.aggregate(F.coalesce("hits", F.array().cast("array<struct<start:int,stop:int>>")), F.lit(0), lambda s, x: s + x["stop"] - x["start"]).cast("long")
    n_items = F.coalesce(F.size("items"), F.lit(0))
    return out.select(F.col("a.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(n_items).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "hits", *["row"] * carry)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS run FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(s) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, z.size, s, array_to_string(w[s : s + z.size - 1], ' ') AS run FROM d, (SELECT DISTINCT size FROM iw) AS z, unnest(generate_series(1, len(w) - z.size + 1)) AS t(s)),
hit AS (SELECT dw.doc_id, dw.s, dw.size, iw.item FROM dw JOIN iw USING (size, run)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
