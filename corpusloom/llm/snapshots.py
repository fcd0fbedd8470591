"""What changed between two snapshots of a table, rows with a new key included: tagged unions and aggregates, no joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch


def _rows(df: DataFrame, later: bool, key: str, content: str, columns: list[str]) -> DataFrame:
    """(key, later, content, values, row_sha256) of a snapshot: digests instead of texts, so that rows stay narrow."""
    cell = {c: F.col("`" + c.replace("`", "``") + "`").cast("string") for c in {content, *columns}}
    digest = F.unhex(F.sha2(cell[content], 256))
    values = F.array(*[F.when(cell[c].isNotNull(), F.xxhash64(cell[c])) for c in columns])
    whole = F.sha2(F.concat_ws("\n", *[F.coalesce(cell[c], F.lit("~")) for c in columns]), 256)
    name = F.col("`" + key.replace("`", "``") + "`").cast("long")
    return df.select(name.alias("key"), F.lit(later).alias("later"), digest.alias("content"), values.alias("values"), F.unhex(whole).alias("row"))


def ranked(scratch: Scratch, rows: DataFrame, group: list[str], order: list[str], name: str, near: list[Column]) -> DataFrame:
    """Adds the rank, from 0, of each row in its group.

    Rows are dealt by ranges of ``near``, short values that keep each group together and in order, so that a group of any size
    lies in many lots; a window ranks each lot, and how many rows of the group lie in lots before comes to the lot as one more
    row of that window. No window holds more than a lot, or a row for each lot of one group.
    """
    lots = scratch.put(rows.repartitionByRange(*near).withColumn("lot", F.spark_partition_id()))
    upto = Window.partitionBy(*group).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    heads = lots.groupBy(*group, "lot").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(upto)).where("before > 0").drop("n")
    own = Window.partitionBy(*group, "lot").orderBy(F.col("before").isNull(), *order)
    both = lots.withColumn("before", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
    both = both.withColumns({"at": F.row_number().over(own), "head": F.first("before").over(own)})
    return both.where("before is null").withColumn(name, F.col("at") - 1 + F.coalesce(F.col("head") - 1, F.lit(0))).drop("lot", "before", "at", "head")


def _sides(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: its earlier and its later row as structs, either may be null."""
    row = F.struct("key", "content", "values", "row")
    return rows.groupBy(*by).agg(F.first(F.when(~F.col("later"), row), ignorenulls=True).alias("old"), F.first(F.when(F.col("later"), row), ignorenulls=True).alias("new"))


def _changed(columns: list[str]) -> Column:
    """Names of the columns in which a pair differs."""
    differs = [F.when(~F.col("old.values")[i].eqNullSafe(F.col("new.values")[i]), F.lit(c)) for i, c in enumerate(columns)]
    return F.concat_ws(",", *differs)


def snapshot_difference(spark: SparkSession, old: DataFrame, new: DataFrame, key: str = "doc_id", content: str = "text", columns: tuple[str, ...] = ("text", "lang", "source")) -> DataFrame:
    """One row for each pair or unpaired row: key, old_key, op, changed, row_sha256.

    Tagged rows of both snapshots meet in one grouping by key: what has both sides is ``same`` or ``update``. The rest
    is ranked by key within its content and side and grouped by (content, rank): pairs are ``rekey``, single rows ``insert``
    or ``delete``. Texts are compared by sha256; of the other columns, by a hash of 64 bits within a pair.

    A null key equals null keys, a null content null contents. Of rows that repeat a key within a snapshot, the i-th in the
    order of their digests meets the i-th of the other snapshot; keys are counted first, and only where some repeat are rows
    numbered so. Equal rows beyond that pair by content like all others. Empty snapshots give inserts or deletes alone;
    columns that aren't named are ignored.
    """
    scratch, names = Scratch(spark), list(columns)
    rows = _rows(old, False, key, content, names).unionByName(_rows(new, True, key, content, names))
    keys = old.select(F.col("`" + key.replace("`", "``") + "`").cast("long").alias("key"), F.lit(False).alias("later")).union(new.select("`" + key.replace("`", "``") + "`", F.lit(True)))
    if keys.groupBy("key", "later").count().where("count > 1").isEmpty():
        rows = rows.withColumn("nth", F.lit(0))
    else:
        rows = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows can be dealt apart by it
        rows = ranked(scratch, rows, ["later", "key"], ["content", "row", "tie"], "nth", [F.col("key"), F.col("later"), F.substring("content", 1, 8), F.substring("row", 1, 8), F.col("tie")])
    met = scratch.put(_sides(rows, ["key", "nth"]).select("old", "new"))
    single = F.when(F.col("old").isNull(), F.col("new")).otherwise(F.col("old"))
    left = met.where("old is null or new is null").select(F.col("old").isNull().alias("later"), single.alias("r")).select("later", "r.*")
    left = ranked(scratch, left, ["content", "later"], ["key", "row"], "nth", [F.xxhash64("content"), F.col("later"), F.col("key")])
    again = _sides(left, ["content", "nth"]).select("old", "new")
    changed = _changed(names)
    by_key = met.where("old is not null and new is not null").withColumn("op", F.when(changed == "", "same").otherwise("update"))
    by_content = again.withColumn("op", F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("rekey"))
    out = by_key.unionByName(by_content)
    pair = F.col("old").isNotNull() & F.col("new").isNotNull()
    return out.select(
        F.when(F.col("new").isNull(), F.col("old.key")).otherwise(F.col("new.key")).alias("key"),
        F.col("old.key").alias("old_key"),
        "op",
        F.when(pair, changed).otherwise("").alias("changed"),
        F.lower(F.hex("new.row")).alias("row_sha256"),
    )


def later_snapshot(docs: DataFrame) -> DataFrame:
    """A later state of (doc_id, text, lang, source): crc32 of the decimal doc_id modulo 16 tells what becomes of a row."""
    kind = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 16"), F.lit(-1))
    moved = -1 - F.col("doc_id")
    keys = F.when(kind.isin(3, 4), F.array(moved)).when(kind == 5, F.array("doc_id", moved)).otherwise(F.array("doc_id"))
    rows = docs.select("doc_id", "text", "lang", "source", kind.alias("kind"), keys.alias("keys")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    swap = F.col("kind") == 2
    source = F.when(swap, F.col("lang")).when(F.col("kind") != 4, F.col("source"))
    return rows.select(F.explode("keys").alias("doc_id"), text.alias("text"), F.when(swap, F.col("source")).otherwise(F.col("lang")).alias("lang"), source.alias("source"))


#: crc32 of a short text, bit by bit over its bytes.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, x: xor(a >> 8, c[xor(a & 255, x) + 1])), 4294967295)"
SQL = f"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS c),
o AS MATERIALIZED (SELECT doc_id AS key, text, lang, source, {_CRC.format("CAST(doc_id AS VARCHAR)")} % 16 AS kind FROM documents, c),
n AS MATERIALIZED (SELECT CASE WHEN kind IN (3, 4) THEN -1 - key ELSE key END AS key, CASE WHEN kind = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN kind = 2 THEN source ELSE lang END AS lang, CASE WHEN kind = 2 THEN lang WHEN kind <> 4 THEN source END AS source FROM o WHERE kind <> 0
 UNION ALL SELECT -1 - key, text, lang, source FROM o WHERE kind = 5),
k AS (SELECT n.key, o.key AS old_key, n.text, n.lang, n.source, o.text AS t, o.lang AS l, o.source AS s FROM o JOIN n USING (key)),
a AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS i FROM o WHERE key NOT IN (SELECT key FROM n)),
b AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY key) AS i FROM n WHERE key NOT IN (SELECT key FROM o)),
m AS (SELECT b.key, a.key AS old_key, b.text, b.lang, b.source, a.text AS t, a.lang AS l, a.source AS s FROM a FULL JOIN b ON a.i = b.i AND a.text IS NOT DISTINCT FROM b.text),
p AS (SELECT *, concat_ws(',', CASE WHEN text IS DISTINCT FROM t THEN 'text' END, CASE WHEN lang IS DISTINCT FROM l THEN 'lang' END, CASE WHEN source IS DISTINCT FROM s THEN 'source' END) AS changed FROM (SELECT *, true AS own FROM k UNION ALL SELECT *, false FROM m)),
q AS (SELECT *, CASE WHEN own THEN CASE WHEN changed = '' THEN 'same' ELSE 'update' END WHEN key IS NULL THEN 'delete' WHEN old_key IS NULL THEN 'insert' ELSE 'rekey' END AS op FROM p)
SELECT coalesce(key, old_key) AS key, old_key, op, CASE WHEN op IN ('insert', 'delete') THEN '' ELSE changed END AS changed,
 CASE WHEN op <> 'delete' THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256 FROM q
"""
