"""Minimal-interval algebra on (part, doc_id, l, r): running maxima within a document instead of range joins.

Operands come as one table whose column ``k`` tells them apart, so that what one scan finds is never shuffled: rows of a
document lie in one partition from the index on. Intervals may carry ``marks``, the labels and positions of the atoms that
they were made of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from corpusloom.operators.blocks import KEY

COLUMNS = [*KEY, "l", "r"]


def no_marks() -> Column:
    return F.array().cast("array<struct<label:int,pos:int>>")


def marked(df: DataFrame) -> list[str]:
    return ["marks"] if "marks" in df.columns else []


def keyed(df: DataFrame) -> DataFrame:
    return df if "part" in df.columns else df.withColumn("part", F.lit(0))


def tagged(*parts: DataFrame) -> DataFrame:
    """The intervals of several tables as one, numbered by ``k``."""
    parts = [keyed(p) for p in parts]
    marks = any(marked(p) for p in parts)
    own = [p.withColumn("marks", no_marks()) if marks and not marked(p) else p for p in parts]
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS, *marked(p), F.lit(i).alias("k")) for i, p in enumerate(own)])


def upto(by: str) -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def _left(df: DataFrame) -> Column:
    """The left end with its marks; of several the greatest comes last."""
    return F.struct("l", *marked(df))


def _joined(*structs: Column) -> Column:
    return F.concat(*[s["marks"] for s in structs]).alias("marks")


def antichain(a: DataFrame) -> DataFrame:
    """Intervals that contain no other: those that start after all that end before them, or with them and come first."""
    a = keyed(a)
    order = [F.col("r"), F.col("l").desc(), *[F.col(c).desc() for c in marked(a)]]
    before = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return a.withColumn("m", F.max("l").over(before)).where("m is null or l > m").select(*COLUMNS, *marked(a))


def points(hits: DataFrame) -> DataFrame:
    return hits.select(*KEY, F.col("pos").alias("l"), F.col("pos").alias("r"), *marked(hits))


def any_of(*parts: DataFrame) -> DataFrame:
    return antichain(tagged(*parts))


def all_of(*parts: DataFrame) -> DataFrame:
    """Smallest intervals that hold one interval of each part."""
    return all_tagged(tagged(*parts), len(parts))


def all_tagged(t: DataFrame, n: int) -> DataFrame:
    latest = [F.max(F.when(F.col("k") == i, _left(t))).over(upto("r")).alias(f"m{i}") for i in range(n)]
    own = [F.col(f"m{i}") for i in range(n)]
    found = t.select(*KEY, "r", *latest).where(reduce(Column.__and__, [m.isNotNull() for m in own]))
    low = F.least(*[m["l"] for m in own]) if n > 1 else own[0]["l"]
    return antichain(found.select(*KEY, low.alias("l"), "r", *[_joined(*own) for _ in marked(t)]))


def ordered(a: DataFrame, b: DataFrame) -> DataFrame:
    return ordered_tagged(tagged(a, b))


def ordered_tagged(t: DataFrame) -> DataFrame:
    """Smallest intervals of an interval 0 and an interval 1 that starts after it."""
    first = F.col("k") == 0
    events = t.withColumn("at", F.when(first, F.col("r") + 1).otherwise(F.col("l")))
    found = events.withColumn("open", F.max(F.when(first, _left(t))).over(upto("at"))).where("k = 1 and open is not null")
    return antichain(found.select(*KEY, F.col("open.l").alias("l"), "r", *[F.concat("open.marks", "marks").alias("marks") for _ in marked(t)]))


def phrase(hits: DataFrame, size: int) -> DataFrame:
    """Consecutive positions of the words 0, 1, ... of a phrase (column k): one aggregation by document and start."""
    starts = keyed(hits).groupBy(*KEY, (F.col("pos") - F.col("k")).alias("l")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == size).select(*KEY, "l", (F.col("l") + size - 1).alias("r"))


def gapped(hits: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Words 0, 1, ... of a phrase in order, where between word k-1 and word k lie from ``offsets[k][0]`` to ``offsets[k][1]`` others.

    Word by word, each place keeps the latest start of a run that ends there: the latest place of the word before within
    the gap is found by a window over positions. Smallest intervals are returned.
    """
    t = keyed(hits).withColumn("start", F.when(F.col("k") == 0, F.col("pos")))
    for k in range(1, len(offsets)):
        low, high = offsets[k]
        w = Window.partitionBy(*KEY).orderBy("pos").rangeBetween(-high - 1, -low - 1)
        t = t.withColumn("start", F.when(F.col("k") == k, F.max(F.when(F.col("k") == k - 1, F.col("start"))).over(w)).otherwise(F.col("start")))
    return antichain(t.where((F.col("k") == len(offsets) - 1) & F.col("start").isNotNull()).select(*KEY, F.col("start").alias("l"), F.col("pos").alias("r")))


def within(a: DataFrame, size: int) -> DataFrame:
    return a.where(F.col("r") - F.col("l") + 1 <= size)


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    return aligned_tagged(tagged(a, b))


def aligned_tagged(t: DataFrame) -> DataFrame:
    """Intervals that are both an interval 0 and an interval 1."""
    sides = [F.max(F.when(F.col("k") == i, _left(t))).alias(f"m{i}") for i in (0, 1)]
    met = t.groupBy(*KEY, "l", "r").agg(*sides).where("m0 is not null and m1 is not null")
    return met.select(*COLUMNS, *[_joined(F.col("m0"), F.col("m1")) for _ in marked(t)])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference_tagged(tagged(a, b))


def difference_tagged(t: DataFrame) -> DataFrame:
    """Intervals 0 that hold no interval 1."""
    inner = F.max(F.when(F.col("k") == 1, F.col("l"))).over(upto("r"))
    return t.withColumn("m", inner).where("k = 0 and (m is null or m < l)").select(*COLUMNS, *marked(t))


def holding(a: DataFrame, b: DataFrame) -> DataFrame:
    return holding_tagged(tagged(a, b))


def holding_tagged(t: DataFrame) -> DataFrame:
    """Intervals 0 that hold an interval 1: the latest start of those that have ended is no earlier."""
    inner = F.max(F.when(F.col("k") == 1, F.col("l"))).over(upto("r"))
    return t.withColumn("m", inner).where("k = 0 and m >= l").select(*COLUMNS, *marked(t))


def inside(a: DataFrame, b: DataFrame) -> DataFrame:
    return inside_tagged(tagged(a, b))


def inside_tagged(t: DataFrame) -> DataFrame:
    """Intervals 0 that lie in an interval 1: the greatest end of those that have started is no less."""
    outer = F.max(F.when(F.col("k") == 1, F.col("r"))).over(upto("l"))
    return t.withColumn("m", outer).where("k = 0 and m >= r").select(*COLUMNS, *marked(t))


def without(t: DataFrame) -> DataFrame:
    """Intervals 0 of the documents that have no interval of another number."""
    other = F.max(F.when(F.col("k") > 0, F.lit(1))).over(Window.partitionBy(*KEY))
    return t.withColumn("m", other).where("k = 0 and m is null").select(*COLUMNS, *marked(t))


def absent(documents: DataFrame, a: DataFrame) -> DataFrame:
    """Documents without any interval of a."""
    return keyed(documents).select(*KEY).join(keyed(a), KEY, "left_anti")


def unbroken(a: DataFrame, starts: DataFrame) -> DataFrame:
    """Intervals in one sentence or paragraph, which begin at ``starts`` (doc_id, pos)."""
    return unbroken_tagged(tagged(a, points(keyed(starts))))


def unbroken_tagged(t: DataFrame) -> DataFrame:
    """Intervals 0 with none of the points 1 after their first position."""
    start = F.max(F.when(F.col("k") == 1, F.col("l"))).over(upto("r"))
    return t.withColumn("m", start).where("k = 0 and (m is null or m <= l)").select(*COLUMNS, *marked(t))
