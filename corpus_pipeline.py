"""Documents for training, stage by stage: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``, with the text they leave.
Rows with a null doc_id are judged by their text like all others; null and empty texts fail the quality stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, small_side, table
from corpusloom.llm.decontamination import find_contamination
from corpusloom.llm.near_dup import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import accepted
from corpusloom.llm.repeats import remove_repeats

#: A passage that repeats goes if it has so many words.
PASSAGE_WORDS = 50


def _rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` with (left_semi) or without (left_anti) a key (doc_id, text_hash)."""
    d, k = docs.alias("d"), small_side(keys).alias("k")
    return d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.text_hash")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; of rows that repeat doc_id and text, one as well."""
    scratch = Scratch(spark)
    found = scratch.put(near_duplicates(spark, docs).select("doc_id", "text_hash", "kept"))
    kept = _rows(docs, found.where("not kept").select("doc_id", "text_hash").distinct(), "left_anti")
    again = scratch.put(found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"))
    if again.isEmpty():
        return kept
    return _rows(kept, again, "left_anti").union(_rows(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE_WORDS words or more that occur again, in whatever case and lines; a document of which nothing is left goes."""
    left = remove_repeats(spark, docs, keep_text=True, carry=True, least_words=PASSAGE_WORDS, by_words=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.where("n_removed = 0 or trim(kept) <> ''").select(*[F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_contamination(spark, docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.where("not contaminated").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in windows."""
    return pack(spark, docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_dedup), ("decontamination", decontaminate), ("packing", packing)]
#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
