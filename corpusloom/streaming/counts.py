"""Term counts of a stream of documents; the state is one count for each term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tokens import plain_tokens


def stream_term_counts(docs: DataFrame) -> DataFrame:
    """(lower, cf) of all documents so far, for output mode complete or update."""
    return plain_tokens(docs).groupBy("lower").agg(F.count("*").alias("cf"))
