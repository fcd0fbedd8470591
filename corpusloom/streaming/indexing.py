"""An index fed by a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.operators.index import append_documents, is_index, write_index


def index_stream(docs: DataFrame, path: str, fields: list[str], make: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A stream of new documents (doc_id, ...) whose batches become segments of the index at ``path``; set its checkpoint and trigger, and start it.

    The manifest keeps the numbers of batches, so one that comes again after a failure is added once. Empty batches add nothing;
    ``merge_segments`` may be run between batches.
    """

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        if is_index(batch.sparkSession, path):
            append_documents(batch, path, make, number)
        else:
            write_index(batch, path, fields, make=make, batch=number)

    return docs.writeStream.foreachBatch(add)
