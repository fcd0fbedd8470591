"""Postings in blocks: a term's documents and positions within a range of documents, made from documents as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.tokens import PIECE, in_batches, pieces

SENTENCE, PARAGRAPH = "_SENT_", "_PAR_"
PARTS = {SENTENCE: "sen_no", PARAGRAPH: "par_no"}
KEY = ["part", "doc_id"]
BLOCK = pa.schema([("field", pa.string()), ("term", pa.string()), ("part", pa.int64()), ("docs", pa.list_(pa.int64())), ("positions", pa.list_(pa.list_(pa.int32()))), ("cf", pa.int64()), ("max_count", pa.int64()), ("sum_max_pos", pa.int64())])
STATS = ["field", "term", "df", "cf", "max_count", "sum_max_pos"]
STATS_SQL = "field string, term string, df long, cf long, max_count long, sum_max_pos long"
BLOCK_SQL = "field string, term string, part long, docs array<long>, positions array<array<int>>, cf long, max_count long, sum_max_pos long"


def documents_of(tokens: DataFrame) -> DataFrame:
    """Documents as one row each, with an array by position for every column of a token table (doc_id, pos, ...)."""
    columns = [c for c in tokens.columns if c not in ("doc_id", "pos", "part")]
    rows = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return tokens.where("doc_id is not null").groupBy("doc_id").agg(rows.alias("r")).select("doc_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def token_rows(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The reverse: (doc_id, pos, ...) of the arrays; ``part`` stays where it is known."""
    key = [c for c in KEY if c in documents.columns]
    return documents.select(*key, F.posexplode(F.arrays_zip(*columns)).alias("pos", "t")).select(*key, "pos", "t.*")


def _cells(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array, bool]:
    """Of a column of arrays: row and position of each term, the terms, and whether cells had several between bars."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat, start = pc.list_flatten(column), np.cumsum(size) - size
    row = np.repeat(np.arange(len(column)), size)
    pos = np.arange(len(flat)) - np.repeat(start, size)
    several = bool(pc.any(pc.match_substring(flat, "|")).as_py())
    if several:
        split = pc.split_pattern(flat, "|")
        n = pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
        row, pos, flat = np.repeat(row, n), np.repeat(pos, n), pc.list_flatten(split)
    real = pc.fill_null(pc.not_equal(flat, ""), False).to_numpy(zero_copy_only=False)
    return row[real], pos[real], flat.filter(pa.array(real)), several


def _starts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and position at which the numbers of a column of arrays change."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat, row = pc.list_flatten(column).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), size)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    return row[new], pos[new]


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _edges(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sorted(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms as numbers in their order, and the terms by number."""
    coded = flat.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _gather(field: str, part: np.ndarray, doc: pa.Array, row: np.ndarray, pos: np.ndarray, code: np.ndarray, terms: pa.Array, unique: bool) -> pa.RecordBatch:
    """Blocks from occurrences: sorted by term, those of one document and of one part are runs."""
    order = np.argsort(code * (len(doc) + 1) + row, kind="stable")
    row, pos, code = row[order], pos[order], code[order]
    if not unique:
        keep = _edges(code, row, pos)
        row, pos, code = row[keep], pos[keep], code[keep]
    a = _edges(code, row)
    b = _edges(code[a], part[row[a]])
    ends = np.append(a, len(row))
    count = np.diff(ends)
    first = a[b]
    block_ends = np.append(b, len(a))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([field] * len(b), pa.string()),
            terms.take(pa.array(code[first])),
            pa.array(part[row[first]], pa.int64()),
            _lists(block_ends, doc.take(pa.array(row[a]))),
            _lists(block_ends, _lists(ends, pa.array(pos, pa.int32()))),
            pa.array(np.add.reduceat(count, b), pa.int64()),
            pa.array(np.maximum.reduceat(count, b), pa.int64()),
            pa.array(np.add.reduceat(pos[ends[1:] - 1], b), pa.int64()),
        ],
        schema=BLOCK,
    )


def blocks_of(fields: list[str], marks: list[str]):
    """Blocks of batches (doc_id, part, arrays), those of each piece in order of field, term and part; one part if none is named."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it, fields[0], 4 * PIECE):
            doc = batch.column("doc_id").cast(pa.int64())
            part = batch.column("part").to_numpy() if "part" in batch.schema.names else np.zeros(len(doc), np.int64)
            for name in sorted([*fields, *marks]):
                if name in marks:
                    row, pos = _starts(batch.column(PARTS[name]))
                    code, terms, several = np.zeros(len(row), np.int64), pa.array([""]), False
                else:
                    row, pos, flat, several = _cells(batch.column(name))
                    code, terms = _sorted(flat)
                if len(row):
                    yield _gather(name, part, doc, row, pos, code, terms, not several)

    return run


def stats_of(fields: list[str]):
    """Statistics (field, term, df, cf, max_count, sum_max_pos) of each piece of batches: blocks without their arrays."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(fields, [])(it):
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("term"), pc.list_value_length(b.column("docs")).cast(pa.int64()), *[b.column(c) for c in STATS[3:]]], names=STATS)

    return run


def block_rows(documents: DataFrame, fields: list[str], marks: list[str] | None = None) -> DataFrame:
    """Blocks (field, term, part, docs, positions, cf, max_count, sum_max_pos) of documents (doc_id, part, arrays).

    Terms are the alternatives of cells; the starts of sentences and paragraphs are postings of the empty term. The rows of one part that lie
    together in a piece make one block of each term, and a piece's blocks come in order of field, term and part; nothing is shuffled or sorted.
    """
    marks = [m for m, c in PARTS.items() if c in documents.columns] if marks is None else marks
    return in_batches(documents.select("doc_id", F.col("part").cast("long"), *fields, *[PARTS[m] for m in marks]), blocks_of(fields, marks), BLOCK_SQL)


def mentions_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(it, "token", PIECE):
        size = pc.fill_null(pc.list_value_length(batch.column("token")), 0).to_numpy().astype(np.int64)
        flat = {c: pc.list_flatten(batch.column(c)) for c in ("nerid", "nertag", "nerlength")}
        tag = flat["nertag"]
        last = pc.and_(pc.greater(pc.utf8_length(flat["nerid"]), 3), pc.and_(pc.not_equal(tag, "0"), pc.not_equal(tag, "")))
        at = np.flatnonzero(pc.fill_null(last, False).to_numpy(zero_copy_only=False))
        start = np.repeat(np.cumsum(size) - size, size)
        mention = np.full(len(tag), -1, np.int64)
        for i, n in zip(at.tolist(), flat["nerlength"].take(pa.array(at)).to_pylist(), strict=True):
            words = int(n) if n is not None and n.strip().lstrip("+-").isdigit() else 1
            mention[max(int(start[i]), i - max(words, 1) + 1) : i + 1] = i
        none = mention < 0
        offsets = np.concatenate(([0], np.cumsum(size)))
        place = pa.array(mention - start, pa.int32(), mask=none)
        entity = tag.take(pa.array(np.maximum(mention, 0), mask=none)) if len(tag) else tag
        yield pa.RecordBatch.from_arrays([*batch.columns, _lists(offsets, place), _lists(offsets, entity)], names=[*batch.schema.names, "mention", "entity"])


def with_mentions(documents: DataFrame) -> DataFrame:
    """Adds arrays ``mention`` and ``entity``: position and tag of the last token of the entity that a token belongs to, the last one if several."""
    kind = T.StructType(list(documents.schema.fields)).add("mention", T.ArrayType(T.IntegerType())).add("entity", T.ArrayType(T.StringType()))
    return in_batches(documents, mentions_of, kind)
