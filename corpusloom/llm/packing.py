"""Packing of token sequences into windows by best-fit decreasing over a histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, batches, slices, texts
from corpusloom.llm.pretokens import Encoder

_encoders: dict[str, Encoder] = {}
WINDOW, END_ID = 2048, 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class OpenWindows:
    """Open windows by remaining capacity: runs of windows that are filled alike, under a segment tree of capacities in use."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs.setdefault(room, []).append((first, count))
            self._move(room, count)

    def _move(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i //= 2

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` that an open window has, or 0."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return 0

    def take(self, room: int, most: int) -> tuple[int, int]:
        first, count = self.runs[room].pop()
        n = min(count, most)
        if n < count:
            self.runs[room].append((first + n, count - n))
        self._move(room, -n)
        return first, n


def best_fit_decreasing(histogram: dict[int, int], window: int, first_id: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(length, rank, count, sequence_id, offset): pieces rank..rank+count-1 of a length go, one each, to as many sequences from sequence_id on.

    A piece goes to the tightest window; that stays the tightest for pieces of its length until it is full, so windows of
    one capacity are filled one after the other. The pieces of one length are alike, so the plan's size depends on the
    window alone.
    """
    open_, plan, next_id = OpenWindows(window), [], first_id
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = open_.tightest(length)
            each = (room or window) // length
            if room:
                first, n = open_.take(room, max(1, left // each))
            else:
                room, first, n = window, next_id, max(1, left // each)
                next_id += n
            own = min(each, left)
            for k in range(own):
                plan.append((length, rank + k * n, n, first, window - room + k * length))
            open_.add(room - own * length, first, n)
            rank, left = rank + own * n, left - own * n
    return plan


def _pieces(path: str, window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("lot", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        for batch in it:
            names, docs = batch.column(0).cast(pa.int64()).to_pylist(), texts(batch.column(1))
            for a, b in slices([len(x) for x in docs], 1 << 20):
                rows = []
                for name, ids in zip(names[a:b], _encoders[path].encode(docs[a:b]), strict=True):
                    raw = np.append(ids, END_ID).astype("<u4")
                    for at in range(0, len(raw), window):
                        crc = zlib.crc32(piece := raw[at : at + window].tobytes())
                        rows.append((name, at, len(piece) // 4, crc, len(raw), crc * 2654435761 % (1 << 32)))
                yield batches(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lot long"


def _placed(plan: dict[str, np.ndarray], window: int):
    """Each piece's sequence and offset from its rank among those of its length."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(plan["key"], (length << 48) + rank, "right") - 1
            same = {n: batch.column(n) for n in schema.names[:5]}
            yield batches(same | {"sequence_id": plan["seq"][at] + rank - plan["rank"][at], "offset": plan["offset"][at]}, schema)

    return run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(spark: SparkSession, docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids and an end id are cut into full windows and a rest. Pieces of one length are interchangeable, so
    best-fit decreasing needs their histogram alone (at most ``window`` rows come to the driver); each piece finds its
    place by its rank among the pieces of its length, which is counted by lots, so that no task holds a whole length.

    A null or empty text is one piece of the end id. Rows that repeat a doc_id are packed each by itself, null ids too.
    Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark)
    fn, kind = _pieces(vocabulary or default_vocabulary(), window)
    pieces = scratch.put(docs.select("doc_id", "text").mapInArrow(fn, kind))
    lots = max(1, pieces.count() // 20_000)
    hot = F.expr(f"pmod(xxhash64(doc_id, start, lot), {lots})")
    pieces = pieces.withColumn("lot", hot)
    by_lot = pieces.groupBy("length", "lot").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_lot.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(best_fit_decreasing(histogram, window))
    table = {"key": np.array([(p[0] << 48) + p[1] for p in plan], np.int64), "rank": np.array([p[1] for p in plan], np.int64), "seq": np.array([p[3] for p in plan], np.int64), "offset": np.array([p[4] for p in plan], np.int64)}
    from pyspark.sql import Window as W

    before = by_lot.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("lot").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("length", "lot", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(W.partitionBy("length", "lot").orderBy("doc_id", "start", "ids_crc32")).cast("long") - 1)
    ranked = ranked.join(before, ["length", "lot"]).withColumn("rank", F.col("rank") + F.col("before"))
    fn, kind = _placed(table, window)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(fn, kind)
