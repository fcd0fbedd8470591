"""Token tables with one position axis, from plain texts and from vertical files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.entities import FIELDS

PARAGRAPH, SENTENCE = "§", "¶"
#: Bytes of text that a task's Python works on at once, but for a longer document.
PIECE_BYTES = 2 << 20
#: Bytes of an Arrow batch between JVM and Python, at most; one longer row makes a batch of its own.
BATCH_BYTES = 16 << 20
#: Positions that a task's Python works on at once, but for a longer document.
PIECE = 1 << 17


def plain_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token, lower) of white-space separated texts."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return docs.select("doc_id", F.posexplode(words).alias("pos", "token")).withColumn("lower", F.lower("token"))


def in_batches(df: DataFrame, fn, kind) -> DataFrame:
    """mapInArrow, with bounded batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, kind)


def pieces(it: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts or arrays in a column have at most ``limit`` bytes or items together, one row at least."""
    for batch in it:
        cells = batch.column(column)
        sizes = pc.list_value_length(cells) if pa.types.is_list(cells.type) else pc.binary_length(cells)
        ends, start = np.cumsum(pc.fill_null(sizes, 0).to_numpy().astype(np.int64)), 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(ends, limit + (ends[start - 1] if start else 0), "right")))
            yield batch.slice(start, end - start)
            start = end


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their lower case as arrays of words, which ASCII white space divides, with the number of each word's sentence; a head stays."""
    for batch in pieces(it, "text", PIECE_BYTES):
        cells = [[(t or b"").split() for t in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("text", "lower")]
        arrays = [pa.array(x, pa.list_(pa.binary())).cast(pa.list_(pa.string())) for x in cells]
        size = pc.list_value_length(arrays[0]).to_numpy().astype(np.int64)
        ends = pc.ends_with(pc.list_flatten(arrays[0]), ".").to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate(([0], np.cumsum(ends)))
        first = np.cumsum(size) - size
        numbers = before[:-1] - np.repeat(before[first], size)
        offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
        made = pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int64()))], names=["doc_id", "token", "lower", "sen_no"])
        yield with_head(made, batch)


def with_head(made: pa.RecordBatch, of: pa.RecordBatch, *names: str) -> pa.RecordBatch:
    """The head that rows came with, and intervals found in them, beside what was made of them."""
    for name in names or ("head", "found"):
        made = made.append_column(name, of.column(name)) if name in of.schema.names else made
    return made


def of_words(docs: DataFrame, then: Callable, kind: str, *more: Column | str) -> DataFrame:
    """What ``then`` makes of batches (doc_id, token, lower, sen_no, more), in the worker that cuts texts into words."""
    return in_batches(docs.select("doc_id", "text", F.lower("text").alias("lower"), *more), lambda it: then(_words(it)), kind)


def plain_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, token, lower, sen_no): the same as one row a document with arrays by position; a sentence ends at a token with a full stop."""
    rows = docs.select("doc_id", "text", F.lower("text").alias("lower"))
    return in_batches(rows, _words, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, token array<string>, lower array<string>, sen_no array<long>")


def with_sentences(tokens: DataFrame) -> DataFrame:
    """Adds sen_no: sentences end at a token with a full stop."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("sen_no", F.coalesce(F.sum(F.col("token").endswith(".").cast("int")).over(before), F.lit(0)))


def alternatives(field: str | Column) -> Column:
    """Terms at one position: a cell's parts between bars."""
    return F.filter(F.split(F.col(field) if isinstance(field, str) else field, r"\|"), lambda x: x != "")


def vertical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, value): the text of each document in order of files; gzip is read as such. What precedes the first document is dropped.

    Documents are numbered within the splits of files, of which a first pass tells the sizes; texts aren't shuffled.
    """
    chunks = spark.read.option("lineSep", "\n%%#DOC").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    chunks = chunks.withColumn("n", F.monotonically_increasing_id())
    first = F.min(F.struct("n", F.col("value").startswith("%%#DOC").alias("whole"))).alias("head")
    splits = chunks.groupBy("file", "block").agg(first, F.count("*").alias("size"))  # a row for each split of a file
    head = (F.col("block") == F.min("block").over(Window.partitionBy("file"))) & ~F.col("head.whole")
    splits = splits.select("file", "block", "head.n", "size", head.cast("long").alias("skip"))
    before = F.coalesce(F.sum(F.col("size") - F.col("skip")).over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", (F.col("n") + F.col("skip")).alias("from"), before.alias("before"))
    return chunks.join(F.broadcast(splits), ["file", "block"]).where(F.col("n") >= F.col("from")).select((F.col("n") - F.col("from") + F.col("before")).alias("doc_id"), "file", "value")


def _cells(line: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many cells each line has, and the cells of all lines, each followed by what divides it from the next; no byte is copied."""
    ends = np.frombuffer(line.buffers()[1], np.int32)[line.offset : line.offset + len(line) + 1].astype(np.int64)
    tab = np.flatnonzero(np.frombuffer(line.buffers()[2], np.uint8)[ends[0] : ends[-1]] == 9) + ends[0]
    n = np.diff(np.searchsorted(tab, ends)) + 1
    offsets = np.empty(2 * n.sum() + 1, np.int32)
    first, inner = np.cumsum(n) - n, np.ones(n.sum(), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    offsets[2 * first], offsets[2 * inner] = ends[:-1], tab + 1
    offsets[2 * (first + n) - 1], offsets[2 * inner - 1], offsets[-1] = ends[1:], tab, ends[-1]
    return n, pa.StringArray.from_buffers(2 * int(n.sum()), pa.py_buffer(offsets), line.buffers()[2])


def _vertical(it: Iterator[pa.RecordBatch], own: list[str] = FIELDS) -> Iterator[pa.RecordBatch]:
    """Vertical text as arrays of some fields and of what its marks tell."""
    for batch in pieces(it, "value", 4 * PIECE_BYTES):
        rows = pc.split_pattern(batch.column("value"), "\n")
        size = pc.list_value_length(rows).to_numpy().astype(np.int64)
        line, doc = pc.list_flatten(rows), np.repeat(np.arange(len(batch)), size)
        sentence, paragraph = (pc.starts_with(line, x).to_numpy(zero_copy_only=False) for x in ("%%#SEN", "%%#PAR"))
        mark = sentence | paragraph
        plain = pc.and_(pc.not_equal(line, ""), pc.invert(pc.starts_with(line, "%%#"))).to_numpy(zero_copy_only=False)
        kept = mark | plain
        kept[np.cumsum(size) - size] = False  # what stands beside the mark of a document
        line, doc, mark, sentence, paragraph = line.filter(pa.array(kept)), doc[kept], mark[kept], sentence[kept], paragraph[kept]
        ends = np.cumsum(np.bincount(doc, minlength=len(batch)))
        offsets = np.concatenate(([0], ends))
        numbers = []
        for m in (sentence, paragraph):
            so_far = np.concatenate(([0], np.cumsum(m)))
            numbers.append(pa.array(so_far[1:] - so_far[offsets[:-1]][doc], pa.int64()))
        n, flat = _cells(line) if len(line) else (np.zeros(0, np.int64), line)
        start, sign = np.cumsum(n) - n, pa.array(np.where(paragraph, PARAGRAPH, SENTENCE), pa.string()) if len(line) else pa.array([], pa.string())
        fields = [pc.if_else(pa.array(mark), sign, flat.take(pa.array(2 * (start + i), mask=n <= i))) for i in map(FIELDS.index, own)]
        arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (*fields, *numbers, pa.array(mark))]
        yield with_head(pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *own, "sen_no", "par_no", "is_mark"]), batch, "found")


def vertical_arrays(lines: DataFrame, mentions: Callable | None = None) -> DataFrame:
    """Documents (doc_id, value) as one row each with arrays by position: FIELDS of token rows and of sentence and paragraph marks, which take
    a position in every field, sen_no, par_no and is_mark. ``mentions`` adds arrays ``mention`` and ``entity`` to batches of such in the same worker.
    """
    kind = f"doc_id long, {', '.join(f'{f} array<string>' for f in FIELDS)}, sen_no array<long>, par_no array<long>, is_mark array<boolean>"
    made = (lambda it: mentions(_vertical(it))) if mentions else _vertical
    return in_batches(lines.select(F.col("doc_id").cast("long"), "value"), made, f"{kind}, mention array<int>, entity array<string>" if mentions else kind)


def vertical_tokens(lines: DataFrame) -> DataFrame:
    """The same as token rows (doc_id, pos, ...)."""
    columns = ["sen_no", "par_no", "is_mark", *FIELDS]
    return vertical_arrays(lines).select("doc_id", F.posexplode(F.arrays_zip(*columns)).alias("pos", "t")).select("doc_id", "pos", "t.*")


def vertical_documents(lines: DataFrame) -> DataFrame:
    """(doc_id, file, uuid, title, uri); a missing title is Unknown."""
    rows = F.split("value", "\n")
    heads = F.transform(F.filter(rows, lambda x: x.startswith("%%#PAGE")), lambda x: F.split(F.regexp_replace(x, r"^%%#PAGE\s?", ""), "\t"))
    uuid = F.trim(F.regexp_replace(rows[0], r"^(%%#DOC)?\s*", "")).alias("uuid")
    title = F.coalesce(F.array_max(F.transform(heads, lambda x: x[0])), F.lit("Unknown")).alias("title")
    return lines.select("doc_id", "file", uuid, title, F.array_max(F.transform(heads, lambda x: F.url_encode(F.get(x, F.lit(1))))).alias("uri"))


def _sentence_numbers(inner: DataFrame) -> DataFrame:
    """(doc_id, before): how many sentences the documents before each have."""
    counts = inner.groupBy(*[c for c in ("part", "doc_id") if c in inner.columns]).agg(F.max("k").alias("n")).withColumn("lot", F.floor(F.col("doc_id") / 65536))
    own = F.sum("n").over(Window.partitionBy("lot").orderBy("doc_id")) - F.col("n")
    lots = counts.groupBy("lot").agg(F.sum("n").alias("all"))
    lots = lots.select("lot", (F.sum("all").over(Window.orderBy("lot")) - F.col("all")).alias("first"))
    return counts.select("doc_id", "lot", own.alias("own")).join(lots, "lot").select("doc_id", (F.col("own") + F.col("first")).alias("before"))


def sentences_as_documents(tokens: DataFrame) -> DataFrame:
    """Each sentence as a document of its own, numbered in order; positions start anew. Tokens (part, doc_id, ...) of an index stay in its buckets."""
    key = [c for c in ("part", "doc_id") if c in tokens.columns]
    inner = tokens.where("sen_no > 0 and not is_mark").withColumn("k", F.dense_rank().over(Window.partitionBy(*key).orderBy("sen_no")))
    inner = inner.withColumn("pos", F.row_number().over(Window.partitionBy(*key, "sen_no").orderBy("pos")) - 1)
    out = inner.join(_sentence_numbers(inner), "doc_id").withColumn("doc_id", F.col("before") + F.col("k") - 1)
    return out.drop("part", "k", "before")


def sentence_title() -> Column:
    return F.concat(F.lit("Sentence #"), F.col("doc_id") + 1)


def sentence_titles(sentences: DataFrame) -> DataFrame:
    """(doc_id, title) of sentences as documents."""
    return sentences.select("doc_id", sentence_title().alias("title")).distinct()


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vertical text of each document, from its head and the rows of its tokens."""
    for batch in pieces(it, "cells", PIECE):
        size = pc.list_value_length(batch.column("cells")).to_numpy().astype(np.int64)
        line, new = pc.list_flatten(batch.column("cells")), np.zeros(size.sum(), bool)
        new[(np.cumsum(size) - size)[size > 0]] = True
        for name, mark in (("sen_no", "%%#SEN "), ("par_no", "%%#PAR ")):
            n = pc.list_flatten(batch.column(name))
            first, text = new.copy(), pc.cast(n, pa.string())
            first[1:] |= np.diff(n.to_numpy()) != 0
            marked = pc.binary_join_element_wise(pc.binary_join_element_wise(mark, text, " wx", text, ""), line, "\n")
            line = pc.if_else(pa.array(first), marked, line)
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), line), "\n")
        first_lines = batch.column("head")
        value = pc.if_else(pa.array(size > 0), pc.binary_join_element_wise(first_lines, rows, "\n"), first_lines)
        yield with_head(pa.RecordBatch.from_arrays([batch.column("doc_id"), value], names=["doc_id", "value"]), batch, "found")


def head(title: str | Column, url: str | Column, name: str = "doc_id") -> Column:
    """The first lines of a document's vertical text."""
    return F.format_string("%%%%#DOC\t%d\n%%%%#PAGE %s\t%s", name, title, url).alias("head")


def vertical_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, value): each document (doc_id, title, url, cells, sen_no, par_no) as vertical text. ``cells`` has the rows of its tokens, the
    others arrays by position of their sentences and paragraphs from 0 on.
    """
    return in_batches(documents.select("doc_id", head("title", "url"), "cells", "sen_no", "par_no"), _texts, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, value string")


def vertical_of_plain(docs: DataFrame, title: Column, url: Column, annotate: Callable) -> DataFrame:
    """The same of plain texts; ``annotate`` makes cells and par_no of batches of their words, in the worker that cuts and joins them."""
    return of_words(docs, lambda it: _texts(annotate(it)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, value string", head(title, url))


def arrays_of_plain(docs: DataFrame, annotate: Callable, fields: list[str], then: Callable, kind: str) -> DataFrame:
    """What ``then`` makes of batches of ``vertical_arrays``, of some fields, of plain texts (doc_id, text, head): one worker cuts and joins them into vertical
    text, reads this and uses it, so that arrays that ``then`` leaves out never reach Spark. Intervals ``found`` in rows come along.
    """
    return of_words(docs, lambda it: then(_vertical(_texts(annotate(it)), fields)), kind, *[c for c in ("head", "found") if c in docs.columns])


def write_vertical(texts: DataFrame, path: str) -> None:
    """Vertical files, whose names and rows are in order of doc_id if the partitions and rows of ``texts`` (doc_id, value) are."""
    texts.select("value").write.mode("overwrite").option("compression", "gzip").text(path)
