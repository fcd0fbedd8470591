"""The stored index: blocks of postings, documents as arrays and the dictionary, in segments that are added and merged."""

from __future__ import annotations

import copy
import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.blocks import BLOCK_SQL, KEY, PARTS, STATS_SQL, block_rows, blocks_of, documents_of, stats_of, token_rows, with_mentions
from corpusloom.sources.tokens import in_batches, of_words

#: Of the files' layout; an index of another is built anew under a name of its own.
FORMAT = 7
#: Of the files: positions are written as differences, what repeats is compressed well.
FILES = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#positions.list.element.list.element": "false", "parquet.enable.dictionary#docs.list.element": "false"}
#: Of files of documents: a reader decodes 4096 rows of a row group at once, in each column that is asked for, so groups are small.
GROUPS = FILES | {"parquet.block.row.count.limit": 256, "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 4, "parquet.block.size.row.check.max": 16}
#: Documents in a bucket, about; and the least and most buckets of a table.
BUCKET_DOCUMENTS, BUCKETS = 2048, (8, 100_000)
#: A part has 2**bits consecutive numbers of documents: as many as give a small collection enough parts, and a bucket about 8.
LEAST_PARTS, MOST_BITS = 64, 9
#: One task for each bucket that is read, and none of its rows sorted that came in order.
WRITING = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "64"}
Wanted = list[tuple[str, str, bool]]
NUMBERS_SQL = "field string, kind string, value long, part long, docs array<long>, positions array<array<int>>"
Make = Callable[[DataFrame], DataFrame] | None


def _single(documents: DataFrame, field: str, made: Callable, kind: str) -> DataFrame:
    """What is made of a task's pieces of documents as arrays, or of plain texts in the worker that cuts them into words; each document is in one piece."""
    return in_batches(documents.select("doc_id", field), made, kind) if field in documents.columns else of_words(documents, made, kind)


def postings(documents: DataFrame, field: str) -> DataFrame:
    """(term, doc_id, tf, positions) of documents as arrays or of plain texts, made within each document."""
    rows = _single(documents, field, blocks_of([field], []), BLOCK_SQL).select("term", F.explode(F.arrays_zip("docs", "positions")).alias("p"))
    return rows.select("term", F.col("p.docs").alias("doc_id"), F.size("p.positions").cast("long").alias("tf"), F.col("p.positions").alias("positions"))


def stats(blocks: DataFrame, *by: str) -> DataFrame:
    """Document frequency, occurrences, greatest count in a document and sum of last positions, from blocks or from such sums."""
    df = F.sum("df") if "df" in blocks.columns else F.sum(F.size("docs"))
    return blocks.groupBy(*by).agg(df.cast("long").alias("df"), F.sum("cf").alias("cf"), F.max("max_count").alias("max_count"), F.sum("sum_max_pos").alias("sum_max_pos"))


def term_stats(documents: DataFrame, field: str) -> DataFrame:
    return stats(_single(documents, field, stats_of([field]), STATS_SQL), "term")


def index_totals(documents: DataFrame, docs: DataFrame, field: str) -> DataFrame:
    """One row: documents, terms, postings, occurrences, maxcount, maxdocsize."""
    sizes = documents.agg(F.max(F.size(field)).alias("maxdocsize"))
    return _beside(totals(term_stats(docs if "text" in docs.columns else documents, field)), sizes, docs.agg(F.count("*").alias("documents")))


def totals(stats: DataFrame, *by: str) -> DataFrame:
    return stats.groupBy(*by).agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.sum("cf").alias("occurrences"), F.max("max_count").alias("maxcount"))


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def _name(path: str, segment: int, table: str) -> str:
    """The catalog's name of a bucketed table; a table there is known by its place alone."""
    return f"corpusloom_{hashlib.md5(path.encode()).hexdigest()[:16]}_{segment}_{table}"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, f"{path}/manifest")
    if not files.exists(at):
        return []
    names = [x.getPath() for x in files.listStatus(at) if x.isDirectory()]
    return sorted(int(p.getName()) for p in names if files.exists(_files(spark, f"{p.toString()}/_SUCCESS")[1]))


def is_index(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


@contextmanager
def _set(spark: SparkSession, confs: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _put(df: DataFrame, path: str, segment: int, table: str, buckets: int, *order: str) -> None:
    """A table bucketed by part and sorted, in each task a file a bucket; without an order rows stay as they come."""
    spark, name = df.sparkSession, _name(path, segment, table)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    out = df.write.options(**(GROUPS if table == "documents" else FILES)).bucketBy(buckets, "part")
    with _set(spark, WRITING):
        (out.sortBy(*order) if order else out).option("path", f"{path}/{segment}/{table}").mode("overwrite").format("parquet").saveAsTable(name)


def _part(bits: int) -> Column:
    return F.shiftright(F.col("doc_id").cast("long"), bits)


def _dealt(rows: DataFrame, bits: int, buckets: int) -> DataFrame:
    """Rows (doc_id, ...) in their buckets, in order."""
    return rows.repartition(buckets, _part(bits)).sortWithinPartitions("doc_id")


def typed(term: Column) -> Column:
    """(kind, value) of a term that is a whole number or a day (YYYY-MM-DD, its number since 1970), else null."""
    number = F.when(term.rlike(r"^[+-]?\d{1,18}$"), term.try_cast("long"))
    day = F.when(term.rlike(r"^\d{4}-\d\d-\d\d$"), F.unix_date(term.try_cast("date")).cast("long"))
    return F.when(number.isNotNull(), F.struct(F.lit("number").alias("kind"), number.alias("value"))).when(day.isNotNull(), F.struct(F.lit("day").alias("kind"), day.alias("value")))


def bound(text: str) -> tuple[str, int] | None:
    """The same of a bound of a range."""
    if re.fullmatch(r"[+-]?\d{1,18}", text):
        return "number", int(text)
    try:
        return "day", (date.fromisoformat(text) - date(1970, 1, 1)).days
    except ValueError:
        return None


def _write_rest(spark: SparkSession, path: str, segment: int, blocks: DataFrame, told: dict) -> dict:
    """Blocks, which come in sorted runs, those of numbers and days by value, the dictionary and a segment's row of the manifest, once its documents are written."""
    _put(blocks, path, segment, "postings", told["buckets"])
    values = spark.table(_name(path, segment, "postings")).where("term between '+' and ':'").select("field", typed(F.col("term")).alias("t"), "part", "docs", "positions").where("t is not null")
    _put(values.select("field", "t.kind", "t.value", "part", "docs", "positions"), path, segment, "numbers", told["buckets"], "field", "kind", "value", "part")
    terms = stats(spark.read.parquet(f"{path}/{segment}/postings").where(~F.col("field").isin(*PARTS)), "field", "term")
    terms.sortWithinPartitions("field", "term").write.options(**FILES).mode("overwrite").parquet(f"{path}/{segment}/terms")
    about = spark.read.parquet(f"{path}/{segment}/documents").agg(F.count("*").alias("documents"), F.max("size").alias("maxdocsize"), F.min("part").alias("low"), F.max("part").alias("high")).first()
    return told | {"segment": segment, **about.asDict()}


def _write_manifest(spark: SparkSession, path: str, segments: list[dict]) -> None:
    """The next version of the manifest, a row for each segment; readers take the last whole one."""
    names = ("segment", "documents", "maxdocsize", "low", "high", "buckets", "bits", "fields", "columns", "batches")
    kind = "segment int, documents long, maxdocsize int, low long, high long, buckets int, bits int, fields string, columns string, batches array<long>"
    rows = spark.createDataFrame([tuple(s[n] for n in names) for s in segments], kind)
    rows.coalesce(1).write.parquet(f"{path}/manifest/{max(_versions(spark, path), default=0) + 1}")


def documents_with_words(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null").where(F.size(next(c for c in documents.columns if c != "doc_id")) > 0)


def _as_documents(rows: DataFrame) -> DataFrame:
    """Documents as arrays, with entity mentions where tokens have them; empty ones and those without an id are left out."""
    documents = documents_with_words(documents_of(rows) if "pos" in rows.columns else rows)
    return with_mentions(documents) if {"nerid", "nertag", "nerlength"} <= set(documents.columns) and "mention" not in documents.columns else documents


def _write_segment(rows: DataFrame, path: str, segment: int, fields: list[str], bits: int, buckets: int, make: Make, batch: int | None = None, ordered: bool = False) -> dict:
    """Texts are shuffled into their buckets as they are, if they don't come in order, and made into arrays there; blocks are made bucket by bucket, no array is shuffled."""
    spark = rows.sparkSession
    named = rows.where("doc_id is not null")
    documents = _as_documents(make(named if ordered else _dealt(named, bits, buckets))) if make else _dealt(_as_documents(rows), bits, buckets)
    columns = [c for c in documents.columns if c not in ("doc_id", "mention", "entity")]
    _put(documents.withColumns({"part": _part(bits), "size": F.size(columns[0])}), path, segment, "documents", buckets)
    stored = spark.table(_name(path, segment, "documents")).select("doc_id", "part", *fields, *[c for c in PARTS.values() if c in columns])
    blocks = block_rows(stored, fields)
    return _write_rest(spark, path, segment, blocks, {"buckets": buckets, "bits": bits, "fields": ",".join(fields), "columns": ",".join(columns), "batches": [] if batch is None else [batch]})


def write_index(rows: DataFrame, path: str, fields: list[str], documents: int | None = None, make: Make = None, batch: int | None = None, ordered: bool = False) -> None:
    """An index as Parquet tables under ``path``, of token rows (doc_id, pos, ...), documents as arrays (doc_id, ...), or rows
    (doc_id, ...) of which ``make`` makes such documents row by row.

    A segment has ``documents``, one row each with an array by position for every column, bucketed by part and in order of doc_id;
    ``postings``, a block for each field, term and part (a range of documents), bucketed by part, in runs in order of field, term
    and part, as a worker's pieces give them, so that a search reads the pages of its terms and needs no shuffle; ``numbers``, the blocks of terms that are whole
    numbers or days, sorted by value for ranges; ``terms``, the dictionary with its
    statistics, each file sorted; and a row of the manifest, which is written last. Positions are dense from 0 on; doc_id names one document.
    ``documents`` is their number, if known. Rows that are ``ordered`` lie in long runs of doc_id in their partitions: each task has few parts, and
    writes them to their buckets without a shuffle.
    """
    n = rows.select("doc_id").distinct().count() if documents is None else documents
    bits = min(MOST_BITS, max(0, (n // LEAST_PARTS).bit_length() - 1))
    buckets = min(BUCKETS[1], max(BUCKETS[0], n // BUCKET_DOCUMENTS))
    _write_manifest(rows.sparkSession, path, [_write_segment(rows, path, 1, fields, bits, buckets, make, batch, ordered)])


def append_documents(rows: DataFrame, path: str, make: Make = None, batch: int | None = None) -> None:
    """Adds documents that the index doesn't have yet as a segment of its own; what is there is neither read nor written.

    A numbered batch that is there already is left out, so that one may be sent again.
    """
    spark = rows.sparkSession
    there = [r.asDict() for r in _manifest(spark, path)]
    if any(batch in s["batches"] for s in there):
        return
    fields, bits = there[0]["fields"].split(","), there[0]["bits"]
    new = _write_segment(rows, path, max(s["segment"] for s in there) + 1, fields, bits, there[0]["buckets"], make, batch)
    _write_manifest(spark, path, [*there, new])


def merge_segments(spark: SparkSession, path: str) -> None:
    """One segment of all: documents are copied, blocks of one term and part are joined; no text is read again.

    The segments merged stay for those who have them open.
    """
    index, there = StoredIndex(spark, path), [r.asDict() for r in _manifest(spark, path)]
    if len(there) < 2:
        return
    segment, told = max(s["segment"] for s in there) + 1, {k: there[0][k] for k in ("bits", "fields", "columns")}
    told["batches"] = [b for s in there for b in s["batches"]]
    told["buckets"] = min(BUCKETS[1], max(BUCKETS[0], sum(s["documents"] for s in there) // BUCKET_DOCUMENTS))
    columns = [c for c in index.tables[0]["documents"].columns]
    documents = reduce(DataFrame.unionByName, [t["documents"].select(columns) for t in index.tables])
    _put(_dealt(documents, told["bits"], told["buckets"]), path, segment, "documents", told["buckets"])
    blocks = reduce(DataFrame.unionByName, [t["postings"] for t in index.tables]).repartition(told["buckets"], "part")
    met = blocks.groupBy("part", "field", "term").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("docs", "positions")))).alias("p"), F.sum("cf").alias("cf"), F.max("max_count").alias("max_count"), F.sum("sum_max_pos").alias("sum_max_pos"))
    blocks = met.select("field", "term", "part", F.col("p.docs").alias("docs"), F.col("p.positions").alias("positions"), "cf", "max_count", "sum_max_pos").sortWithinPartitions("field", "term", "part")
    _write_manifest(spark, path, [_write_rest(spark, path, segment, blocks, told)])


def _manifest(spark: SparkSession, path: str) -> list:
    last = max(_versions(spark, path), default=None)
    if last is None:
        raise ValueError(f"no index in {path}")
    return spark.read.parquet(f"{path}/manifest/{last}").orderBy("segment").collect()


def _bucketed(spark: SparkSession, path: str, segment: int, table: str, buckets: int, order: str = "") -> DataFrame:
    """A table that another session has written, made known to the catalog."""
    name = _name(path, segment, table)
    if not spark.catalog.tableExists(name):
        kind = spark.read.parquet(f"{path}/{segment}/{table}").schema if table == "documents" else None
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) if kind else NUMBERS_SQL if table == "numbers" else BLOCK_SQL
        sorted_by = f"SORTED BY ({order}) " if order else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (part) {sorted_by}INTO {buckets} BUCKETS LOCATION '{path}/{segment}/{table}'")
    return spark.table(name)


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEY).agg(F.collect_list(F.struct(*[c for c in found.columns if c not in KEY])).alias("found"))


def between(value: Column, low: int | None, high: int | None) -> Column:
    tests = [*([value >= low] if low is not None else []), *([value <= high] if high is not None else [])]
    return reduce(Column.__and__, tests, value.isNotNull())


class StoredIndex:
    """What ``write_index`` and ``append_documents`` have written. Raises an error if documents are missing from it.

    ``among``, ``between`` and ``where`` give views of the same index that read some parts or documents alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, told = spark, _manifest(spark, path)
        self.tables = [{"documents": _bucketed(spark, path, s.segment, "documents", s.buckets), "postings": _bucketed(spark, path, s.segment, "postings", s.buckets), "numbers": _bucketed(spark, path, s.segment, "numbers", s.buckets, "field, kind, value, part")} for s in told]
        self.size, self.bits, self.buckets = sum(s.documents for s in told), told[0].bits, told[0].buckets
        self.low, self.high = min(s.low for s in told), max(s.high for s in told)
        self.names, self.columns = told[0].fields.split(","), told[0].columns.split(",")
        self.only_parts, self.only_docs, self._df = [], [], {}
        if sum(t["documents"].count() for t in self.tables) != self.size:
            raise ValueError(f"the index in {path} hasn't the {self.size} documents of its manifest")
        terms = [spark.read.parquet(f"{path}/{s.segment}/terms") for s in told]
        self.terms = terms[0] if len(terms) == 1 else stats(reduce(DataFrame.unionByName, terms), "field", "term")
        self.fields = totals(self.terms, "field").withColumns({"documents": F.lit(self.size).cast("long"), "maxdocsize": F.lit(max(s.maxdocsize for s in told))})

    def _view(self, part, doc: Column | None = None) -> StoredIndex:
        out = copy.copy(self)
        out.only_parts, out.only_docs = [*self.only_parts, part], [*self.only_docs, *([] if doc is None else [doc])]
        return out

    def among(self, parts: list[int] | DataFrame) -> StoredIndex:
        """The parts of a list, of which other buckets and pages aren't read, or of a table (part), by a semi join."""
        return self._view(parts if isinstance(parts, DataFrame) else F.col("part").isin(*parts))

    def between(self, first: int, last: int) -> StoredIndex:
        """The documents from one to another."""
        return self._view(F.col("part").between(first >> self.bits, last >> self.bits), F.col("doc_id").between(first, last))

    def where(self, doc: Column) -> StoredIndex:
        """The documents that meet a condition on doc_id."""
        return self._view(F.lit(True), doc)

    def _limited(self, df: DataFrame, docs: bool) -> DataFrame:
        for p in self.only_parts:
            df = df.join(p, "part", "left_semi") if isinstance(p, DataFrame) else df.where(p)
        return reduce(DataFrame.where, self.only_docs, df) if docs else df

    def blocks(self, test: Column) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._limited(t["postings"].where(test), False) for t in self.tables])

    def hits(self, wanted: Wanted) -> DataFrame:
        """(part, doc_id, pos, k) for each k-th wanted (field, word, by prefix): one scan, of their fields and ranges of terms alone.

        A place is told twice if two of its alternatives are wanted by one prefix.
        """
        tests = [(F.col("field") == f) & (F.col("term").startswith(w) if prefix else F.col("term") == w) for f, w, prefix in wanted]
        words = reduce(Column.__or__, [F.col("term").startswith(w) if prefix else F.col("term") == w for _, w, prefix in wanted])
        rows = self.blocks(F.col("field").isin(*{f for f, _, _ in wanted}) & words & reduce(Column.__or__, tests))
        which = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)]), lambda k: k.isNotNull())
        rows = rows.select("part", "docs", "positions", F.explode(which).alias("k")).select("part", F.explode(F.arrays_zip("docs", "positions")).alias("p"), "k")
        rows = rows.select("part", F.col("p.docs").alias("doc_id"), F.col("p.positions").alias("positions"), "k")
        return reduce(DataFrame.where, self.only_docs, rows).select(*KEY, F.explode("positions").alias("pos"), "k")

    def range_hits(self, field: str, kind: str, low: int | None, high: int | None) -> DataFrame:
        """(part, doc_id, pos) of numbers or days from ``low`` to ``high`` in a field; row groups of other values are skipped."""
        test = (F.col("field") == field) & (F.col("kind") == kind) & between(F.col("value"), low, high)
        rows = reduce(DataFrame.unionByName, [self._limited(t["numbers"].where(test), False) for t in self.tables])
        rows = rows.select("part", F.explode(F.arrays_zip("docs", "positions")).alias("p")).select("part", F.col("p.docs").alias("doc_id"), F.col("p.positions").alias("positions"))
        return reduce(DataFrame.where, self.only_docs, rows).select(*KEY, F.explode("positions").alias("pos")).distinct()

    def any_hits(self, wanted: Wanted) -> DataFrame:
        """(part, doc_id, pos) of any of the wanted."""
        out = self.hits(wanted).select(*KEY, "pos")
        return out if len(wanted) == 1 and not wanted[0][2] else out.distinct()

    def frequency(self, wanted: Wanted) -> list[int]:
        """How many documents each of the wanted is in, from the dictionary, which is asked once for each; a prefix sums its terms."""
        new = [w for w in dict.fromkeys(wanted) if w not in self._df]
        if new:
            tests = [(F.col("field") == f) & (F.col("term").startswith(w) if prefix else F.col("term") == w) for f, w, prefix in new]
            sums = self.terms.where(reduce(Column.__or__, tests)).agg(*[F.sum(F.when(t, F.col("df"))) for t in tests]).first()
            self._df.update({w: n or 0 for w, n in zip(new, sums, strict=True)})
        return [self._df[w] for w in wanted]

    @property
    def documents(self) -> DataFrame:
        return self.forward([])

    def forward(self, columns: list[str]) -> DataFrame:
        """(part, doc_id, ...): documents with arrays of some columns."""
        return reduce(DataFrame.unionByName, [self._limited(t["documents"], True).select(*KEY, *columns) for t in self.tables])

    def beside(self, found: DataFrame, columns: list[str]) -> DataFrame:
        """(part, doc_id, found, ...): documents with arrays of some columns and their intervals (doc_id, ...) as an array of structs, so that no
        array is repeated for each interval. Intervals are dealt to the documents' buckets and hashed there; arrays are neither shuffled nor sorted.
        """
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # buckets of parts will do for documents
        rows = _by_document(found.withColumn("part", _part(self.bits)).repartition(self.buckets, "part")).hint("shuffle_hash")
        return rows.join(self.forward(columns), KEY)

    def tokens_with(self, columns: list[str]) -> DataFrame:
        """(part, doc_id, pos, ...) of some columns; the rows of a part lie in one partition."""
        return token_rows(self.forward(columns), columns)

    @property
    def tokens(self) -> DataFrame:
        return self.tokens_with(self.columns).drop("part")

    def tokens_of(self, docs: list[int]) -> DataFrame:
        """Tokens of some documents; other buckets and row groups are skipped."""
        return self._view(F.col("part").isin(*{d >> self.bits for d in docs}), F.col("doc_id").isin(*docs)).tokens


_open: dict[tuple[str, str, int], StoredIndex] = {}


def opened(spark: SparkSession, path: str) -> StoredIndex:
    """The last version of the index at a path, opened and checked once an application."""
    key = (spark.sparkContext.applicationId, path, max(_versions(spark, path), default=0))
    if key not in _open:
        _open[key] = StoredIndex(spark, path)
    return _open[key]


class TokenTable:
    """The same over a token table that isn't indexed; ``multi`` says that cells hold alternatives between bars."""

    def __init__(self, tokens: DataFrame, multi: bool = False):
        self.tokens, self.multi, self.names = tokens, multi, tokens.columns
        self.columns = [c for c in tokens.columns if c not in ("doc_id", "pos")]
        self.documents = tokens.select(F.lit(0).alias("part"), "doc_id").distinct()

    def _condition(self, name: str, word: str, prefix: bool) -> Column:
        if name in PARTS:
            return F.lit(False)
        if self.multi:
            cell = F.split(F.col(name), r"\|")
            return F.exists(cell, lambda x: x.startswith(word)) if prefix else F.array_contains(cell, word)
        return F.col(name).startswith(word) if prefix else F.col(name) == word

    def hits(self, wanted: Wanted) -> DataFrame:
        tests = [self._condition(*w) for w in wanted]
        which = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)]), lambda k: k.isNotNull())
        out = self.tokens.where(reduce(Column.__or__, tests)).select(F.lit(0).alias("part"), "doc_id", "pos", F.explode(which).alias("k"))
        for k, (name, _, _) in enumerate(wanted):
            if name in PARTS:
                starts = self.tokens.groupBy("doc_id", PARTS[name]).agg(F.min("pos").alias("pos"))
                out = out.union(starts.select(F.lit(0).alias("part"), "doc_id", "pos", F.lit(k)))
        return out

    def any_hits(self, wanted: Wanted) -> DataFrame:
        return self.hits(wanted).select(*KEY, "pos").distinct()

    def range_hits(self, field: str, kind: str, low: int | None, high: int | None) -> DataFrame:
        terms = F.split(F.col(field), r"\|") if self.multi else F.array(field)
        rows = self.tokens.select(F.lit(0).alias("part"), "doc_id", "pos", F.explode(terms).alias("term")).withColumn("t", typed(F.col("term")))
        return rows.where((F.col("t.kind") == kind) & between(F.col("t.value"), low, high)).select(*KEY, "pos").distinct()

    def forward(self, columns: list[str]) -> DataFrame:
        own = [c for c in columns if c not in ("mention", "entity")]
        needed = list(dict.fromkeys([*own, *(["token", "nerid", "nertag", "nerlength"] if len(own) < len(columns) else [])]))
        documents = documents_of(self.tokens.select("doc_id", "pos", *needed))
        return (with_mentions(documents) if len(own) < len(columns) else documents).select(F.lit(0).alias("part"), "doc_id", *columns)

    def beside(self, found: DataFrame, columns: list[str]) -> DataFrame:
        return _by_document(found.withColumn("part", F.lit(0))).join(self.forward(columns).drop("part"), "doc_id")

    def tokens_of(self, docs: list[int]) -> DataFrame:
        return self.tokens.where(F.col("doc_id").isin(*docs))
