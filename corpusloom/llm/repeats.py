"""Removal of long byte strings that occur more than once, found through one dictionary and parse of the corpus and suffix order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import U64, Rolling, Scratch, batches, mix, pack_row, slices, texts, word_spans
from corpusloom.llm.parsing import corpus_order

LENGTH, GRAM = 400, 32
POSITION_BITS = 31
#: Phrases that one task puts into suffix order together; a larger group is split by what stands around its trigger, to the next width.
GROUP = 1000
WIDTHS = (48, 8, 1)
BLOCK_CONTEXT_BYTES = 1 << 19
PIECE_BYTES = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes as they are compared where case and the kind of white space don't count.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
IN_WORD = np.array([b != 32 for b in range(256)])
#: Bytes that stand for a word where repeats are looked for by words.
CODE = 4


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    ahead = np.minimum.accumulate(full.reshape(-1, w), axis=1).ravel()
    back = np.minimum.accumulate(full.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def half_width(length: int, gram: int) -> int:
    """Places of a trigger in a string that count as its first half."""
    return (length - gram) // 2 + 1


def phrases(docs: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """The parse of texts: ``count`` neighbouring strings of ``length`` bytes that share their trigger, the gram with the
    least rolling hash, make a phrase. Phrases overlap by length - 1 bytes, so that each string lies in one phrase.

    Equal strings have their trigger at the same place (``at`` bytes after the phrase's start), wherever they occur. Strings
    of a phrase whose trigger stands in their first half share the bytes that ``right`` names, the others those of ``left``;
    0 where a phrase has no such string.
    """
    data = np.frombuffer(b"".join(docs), np.uint8)
    ends = np.cumsum([len(d) for d in docs])
    if len(data) < length:
        return {}
    rolling = Rolling(data)
    hashes = rolling.grams(gram)
    keys = (hashes >> U64(POSITION_BITS) << U64(POSITION_BITS)) | np.arange(len(hashes), dtype=U64)
    trigger = (sliding_min(keys, length - gram + 1) & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(trigger)), "right")
    real = np.arange(len(trigger)) + length <= ends[doc]
    new = np.ones(len(trigger), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1]) | ~real[:-1]
    start = np.flatnonzero(new & real)
    stops = np.flatnonzero(np.append(new | ~real, True))
    stop = stops[np.searchsorted(stops, start, "right")]
    second = Rolling(data, 1)
    spans = (start, stop - 1 + length)
    at, half = trigger[start] - start, half_width(length, gram)
    middle = trigger[start]
    right, left = np.zeros(len(start), U64), np.zeros(len(start), U64)
    some = at - (stop - 1 - start) < half
    right[some] = rolling.spans(middle[some], middle[some] + max(gram, length - half + 1)) | U64(1)
    some = at >= half
    left[some] = second.spans(middle[some] - half, middle[some] + gram) | U64(1)
    return {"doc": doc[start], "start": start - (ends - [len(d) for d in docs])[doc[start]], "count": stop - start, "at": at, "trigger": hashes[middle], "right": right, "left": left, "c1": rolling.spans(*spans), "c2": second.spans(*spans)}


def pieces(docs: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(document, offset, bytes) with each string of ``length`` bytes in one of them; long documents make several."""
    for i, d in enumerate(docs):
        for a in range(0, max(1, len(d) - length + 1), PIECE_BYTES):
            yield i, a, d[a : a + PIECE_BYTES + length - 1]


def word_codes(doc: bytes) -> bytes:
    """CODE bytes of a hash for each word, whatever its case, in parts of a text that end at white space."""
    doc, out, at = doc.translate(FOLDED), [], 0
    while at < len(doc):
        stop = len(doc) if len(doc) - at <= PIECE_BYTES else doc.find(b" ", at + PIECE_BYTES)
        part = np.frombuffer(doc[at : stop if stop >= 0 else len(doc)], np.uint8)
        out.append(Rolling(part).spans(*word_spans(part, IN_WORD)).astype("<u4").tobytes())
        at += len(part)
    return b"".join(out)


def compared(column: pa.Array, mode: str) -> list[bytes]:
    """The bytes of each text that are compared: its own, ``fold`` as many as it has with case and white space alike, ``words`` codes of its words."""
    change = {"bytes": lambda d: d, "fold": lambda d: d.translate(FOLDED), "words": word_codes}[mode]
    return [change(d) for d in texts(column)]


def _parse(length: int, gram: int, mode: str):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), *((c, pa.int64()) for c in ("start", "count", "at", "trigger", "right", "left", "c1", "c2"))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = list(pieces(compared(batch.column(2), mode), length))
            for a, b in slices([len(x[2]) for x in parts]):
                found = phrases([x[2] for x in parts[a:b]], length, gram)
                if found and len(found["doc"]):
                    of = found.pop("doc")
                    rows, offsets = (np.array([x[k] for x in parts[a:b]])[of] for k in (0, 1))
                    found["start"] = found["start"] + offsets
                    yield batches({"doc_id": batch.column(0).cast(pa.int64()).take(pa.array(rows)), "h": batch.column(1).take(pa.array(rows))} | {k: v.view(np.int64) for k, v in found.items()}, schema)

    return run, "doc_id long, h long, start long, count long, at long, trigger long, right long, left long, c1 long, c2 long"


PHRASE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("weight", pa.int64()), ("members", pa.int64()), ("context", pa.binary())])
PHRASE_KIND = "doc_id long, h long, start long, at long, key long, weight long, members long, context binary"


def _contexts(length: int, gram: int, mode: str):
    """Bytes of a document's phrases in question, as far as the strings go that have their trigger in the half in question."""
    half = half_width(length, gram)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for name, h, doc, found in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), compared(batch.column("text"), mode), batch.column("phrases").to_pylist(), strict=True):
                for r in found:
                    first, last = r["start"], r["start"] + r["count"] - 1
                    middle = first + r["at"]
                    if r["second"]:
                        last = min(last, middle - half)
                    else:
                        first = max(first, middle - half + 1)
                    rows.append((name, h, first, middle - first, r["key"], r["weight"], r["members"], doc[first : last + length]))
            for a, b in slices([len(r[-1]) for r in rows], 2 << 20):
                yield batches(dict(zip(PHRASE.names, zip(*rows[a:b], strict=True), strict=True)), PHRASE)

    return run, PHRASE_KIND


def repeated_ranges(contexts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context, the ranges of starts whose string of ``length`` bytes occurs again among all of them."""
    text, order = corpus_order(contexts, length)
    first = np.cumsum([0, *(len(c) + 16 for c in contexts)])
    of = np.searchsorted(first, order, "right") - 1
    sizes = np.array([len(c) for c in contexts])
    order = order[order - first[of] + length <= sizes[of]]
    data = (text & 0xFF).astype(np.uint8)
    a, b = (Rolling(data, k).spans(order, order + length) for k in (0, 1))
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(text) + 1, np.int8)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    out = []
    for k in range(len(contexts)):
        d = np.diff(np.concatenate(([0], twice[first[k] : first[k] + sizes[k]], [0])))
        out.append(list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True)))
    return out


def _ordered(length: int):
    """Spans that suffix order finds in groups of phrases; input sorted by key."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            out = [(r[0], r[1], r[2] + a, r[2] + b - 1 + length) for r, ranges in zip(rows, repeated_ranges([r[-1] for r in rows], length), strict=True) if r[4] == 1 for a, b in ranges]
            if out:
                yield batches(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, group, size = [], [], 0
        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "start", "key", "weight", "context")), strict=True):
                if group and group[-1][3] != row[3]:
                    if len(group) > 1:
                        whole += group
                        size += sum(len(r[-1]) for r in group)
                    group = []
                    if size > BLOCK_CONTEXT_BYTES:
                        yield from work(whole)
                        whole, size = [], 0
                group.append(row)
        yield from work(whole + (group if len(group) > 1 else []))

    return run, "doc_id long, h long, start long, stop long"


def split_phrase(at: int, size: int, length: int, gram: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """(low, start, stop, core start, core stop) for each range of ``width`` places that a trigger can have in a string.

    start and stop bound the strings of the phrase with their trigger at such a place; all strings with their trigger
    there, of any phrase, hold the core.
    """
    out = []
    least = at - (size - length)
    for low in range(least // width * width, at + 1, width):
        high = low + width - 1
        a, b = max(low, least), min(high, at)
        out.append((low, at - b, at - a + length, at - max(low, 0), at + max(gram, length - min(high, length - gram))))
    return out


def _split(length: int, gram: int, width: int):
    """Phrases cut by the place of the trigger, with the names (c1, c2) of what is left of them; key: the trigger with what is around it in all strings."""
    schema = pa.schema([*PHRASE, ("c1", pa.int64()), ("c2", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = list(zip(*(batch.column(c).to_pylist() for c in PHRASE.names), strict=True))
            for a, b in slices([len(r[-1]) for r in rows], 1 << 18):
                part = rows[a:b]
                data = np.frombuffer(b"".join(r[-1] for r in part), np.uint8)
                cuts = [(k, *c) for k, r in enumerate(part) for c in split_phrase(r[3], len(r[-1]), length, gram, width)]
                of, low, start, stop, left, right = np.array(cuts, np.int64).T
                first = np.cumsum([0, *(len(r[-1]) for r in part)])[of]
                one, two = Rolling(data), Rolling(data, 1)
                key = mix(one.spans(first + left, first + right) + mix(low.astype(U64) + U64(width << 20)))
                own = [part[k] for k in of]
                yield batches({"doc_id": [r[0] for r in own], "h": [r[1] for r in own], "start": np.array([r[2] for r in own]) + start, "at": np.array([r[3] for r in own]) - start, "key": key.view(np.int64), "weight": [r[5] for r in own], "members": [r[6] for r in own], "context": [r[7][s:e] for r, s, e in zip(own, start.tolist(), stop.tolist(), strict=True)], "c1": one.spans(first + start, first + stop).view(np.int64), "c2": two.spans(first + start, first + stop).view(np.int64)}, schema)

    return run, PHRASE_KIND + ", c1 long, c2 long"


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs."""
    start = stop = -1
    for a, b in sorted(spans):
        if a > stop:
            if stop > start:
                yield start, stop
            start, stop = a, b
        else:
            stop = max(stop, b)
    if stop > start:
        yield start, stop


def runs(doc: bytes, spans: list[tuple[int, int]], least_words: int, by_words: bool) -> Iterator[tuple[int, int]]:
    """Byte runs of a text to remove: those of ``least_words`` words; spans by words are counted in bytes of codes."""
    words = [m.span() for m in WORD.finditer(doc)] if by_words and spans else []
    for a, b in merged(spans):
        if by_words:
            first, last = -(-a // CODE), b // CODE
            if last - first >= max(1, least_words):
                yield words[first][0], words[last - 1][1]
        elif not least_words or sum(1 for _ in WORD.finditer(doc, a, b)) >= least_words:
            yield a, b


def _cut(keep_text: bool, carry: pa.DataType | None, least_words: int, by_words: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, *[("kept", pa.string())] * keep_text, *([("row", carry)] if carry else [])])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for name, doc, spans in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                kept, at, removed, n = [], 0, 0, 0
                for a, b in runs(doc, [(s["start"], s["stop"]) for s in spans or []], least_words, by_words):
                    kept.append(doc[at:a])
                    at, removed, n = b, removed + b - a, n + 1
                rest = b"".join([*kept, doc[at:]])
                row = (name, len(doc), removed, n, hashlib.sha256(rest).hexdigest())
                rows.append((*row, rest.decode("utf-8", "ignore")) if keep_text else row)
            if rows:
                yield batches(dict(zip(schema.names, [*zip(*rows, strict=True), *([batch.column("row")] if carry else [])], strict=True)), schema)

    return run


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, length: int, gram: int, group: int = GROUP, mode: str = "bytes") -> DataFrame:
    """(doc_id, h, spans) of strings that occur again; spans (start, stop) may overlap. h is the hash of the text."""
    least = 2 * (length // CODE) - 1 if mode == "words" else length
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where(F.octet_length("text") >= least)
    fn, kind = _parse(length, gram, mode)
    parse = scratch.put(rows.mapInArrow(fn, kind))
    name = ["trigger", "c1", "c2"]
    dictionary = scratch.put(parse.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "start", "count", "at", "right", "left")).alias("first")))
    mixed = dictionary.groupBy("trigger").agg(F.count("*").alias("phrases")).where("phrases > 1").select("trigger")
    halves = F.explode(F.array(*[F.struct(F.col(f"first.{k}").alias("key"), F.lit(k == "left").alias("second")) for k in ("right", "left")])).alias("half")
    sides = scratch.put(dictionary.join(mixed, "trigger").select(F.least("n", F.lit(2)).alias("weight"), "first.doc_id", "first.h", "first.start", "first.count", "first.at", halves).select("*", "half.*").drop("half").where("key <> 0"))
    shared = sides.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    apart = sides.join(shared, "key").groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "count", "at", "key", "second", "weight", "members")).alias("phrases"))
    fn, kind = _contexts(length, gram, mode)
    own = rows.join(apart.withColumnsRenamed({"doc_id": "d", "h": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))).select("doc_id", "h", "text", "phrases")
    contexts, found, same = scratch.put(own.mapInArrow(fn, kind)), [], ["key", "c1", "c2"]
    order, shape = _ordered(length)
    for width in (*WIDTHS, 0):
        some = contexts.where(F.col("members") <= group).select("doc_id", "h", "start", "key", "weight", "context")
        found.append(some.repartition("key").sortWithinPartitions("key").mapInArrow(order, shape).select("doc_id", "h", F.struct("start", "stop").alias("span")))
        large = contexts.where(F.col("members") > group)
        if not width or large.isEmpty():
            break
        fn, kind = _split(length, gram, width)
        cut = scratch.put(large.select(*PHRASE.names).mapInArrow(fn, kind))
        kinds = scratch.put(cut.groupBy(same).agg(F.sum("weight").alias("n"), F.min(F.struct("doc_id", "h", "start", "at", "context")).alias("first")))
        stop = (F.col("start") + F.octet_length("context")).alias("stop")
        found.append(cut.where("weight = 1").join(kinds.where("n > 1").select(same), same, "left_semi").select("doc_id", "h", F.struct("start", stop).alias("span")))
        sizes = kinds.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        contexts = scratch.put(kinds.join(sizes, "key").select("key", "members", F.least("n", F.lit(2)).alias("weight"), "first.*"))
    again = dictionary.where("n > 1").select(*name, F.lit(True).alias("again"))
    stop = (F.col("start") + F.col("count") - 1 + length).alias("stop")
    spans = parse.join(again, name, "left").select("doc_id", "h", F.when(F.col("again"), F.struct("start", stop)).alias("span"))
    for more in found:
        spans = spans.union(more)
    return spans.groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans"))


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, carry: bool = False, least_words: int = 0, group: int = GROUP, fold: bool = False, by_words: bool = False) -> DataFrame:
    """One row for each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining text as ``kept`` and
    the whole row of ``docs`` as a struct ``row``, if asked for).

    Removed is each byte that a string of ``length`` bytes covers which also starts anywhere else, the same document
    included; with ``least_words``, only maximal runs of such bytes that touch so many words; with ``fold``, A-Z equal a-z
    and white space of any kind is alike. With ``by_words`` repeats are runs of ``least_words`` words, whatever their length,
    case and white space: words are compared by CODE bytes of a hash each, and a string of ``length`` bytes is one of so many codes.

    The corpus is parsed into phrases at its rolling-hash triggers. The dictionary holds each distinct phrase and how
    often the parse has it: strings of a phrase that the parse has twice occur twice. What different phrases share has
    the same trigger in both, and half a string before or after it; so the dictionary's phrases are put into suffix order
    by groups that share as much. A group of more than ``group`` phrases is split by what stands around the trigger, until
    it fits a task or holds one string only; that changes where strings are compared, not the result.

    A null text counts as empty; texts shorter than ``length`` keep all. Rows that repeat a doc_id and a text are
    copies of each other, so both lose what they share. Other columns are ignored, whatever their names; an empty table
    gives no rows. The bytes of a character that is cut through are left out of ``kept``, but not of the digest.
    """
    if by_words:
        length = CODE * least_words
    scratch = Scratch(spark)
    spans = scratch.put(repeated_spans(spark, docs, scratch, length, gram, group, "words" if by_words else "fold" if fold else "bytes").where("size(spans) > 0"))
    scratch.drop_all_but(spans)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", *([pack_row(docs).alias("row")] if carry else []))
    out = rows.join(spans.withColumnsRenamed({"doc_id": "d", "h": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    kind = T.StructType([T.StructField(n, T.StringType() if "sha" in n or n == "kept" else T.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text)])
    if carry:
        kind = kind.add("row", rows.schema["row"].dataType)
    fn = _cut(keep_text, to_arrow_type(rows.schema["row"].dataType) if carry else None, least_words, by_words)
    return out.select("doc_id", "text", "spans", *["row"] * carry).mapInArrow(fn, kind)


#: Strings are told apart by a polynomial of their bytes modulo 2**61 - 1.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
m AS MATERIALIZED (SELECT greatest(max(len(x)), 1) AS m FROM d),
pw AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(1 AS HUGEINT) AS v, CAST(1000003 AS HUGEINT) AS c UNION ALL SELECT k + 1, CASE WHEN t = 0 THEN j ELSE j + (CAST(1 AS BIGINT) << k) END, CASE WHEN t = 0 THEN v ELSE v * c % 2305843009213693951 END, c * c % 2305843009213693951 FROM pw, (VALUES (0), (1)) AS z(t) WHERE k < (SELECT CAST(floor(log2(m)) + 1 AS INTEGER) FROM m)),
powers AS MATERIALIZED (SELECT j, v FROM pw WHERE k = (SELECT max(k) FROM pw)),
b AS MATERIALIZED (SELECT rid, generate_subscripts(x, 1) - 1 AS j, CAST('0x' || unnest(x) AS HUGEINT) + 1 AS b FROM d WHERE len(x) >= 400),
s AS MATERIALIZED (SELECT rid, j, sum(b * v) OVER (PARTITION BY rid ORDER BY j) AS s FROM b JOIN powers USING (j)),
w AS MATERIALIZED (SELECT rid, j, m - j AS e, lead(s, 399) OVER (PARTITION BY rid ORDER BY j) - coalesce(lag(s) OVER (PARTITION BY rid ORDER BY j), 0) AS w FROM s, m),
p AS MATERIALIZED (SELECT rid, w.j AS i, CAST(CAST(w AS HUGEINT) % 2305843009213693951 * v % 2305843009213693951 AS BIGINT) AS h FROM w JOIN powers ON powers.j = w.e WHERE w IS NOT NULL),
q AS (SELECT rid, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
k AS (SELECT rid, i, sum(CASE WHEN i <= last + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) AS last FROM q)),
r AS (SELECT rid, run, min(i) AS a, max(i) + 400 AS z FROM k GROUP BY ALL),
g AS (SELECT rid, count(*) AS n, sum(z - a) AS gone, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM r GROUP BY 1)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
 sha256(from_hex(array_to_string(CASE WHEN n IS NULL THEN x ELSE flatten(list_transform(range(1, n + 2), lambda j: x[CASE WHEN j = 1 THEN 1 ELSE z[j - 1] + 1 END : CASE WHEN j > n THEN len(x) ELSE a[j] END])) END, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""
