"""Quality rules of whole texts: counts of words, signs and repeated lines, and repeated substrings by a suffix array."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import BATCH, batches, texts

SIGNS = b"#*$%&|<>"
#: Least words; most percent of words in repeated windows of WINDOW words.
WORDS, WINDOW, REPEATED = 10, 5, 20
#: Bytes of a repeat that counts; most percent of a text's bytes in such repeats; most bytes of one repeat.
LEAST, COVERED, LONGEST = 50, 25, 1000
#: Bytes that make a sort key: nine bits each, so that the text's end sorts first.
HEAD = 7


def heads(data: np.ndarray) -> np.ndarray:
    """The first HEAD bytes of each suffix as one number; what lies behind the end is less than any byte."""
    code = np.zeros(len(data) + HEAD, np.int64)
    code[: len(data)] = data
    code[: len(data)] += 1
    key = np.zeros(len(data), np.int64)
    for j in range(HEAD):
        key = (key << 9) | code[j : j + len(data)]
    return key


def suffix_array(data: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order: prefix doubling that sorts only what is still tied."""
    n = len(data)
    order = np.argsort(key, kind="stable")
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank, size = np.zeros(n + 1, np.int64), HEAD
    rank[n] = -1
    group = at[new][np.cumsum(new) - 1]
    rank[order] = group
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    at, group = at[tied], group[tied]
    while len(at):
        own = order[at]
        by = group * (n + 1) + rank[np.minimum(own + size, n)] + 1
        move = np.argsort(by, kind="stable")
        by, own = by[move], own[move]
        order[at] = own
        new = np.ones(len(at), bool)
        new[1:] = by[1:] != by[:-1]
        group = at[new][np.cumsum(new) - 1]
        rank[own] = group
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        at, group, size = at[tied], group[tied], size * 2
    return order


def _shared(data: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, HEAD bytes at a time; the last few pairs by growing slices."""
    out, left = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(left) > 8:
        x, y = key[a[left] + out[left]], key[b[left] + out[left]]
        same = x == y
        open_, left = left[~same], left[same]
        differ = (x ^ y)[~same]
        out[open_] += sum((differ >> (9 * (HEAD - 1 - j)) == 0).astype(np.int64) for j in range(HEAD))
        out[left] += HEAD
        left = left[np.maximum(a[left], b[left]) + out[left] < len(data)]
    for i in left.tolist():
        p, q, n, width = int(a[i]), int(b[i]), int(out[i]), 64
        while True:
            stop = min(width, len(data) - max(p, q) - n)
            differ = np.flatnonzero(data[p + n : p + n + stop] != data[q + n : q + n + stop])
            n += int(differ[0]) if len(differ) else stop
            if len(differ) or stop < width:
                break
            width *= 2
        out[i] = n
    return out


def common_prefixes(data: np.ndarray, key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length shared with the suffix before it in order, by text position.

    Where both follow the same byte the length is one less than that of the position before; only other positions are
    compared, and their lengths sum to n log n at most.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(1, n)
    follows = (before[1:] > 0) & (data[i - 1] == data[before[1:] - 1])
    own = np.flatnonzero(np.concatenate(([True], ~follows)))
    out = np.zeros(n, np.int64)
    real = own[before[own] >= 0]
    out[real] = _shared(data, key, real, before[real])
    from_ = own[np.searchsorted(own, np.arange(n), "right") - 1]
    return out[from_] - (np.arange(n) - from_)


def repeats(doc: bytes, least: int = LEAST) -> tuple[list[tuple[int, int]], int]:
    """(spans, longest): merged byte spans of the repeated substrings of ``least`` bytes or more, and the longest repeat of any size.

    Of the intervals of suffixes that share a prefix, the one with the longest prefix that a suffix lies in is told by its two
    neighbours; each repeat that starts there lies in that prefix, so their spans' union is that of all maximal repeats.
    """
    data = np.frombuffer(doc, np.uint8)
    if len(data) < 2:
        return [], 0
    key = heads(data)
    order = suffix_array(data, key)
    shared = common_prefixes(data, key, order)
    reach = shared.copy()
    reach[order[:-1]] = np.maximum(reach[order[:-1]], shared[order[1:]])
    at = np.flatnonzero(reach >= least)
    if not len(at):
        return [], int(reach.max())
    end = np.maximum.accumulate(at + reach[at])
    cut = np.flatnonzero(at[1:] > end[:-1]) + 1
    return list(zip(at[np.concatenate(([0], cut))].tolist(), end[np.concatenate((cut - 1, [len(at) - 1]))].tolist(), strict=True)), int(reach.max())


def word_counts(doc: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); words stand between ASCII white space."""
    words = doc.split()
    chars = sum(map(len, words)) - (len(doc) - len(doc.translate(None, bytes(range(0x80, 0xC0)))))
    signs = len(doc) - len(doc.translate(None, SIGNS))
    lines = [x for x in doc.split(b"\n") if x.strip()]
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    times, hit, end = Counter(windows), 0, 0
    if len(times) < len(windows):
        for i, w in enumerate(windows):
            if times[w] > 1:
                hit, end = hit + i + WINDOW - max(end, i), i + WINDOW
    return len(words), chars, signs, len(lines) - len(set(lines)), hit


def _judge(least: int, covered: int, longest: int):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest")] + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] + [(n, pa.bool_()) for n in ("base_failed", "long_repeat", "kept")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for name, doc in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                counts = word_counts(doc)
                failed = counts[0] < WORDS or 100 * counts[4] > REPEATED * counts[0]
                spans, most = repeats(doc, least)
                n = sum(b - a for a, b in spans)
                rows.append((name, *counts, n, most, [{"start": a, "end": b} for a, b in spans], failed, most > longest, not failed and 100 * n <= covered * len(doc) and most <= longest))
            if rows:
                yield batches(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest long, spans array<struct<start:long,end:long>>, base_failed boolean, long_repeat boolean, kept boolean"


def judge_repetition(spark: SparkSession, docs: DataFrame, least: int = LEAST, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """One row for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest, spans,
    base_failed, long_repeat, kept.

    ``spans`` are the text's bytes in substrings of ``least`` bytes or more that occur twice or more in it, overlapping
    occurrences included; ``n_covered`` counts them, ``longest`` is the longest repeat of any size. ``kept`` are texts that pass the base
    rules, have at most ``covered`` percent of their bytes in spans and no repeat of more than ``longest`` bytes (``long_repeat``).

    A null text has no words and fails, as does an empty one. Each row is judged by itself, so rows that repeat a doc_id, ties and null
    ids need nothing. A text is sorted whole, in about 100 bytes for each of its own. Other columns are ignored; an empty table gives
    no rows.
    """
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    fn, kind = _judge(least, covered, longest)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fn, kind)


#: Repeated strings of LEAST bytes, and of more than LONGEST, told apart by a polynomial of their bytes modulo 2**61 - 1.
SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS MATERIALIZED (SELECT greatest(max(len(x)), 1) AS m FROM d),
pw AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(1 AS HUGEINT) AS v, CAST(1000003 AS HUGEINT) AS c UNION ALL SELECT k + 1, CASE WHEN t = 0 THEN j ELSE j + (CAST(1 AS BIGINT) << k) END, CASE WHEN t = 0 THEN v ELSE v * c % 2305843009213693951 END, c * c % 2305843009213693951 FROM pw, (VALUES (0), (1)) AS z(t) WHERE k < (SELECT CAST(floor(log2(m)) + 1 AS INTEGER) FROM m)),
powers AS MATERIALIZED (SELECT j, v FROM pw WHERE k = (SELECT max(k) FROM pw)),
b AS MATERIALIZED (SELECT rid, generate_subscripts(x, 1) - 1 AS j, CAST('0x' || unnest(x) AS HUGEINT) + 1 AS b FROM d WHERE len(x) > {LEAST}),
s AS MATERIALIZED (SELECT rid, j, sum(b * v) OVER (PARTITION BY rid ORDER BY j) AS s FROM b JOIN powers USING (j)),
g AS MATERIALIZED (SELECT rid, j, m - j AS e, coalesce(lag(s) OVER o, 0) AS z, lead(s, {LEAST - 1}) OVER o AS s1, lead(s, {LONGEST}) OVER o AS s2 FROM s, m WINDOW o AS (PARTITION BY rid ORDER BY j)),
p AS MATERIALIZED (SELECT rid, g.j AS i, CAST(CAST(s1 - z AS HUGEINT) % 2305843009213693951 * v % 2305843009213693951 AS BIGINT) AS h1, CAST(CAST(s2 - z AS HUGEINT) % 2305843009213693951 * v % 2305843009213693951 AS BIGINT) AS h2 FROM g JOIN powers ON powers.j = g.e WHERE s1 IS NOT NULL),
q AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS last FROM p JOIN (SELECT rid, h1 FROM p GROUP BY 1, 2 HAVING count(*) > 1) USING (rid, h1)),
cov AS (SELECT rid, sum(least(i - coalesce(last, -{LEAST}), {LEAST})) AS n FROM q GROUP BY 1),
long AS (SELECT DISTINCT rid FROM p WHERE h2 IS NOT NULL GROUP BY rid, h2 HAVING count(*) > 1),
t AS MATERIALIZED (SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM d),
f AS MATERIALIZED (SELECT rid, i, [w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g, lead(w, 4) OVER o AS z FROM t WINDOW o AS (PARTITION BY rid ORDER BY i)),
u AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS last FROM f JOIN (SELECT rid, g FROM f WHERE z IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) USING (rid, g) WHERE z IS NOT NULL),
r AS (SELECT rid, sum(least(i - coalesce(last, -5), 5)) AS n FROM u GROUP BY 1),
y AS (SELECT rid, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS y FROM d),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(y) - len(list_distinct(y)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_covered, long.rid IS NOT NULL AS long_repeat, len(x) AS n
 FROM d JOIN y USING (rid) LEFT JOIN r USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN long USING (rid)),
j AS (SELECT *, n_words < {WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, long_repeat, base_failed, NOT base_failed AND NOT long_repeat AND 100 * n_covered <= {COVERED} * n AS kept FROM j
"""
