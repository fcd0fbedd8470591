"""Quartile bucket digests: hashed byte triplets are counted in buckets, each bucket is encoded by the quartile of its count."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import batches, salts

BUCKETS = 256
TABLES = (salts(768, 21) >> np.uint64(17)).astype(np.uint8).reshape(3, 256)
#: Offsets of the triplets in a window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 2, 3), (0, 1, 4))
#: Expected difference of two unrelated digests: buckets differ by 0, 1, 2, 3 in 4, 6, 4, 2 of 16 cases, and 3 counts as 6.
LIMIT = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16
BLOCK = 1 << 20
#: Rows that may become a bound, for each bound.
CHOICES = 10


def digests(docs: list[bytes]) -> np.ndarray:
    """One row of bytes for each text: its length on a logarithmic scale, the ratios of its quartiles, and two bits a bucket."""
    n = len(docs)
    sizes = np.array([len(d) for d in docs])
    blob = np.frombuffer(b"\0\0\0\0".join([*docs, b""]), np.uint8)
    of = np.repeat(np.arange(n, dtype=np.int32), sizes + 4) << 8
    real = np.arange(len(of)) < np.repeat(np.cumsum(sizes + 4) - 4, sizes + 4)
    at = np.flatnonzero(real)
    counts = np.zeros(n * BUCKETS, np.int64)
    for triplet in TRIPLETS:
        code = np.zeros(len(at), np.uint8)
        for table, k in zip(TABLES, triplet, strict=True):
            code ^= table[blob[at + k]]
        counts += np.bincount(of[at] | code, minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = sum((counts > q[:, k : k + 1]).astype(np.uint8) for k in range(3))
    body = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    length = np.round(8 * np.log2(1 + sizes)).clip(0, 255).astype(np.uint8)
    ratio = (15 * q[:, :2] // np.maximum(1, q[:, 2:])).astype(np.uint8)
    return np.concatenate((length[:, None], (ratio[:, :1] << 4 | ratio[:, 1:]).astype(np.uint8), body), axis=1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference score of digests, row by row."""
    total = np.zeros(len(a))
    for shift in (0, 2, 4, 6):
        d = np.abs((a[:, 2:] >> shift & 3).astype(np.int8) - (b[:, 2:] >> shift & 3).astype(np.int8))
        total += np.where(d == 3, 6, d).sum(1)
    total += np.minimum(np.abs(a[:, 0].astype(int) - b[:, 0]), 64) / 4
    for shift in (0, 4):
        total += np.abs((a[:, 1] >> shift & 15).astype(int) - (b[:, 1] >> shift & 15)) / 4
    return np.minimum(total, LIMIT)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for those as different as unrelated ones or more."""
    return 1 - difference(a, b) / LIMIT


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def places(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """(doc_id, hash of the text) as byte strings in their order; null ids come first."""
    known = np.stack([ids.fill_null(np.iinfo(np.int64).min).to_numpy(), hashes.to_numpy()], axis=1)
    return (known.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").reshape(-1).view("S16")


def _dealt(bounds: np.ndarray, first: np.ndarray):
    """Range of each row; the first row of a range also goes to the range before it, to end it there, and the first of all to the last."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).cast(pa.int64())
            known = places(ids, batch.column(1))
            there = np.searchsorted(bounds, known, "right")
            head, wrap = np.isin(known, bounds), np.isin(known, first)
            for rows, rid, ends in ((np.arange(len(known)), there, 0), (np.flatnonzero(head), there[head] - 1, 1), (np.flatnonzero(wrap), np.full(wrap.sum(), len(bounds)), 1)):
                if len(rows):
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(rid.astype(np.int64)), pa.array(np.full(len(rows), ends, np.int32)), ids.take(at), batch.column(1).take(at), batch.column(2).take(at)], names=["rid", "ends", "doc_id", "h", "text"])

    return run, "rid long, ends int, doc_id long, h long, text string"


def _compared():
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def work(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        after = [edited(t, f).encode() for _, t, f in rows]
        seen: list[bytes] = []
        own, following, last = [], [], None
        for _, t, f in rows:
            if last is None or t is not last:
                seen.append(t.encode())
            own.append(len(seen) - 1)
            seen.append(f.encode())
            following.append(len(seen) - 1)
            last = f
        d, e = digests(seen), digests(after)
        a, b = d[own], d[following]
        return batches({"doc_id": [r[0] for r in rows], "n_chars": [len(r[1]) for r in rows], "edited_sha256": [hashlib.sha256(x).hexdigest() for x in after], "fingerprint": [x.tobytes().hex() for x in a], "edited_fingerprint": [x.tobytes().hex() for x in e], "near_edited": likeness(a, e), "near_next": likeness(a, b)}, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ready, size = None, [], 0
        for batch in it:
            for rid, ends, name, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "ends", "doc_id", "text")), strict=True):
                text = text or ""
                if held and held[0] == rid:
                    ready.append((held[1], held[2], text))
                    size += len(held[2])
                held = None if ends else (rid, name, text)
                if size > BLOCK // 2:
                    yield work(ready)
                    ready, size = [], 0
        if ready:
            yield work(ready)

    return run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(spark: SparkSession, docs: DataFrame, per_range: int = 100_000) -> DataFrame:
    """One row for each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is found by dealing rows to ranges of (doc_id, hash of the text) of about ``per_range`` rows, whose
    bounds are rows of the table, one in so many chosen by a hash; the first of each range ends the one before. Null ids
    come first, rows that repeat a doc_id follow each other by the hash of their text, so that they may fill many ranges,
    and the last is followed by the first. A null text counts as empty. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    known = rows.agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "h")).alias("low")).first()
    parts = max(known.n // per_range, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    one_in = max(1, known.n // (CHOICES * parts))
    chosen = rows.where(F.expr(f"pmod(xxhash64(doc_id, h, 17), {one_in}) = 0")).select("doc_id", "h").distinct().collect()
    at = lambda found: places(pa.array([r.doc_id for r in found], pa.int64()), pa.array([r.h for r in found], pa.int64()))
    first = at([known.low] if known.n else [])
    bounds = np.sort(at(chosen))[:: max(1, len(chosen) // parts)]
    bounds = bounds[~np.isin(bounds, first)]
    fn, kind = _dealt(bounds, first)
    dealt = rows.mapInArrow(fn, kind).repartition(len(bounds) + 1, "rid").sortWithinPartitions("rid", "ends", F.asc_nulls_first("doc_id"), "h", "text")
    fn, kind = _compared()
    return dealt.mapInArrow(fn, kind)


_rows = ", ".join(f"unnest([{', '.join(map(str, t.tolist()))}]) AS a{i}" for i, t in enumerate(TABLES))


def _next(i: int, k: int) -> str:
    return f"lead(a{i}, {k}, {TABLES[i][0]}) OVER w" if k else f"a{i}"


def _code(triplet: tuple[int, int, int]) -> str:
    return f"xor(xor({_next(0, triplet[0])}, {_next(1, triplet[1])}), {_next(2, triplet[2])})"


def _alike(a: str, b: str) -> str:
    return f"1 - least({LIMIT}, list_sum(list_transform(list_zip({a}.codes, {b}.codes), lambda x: CASE WHEN abs(x[1] - x[2]) = 3 THEN 6 ELSE abs(x[1] - x[2]) END)) + least(abs({a}.size - {b}.size), 64) / 4 + abs({a}.low - {b}.low) / 4 + abs({a}.high - {b}.high) / 4) / {LIMIT}"


SQL = f"""
WITH bytes AS (SELECT unnest(range(256)) AS y, {_rows}),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS f FROM documents),
e AS MATERIALIZED (SELECT doc_id, t, f, length(t) AS n, substr(t, 1, length(t) - length(t) // 4) || substr(f, 1, length(t) // 4) AS e FROM d),
x AS MATERIALIZED (SELECT t, row_number() OVER () AS id, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM (SELECT t FROM e UNION SELECT e FROM e)),
v AS (SELECT id, generate_subscripts(b, 1) AS i, unnest(b) AS y FROM x),
j AS (SELECT id, i, a0, a1, a2 FROM v JOIN bytes USING (y)),
c AS (SELECT id, unnest([{', '.join(_code(t) for t in TRIPLETS)}]) AS code FROM j WINDOW w AS (PARTITION BY id ORDER BY i)),
k AS (SELECT id, code, count(*) AS n FROM c GROUP BY ALL),
h AS (SELECT x.id, list(coalesce(k.n, 0) ORDER BY y) AS n FROM x CROSS JOIN (SELECT y FROM bytes) AS z LEFT JOIN k ON k.id = x.id AND k.code = z.y GROUP BY x.id),
l AS (SELECT t, len(b) AS size, n FROM x JOIN h USING (id)),
q AS (SELECT *, list_sort(n)[{BUCKETS // 4}] AS q1, list_sort(n)[{BUCKETS // 2}] AS q2, list_sort(n)[{3 * BUCKETS // 4}] AS q3 FROM l),
o AS (SELECT t, CAST(least(255, round(8 * log2(1 + size))) AS BIGINT) AS size, 15 * q1 // greatest(1, q3) AS low, 15 * q2 // greatest(1, q3) AS high, list_transform(n, lambda c: CAST(c > q1 AS BIGINT) + CAST(c > q2 AS BIGINT) + CAST(c > q3 AS BIGINT)) AS codes FROM q),
p AS MATERIALIZED (SELECT *, array_to_string(list_transform(list_concat([size, low * 16 + high], list_transform(range(0, {BUCKETS}, 4), lambda i: codes[i + 1] + 4 * codes[i + 2] + 16 * codes[i + 3] + 64 * codes[i + 4])), lambda v: lpad(lower(to_hex(v)), 2, '0')), '') AS print FROM o)
SELECT e.doc_id, e.n AS n_chars, sha256(e.e) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint, {_alike('a', 'b')} AS near_edited, {_alike('a', 'f')} AS near_next
FROM e JOIN p a ON a.t = e.t JOIN p b ON b.t = e.e JOIN p f ON f.t = e.f
"""
