"""Near-duplicate documents: SetSketch registers, banded, estimated by likelihood, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import U64, Rolling, Scratch, batches, mix, salts, slices, small_side, texts, word_spans
from corpusloom.llm.components import connected

SPACES = b" \t\n\x0b\x0c\r"
IN_WORD = np.array([b not in SPACES for b in range(256)])


@dataclass(frozen=True)
class Params:
    """With 32 bands of 4 registers a pair at similarity 0.75 meets in no band once in 190,000 times.

    prune: pairs whose estimate is this far under the threshold (5 standard errors of 128 registers) aren't confirmed.
    block_bytes: sketches and sets of about so many bytes are compared at a time with as many others.
    """

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    prune: float = 0.2
    block_bytes: int = 1 << 20


def shingle_sets(docs: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's shingles."""
    blob = np.frombuffer(b" ".join(docs).lower() + b" ", np.uint8)
    starts, ends = word_spans(blob, IN_WORD)
    w = Rolling(blob).spans(starts, ends)
    first = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in docs)]))
    c = salts(words + 1, 5)
    full = np.zeros(max(0, len(w) - words + 1), U64)
    for k in range(words):
        full += w[k : len(w) - words + 1 + k] * c[k] if len(full) else full
    full = mix(full)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            out.append(mix((w[a:b] * c[: b - a]).sum(keepdims=True) + c[words : words + 1] * U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def registers(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """SetSketch registers: the least of a set's exponential values for each register, on a logarithmic scale, cut to 16 bits."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), p.bands * p.rows), np.uint16)
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        least = np.stack([np.minimum.reduceat(flat * a, at) for a in salts(p.bands * p.rows, 77)], axis=1)
        value = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / p.rate
        out[full] = np.clip(np.floor(1 - np.log(value) / np.log(p.base)), 0, 65535).astype(np.uint16)
    return out


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity at which the counts of larger, smaller and equal registers are most likely, given both set sizes (base near 1)."""
    m = a.shape[1]
    up, down = (a > b).sum(1, dtype=np.float64), (a < b).sum(1, dtype=np.float64)
    same = m - up - down
    u, v = na / (na + nb), nb / (na + nb)
    s, t = u * u * (same + down), v * v * (same + up)
    return (s + t - np.sqrt((s - t) ** 2 + 4 * up * down * u * u * v * v)) / (2 * m * u * v)


def _sketches(p: Params):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, docs = batch.column(0), texts(batch.column(1))
            for a, b in slices([len(x) for x in docs]):
                sets = shingle_sets(docs[a:b], p.words)
                regs = registers(sets, p)
                digest = [np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), len(s)], U64).tobytes() for s in sets]
                yield batches({"doc_id": ids.slice(a, b - a).cast(pa.int64()), "text_hash": batch.column(2).slice(a, b - a), "n_shingles": [len(s) for s in sets], "digest": digest, "sketch": [r.tobytes() for r in regs]}, schema)

    return run, "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary"


def _bands(p: Params):
    schema = pa.schema([("key", pa.int64()), ("band", pa.int64()), ("rid", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, p.bands, p.rows)
            key = (regs.astype(U64) * salts(p.rows, 3)).sum(2, dtype=U64) if p.rows != 4 else regs.copy().view(U64)[:, :, 0]
            key = mix(key + salts(p.bands, 9))
            yield batches({"key": key.view(np.int64).ravel(), "band": np.tile(np.arange(p.bands), len(regs)), "rid": np.repeat(batch.column(0).to_numpy(), p.bands), "n": np.repeat(batch.column(1).to_numpy(), p.bands)}, schema)

    return run, "key long, band long, rid long, n long"


def _pruned(p: Params):
    """(u, v) of the pairs whose sizes and registers let them reach the threshold."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            u, v, na, nb, a, b = batch.columns
            m = p.bands * p.rows
            keep = _may_link(np.frombuffer(b"".join(a.to_pylist()), np.uint16).reshape(-1, m), np.frombuffer(b"".join(b.to_pylist()), np.uint16).reshape(-1, m), na.to_numpy(), nb.to_numpy(), p)
            yield batches({"u": u.to_numpy()[keep], "v": v.to_numpy()[keep]}, schema)

    return run, "u long, v long"


def _may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, p: Params) -> np.ndarray:
    sizes = 100 * np.minimum(na, nb) >= p.percent * np.maximum(na, nb)
    return sizes & (likely_similarity(a, b, na, nb) >= p.percent / 100 - p.prune)


def _block_links(p: Params):
    """A spanning forest of the links between different components within each pair of blocks; input sorted by key, bi, bj.

    A pair is looked at only in the first band in which it meets, and only if nothing found here joins it already.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    m = p.bands * p.rows

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rid, comp, n, band, mine, bi, bj = (t.column(c).to_numpy() for c in ("rid", "comp", "n", "band", "mine", "bi", "bj"))
        comp = comp.copy()
        regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, m)
        keys = regs.reshape(-1, p.bands, p.rows)
        sets = [np.frombuffer(x, U64) for x in t.column("members").to_pylist()]
        right = np.flatnonzero(mine == bj[0])
        for i in np.flatnonzero(mine == bi[0]):
            r = right[(comp[right] != comp[i]) & ((bi[0] != bj[0]) | (rid[right] > rid[i]))]
            r = r[~(keys[r, : band[0]] == keys[i, : band[0]]).all(2).any(1)]
            if len(r):
                r = r[_may_link(np.broadcast_to(regs[i], (len(r), m)), regs[r], np.full(len(r), n[i]), n[r], p)]
            if not len(r):
                continue
            flat = np.concatenate([sets[j] for j in r])
            near = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][near] == flat).astype(np.int64), np.cumsum([0, *(len(sets[j]) for j in r[:-1])]))
            r = r[100 * both >= p.percent * (n[i] + n[r] - both)]
            _, once = np.unique(comp[r], return_index=True)
            r = r[once]
            if len(r):
                yield batches({"u": np.minimum(rid[i], rid[r]), "v": np.maximum(rid[i], rid[r])}, schema)
                comp[np.isin(comp, comp[r])] = comp[i]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in it:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            k = np.stack([t.column(c).to_numpy() for c in ("key", "bi", "bj")])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from compare(t.slice(a, b - a))
            rest = t.slice(cuts[-1]) if t.num_rows else None
        if rest is not None and rest.num_rows:
            yield from compare(rest)

    return run, "u long, v long"


def _sets(p: Params):
    schema = pa.schema([("rid", pa.int64()), ("members", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, docs = batch.column(0), texts(batch.column(1))
            for a, b in slices([len(x) for x in docs]):
                yield batches({"rid": ids.slice(a, b - a).cast(pa.int64()), "members": [s.tobytes() for s in shingle_sets(docs[a:b], p.words)]}, schema)

    return run, "rid long, members binary"


def _confirmed(p: Params):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            u, v, a, b = batch.columns
            keep = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
            keep = np.array(keep, bool)
            yield batches({"u": u.to_numpy()[keep], "v": v.to_numpy()[keep]}, schema)

    return run, "u long, v long"


def _in_blocks(left: DataFrame, p: Params) -> DataFrame:
    """Each member once for each pair of blocks that it takes part in; ``left`` has the size n of its set.

    A bucket's largest component doesn't meet itself: its members are dealt to blocks -1, -2, ..., all others to blocks
    0, 1, ...; those meet each other and the largest component's.
    """
    weight = F.sum(8 * F.col("n") + 2 * p.bands * p.rows)
    sizes = left.groupBy("key", "comp").agg(weight.alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
    sizes = sizes.select("key", F.col("top.comp").alias("top"), F.expr(f"cast(ceil((all - top.n) / {p.block_bytes}) as int)").alias("minor"), F.expr(f"cast(ceil(top.n / {p.block_bytes}) as int)").alias("major"))
    rows = left.join(sizes, "key").withColumn("mine", F.expr("cast(if(comp = top, -1 - pmod(xxhash64(rid), major), pmod(xxhash64(rid), minor)) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(if(mine < 0, 0, -major), minor - 1)")))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return rows.select("key", "band", "rid", "comp", "mine", F.when(low < 0, high).otherwise(low).alias("bi"), F.when(low < 0, low).otherwise(high).alias("bj"))


def near_duplicates(spark: SparkSession, docs: DataFrame, params: Params | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Rows with equal shingle sets are one node, numbered, whether they have a doc_id or not. In each band bucket a pivot meets all
    others (twice, with the components found so far); what then still stands apart in a bucket is compared in blocks,
    so that no pair of a bucket is left out and no task holds more than two blocks. Each link is confirmed on whole sets.

    component_id is the smallest doc_id of the component, null if none of its rows has one. Of a component those rows
    are ``kept`` that have its smallest doc_id, ids before nulls, and of their texts that with the least hash.

    Null or empty texts, and texts without words: n_shingles 0, component_id = doc_id, kept. Rows that repeat a doc_id
    with other text are judged each by its text. Other columns are ignored; an empty table gives no rows.
    """
    p = params or Params()
    scratch = Scratch(spark)
    fn, kind = _sketches(p)
    rows = scratch.put(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(fn, kind))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = rows.where("n_shingles > 0").groupBy("digest").agg(first, F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"))
    nodes = scratch.put(nodes.withColumn("rid", F.monotonically_increasing_id()))
    unnamed = not nodes.where("first.none").isEmpty()
    fn, kind = _bands(p)
    bands = nodes.select("rid", "n", "sketch").mapInArrow(fn, kind)
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rid").alias("pivot")).where("size > 1").select("key", "pivot")
    members = scratch.put(bands.join(buckets, "key").where("rid <> pivot"))
    sketches = nodes.select("rid", "n", "sketch")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Shingle sets of the nodes, from the first row of each."""
        make, shape = _sets(p)
        at = scratch.put(nodes.join(wanted, "rid", "left_semi").select("rid", F.xxhash64("first.doc_id", "first.text_hash").alias("at")))
        found = docs.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("at")).join(small_side(at, 4_000_000), "at")
        if unnamed:  # rows without id may repeat their text often
            found = found.where("doc_id is not null").union(found.where("doc_id is null").dropDuplicates(["rid"]))
        return scratch.put(found.select("rid", "text").mapInArrow(make, shape))

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = scratch.put(pairs)
        sets = sets_of(pairs.select(F.col("u").alias("rid")).union(pairs.select("v")).distinct())
        check, shape = _confirmed(p)
        both = pairs.join(sets.withColumnsRenamed({"rid": "v", "members": "b"}), "v").join(sets.withColumnsRenamed({"rid": "u", "members": "a"}), "u")
        out = scratch.put(both.select("u", "v", "a", "b").mapInArrow(check, shape).distinct())
        scratch.drop(pairs, sets)
        return out

    def stars(pairs: DataFrame) -> DataFrame:
        prune, shape = _pruned(p)
        both = pairs.join(sketches.withColumnsRenamed({"rid": "v", "n": "nb", "sketch": "b"}), "v").join(sketches.withColumnsRenamed({"rid": "u", "n": "na", "sketch": "a"}), "u")
        return confirm(both.select("u", "v", "na", "nb", "a", "b").mapInArrow(prune, shape).distinct())

    links = stars(members.select(F.col("pivot").alias("u"), F.col("rid").alias("v")).distinct())
    groups = scratch.put(connected(links, scratch))

    def open_members(of: DataFrame) -> DataFrame:
        """Members of the buckets that still hold more than one component, with the bucket's next pivot."""
        named = of.join(groups.withColumnsRenamed({"node": "rid"}), "rid", "left").select("key", "band", "rid", "n", F.coalesce("comp", "rid").alias("comp"))
        apart = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("rid", "comp")).alias("p")).where("low < high")
        return named.join(apart.select("key", "p"), "key")

    left = scratch.put(open_members(members.select("key", "band", "rid", "n")))
    pairs = left.where("comp <> p.comp").select(F.col("p.rid").alias("u"), F.col("rid").alias("v")).distinct()
    more = stars(pairs)
    if not more.isEmpty():
        groups = scratch.put(connected(groups.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more), scratch))
    left = scratch.put(open_members(left.where("rid <> p.rid").select("key", "band", "rid", "n")))
    if not left.isEmpty():
        sets = sets_of(left.select("rid").distinct())
        fn, kind = _block_links(p)
        cut = _in_blocks(left, p).join(sketches.join(sets, "rid"), "rid").repartition(F.col("key"), F.col("bi"), F.col("bj")).sortWithinPartitions("key", "bi", "bj")
        more = scratch.put(cut.select("key", "bi", "bj", "mine", "band", "rid", "comp", "n", "sketch", "members").mapInArrow(fn, kind).distinct())
        if not more.isEmpty():
            groups = scratch.put(connected(groups.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more), scratch))
    named = nodes.select("digest", "rid", "first").join(groups.withColumnsRenamed({"node": "rid"}), "rid", "left")
    tops = scratch.put(named.where("comp is not null").groupBy("comp").agg(F.min("first").alias("top")))
    scratch.drop_all_but(rows, nodes, groups, tops)
    of_digest = named.join(small_side(tops), "comp", "left").select("digest", F.coalesce("top", "first").alias("top"))
    if fits_many(nodes):
        of_digest = F.broadcast(of_digest)
    out = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(of_digest, "digest", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("top.doc_id")).otherwise(F.col("doc_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & ((F.col("n_shingles") == 0) | (F.col("text_hash") == F.col("top.text_hash")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def fits_many(nodes: DataFrame, most: int = 50_000) -> bool:
    return nodes.count() <= most


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.rid AS u, b.rid AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
b AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT rid, rid AS low FROM w UNION SELECT b.v, r.low FROM r JOIN b ON b.u = r.rid WHERE r.low < b.v),
c AS (SELECT rid, min(low) AS low FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(w.doc_id) OVER (PARTITION BY c.low) AS component_id, w.doc_id = min(w.doc_id) OVER (PARTITION BY c.low) AS kept FROM w JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
