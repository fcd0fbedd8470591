"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import U64, Rolling, Scratch, batches, mix, pack_row, slices, small_side, texts, word_spans

SPACE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


#: Evidence of a text without any word that is more frequent in toxic texts.
LEAST = -50.0


@dataclass(frozen=True)
class Params:
    """grams: byte grams and grams of word shapes share 2**bits buckets; words of labelled texts have 2**word_bits for the
    model of toxic wording. keep: share of good held-back texts that the thresholds must keep. sample: share of rows that
    the Gumbel top-k draws. max_labels bounds the sample: about so many labelled texts at most are learned from, so that
    their labels can go to every executor and no text has to be shuffled."""

    bits: int = 15
    word_bits: int = 22
    keep: float = 0.998
    sample: float = 0.5
    least_toxic: int = 4
    max_labels: int = 500_000


@dataclass
class Model:
    """Log ratios target : raw of each bucket; word buckets more frequent in toxic than in clean texts with their log ratios; both thresholds."""

    ratio: np.ndarray
    toxic_words: np.ndarray
    toxic_ratios: np.ndarray
    least: float = -np.inf
    most_toxic: float = np.inf
    params: Params = field(default_factory=Params)


def features(docs: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, doc) of each gram and (bucket, doc) of each word in letters."""
    blob = np.frombuffer(b" ".join([*docs, b""]), np.uint8)
    at = np.cumsum([0, *(len(d) + 1 for d in docs)])
    doc = np.repeat(np.arange(len(docs)), np.diff(at))
    wide = blob.astype(np.uint32)
    n = max(0, len(blob) - 2)
    three = ((wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - p.bits)
    inside = doc[:n] == doc[2 : n + 2] if n else np.zeros(0, bool)
    starts, ends = word_spans(blob, SPACE)
    hashes = Rolling(blob).spans(starts, ends)
    wd = doc[starts]
    upper = np.concatenate(([0], np.cumsum((blob >= 65) & (blob <= 90))))
    marks = np.concatenate(([0], np.cumsum(~LETTER[blob] & SPACE[blob])))
    size = ends - starts
    ups, signs = upper[ends] - upper[starts], marks[ends] - marks[starts]
    again = np.zeros(len(wd), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (wd[1:] == wd[:-1])
    shape = again + 2 * (np.where(ups == 0, 0, np.where(ups == 1, 1, 2)) + 3 * np.minimum(signs, 3) + 12 * (signs == size) + 24 * np.minimum(size // 4, 3))
    k = max(0, len(shape) - 1)
    pair = (mix((shape[:k] * 1000 + shape[1 : k + 1]).astype(U64)) >> U64(64 - p.bits)).astype(np.uint32)
    same = wd[:k] == wd[1 : k + 1] if k else np.zeros(0, bool)
    bucket = np.concatenate((three[inside], pair[same]))
    low = LOWER[blob]
    ls, le = word_spans(low, LETTER)
    words = (Rolling(low).spans(ls, le) >> U64(64 - p.word_bits)).astype(np.int64)
    return bucket.astype(np.int64), np.concatenate((doc[:n][inside], wd[:k][same])), words, doc[ls]


def _counts(p: Params):
    """Counts (kind, bucket, n): 0 raw and 1 target grams; 2 toxic and 3 clean texts with a word, 4 and 5 the texts themselves."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((2, 1 << p.bits), np.int64)
        words = np.zeros((2, 1 << p.word_bits), np.int32)
        both = np.zeros(2, np.int64)
        for batch in it:
            docs = texts(batch.column("text"))
            good = np.array([x == 1 for x in batch.column("good").to_pylist()])
            toxic = np.array([-1 if x is None else x for x in batch.column("toxic").to_pylist()])
            for a, b in slices([len(x) for x in docs]):
                bucket, doc, word, of = features(docs[a:b], p)
                grams[0] += np.bincount(bucket, minlength=1 << p.bits)
                grams[1] += np.bincount(bucket[good[a:b][doc]], minlength=1 << p.bits)
                for k, label in ((0, 1), (1, 0)):
                    own = toxic[a:b][of] == label
                    pairs = np.unique((of[own].astype(np.int64) << p.word_bits) | word[own])
                    np.add.at(words[k], pairs & ((1 << p.word_bits) - 1), 1)
                    both[k] += (toxic[a:b] == label).sum()
        for kind, counts in ((0, grams[0]), (1, grams[1]), (2, words[0]), (3, words[1]), (4, both[:1]), (5, both[1:])):
            at = np.flatnonzero(counts)
            yield batches({"kind": np.full(len(at), kind, np.int32), "bucket": at, "n": counts[at]}, schema)

    return run, "kind int, bucket long, n long"


def _scores(m: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64()), ("mean_ratio", pa.float64()), ("toxic_ratio", pa.float64()), ("kept", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = np.full(1 << m.params.word_bits, LEAST, np.float32)
        evidence[m.toxic_words] = m.toxic_ratios
        for batch in it:
            docs = texts(batch.column("text"))
            for a, b in slices([len(x) for x in docs]):
                bucket, doc, word, of = features(docs[a:b], m.params)
                n = np.bincount(doc, minlength=b - a)
                total = np.bincount(doc, m.ratio[bucket], b - a)
                toxic = np.full(b - a, LEAST)
                np.maximum.at(toxic, of, evidence[word])
                mean = total / np.maximum(n, 1)
                yield batches({"doc_id": batch.column("doc_id").slice(a, b - a).cast(pa.int64()), "n_grams": n, "log_weight": total, "mean_ratio": mean, "toxic_ratio": toxic, "kept": (n > 0) & (mean >= m.least) & (toxic <= m.most_toxic)}, schema)

    return run, "doc_id long, n_grams long, log_weight double, mean_ratio double, toxic_ratio double, kept boolean"


def best_cut(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """Least value to keep: under all but 1 - ``keep`` of the good, half-way down to the next bad one."""
    if not len(good) or not len(bad):
        return -np.inf
    low = float(np.quantile(good, 1 - keep))
    under = bad[bad < low]
    return (low + float(under.max())) / 2 if len(under) else low


def _accepted(m: Model):
    score, _ = _scores(m)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                scored = pa.Table.from_batches(score(iter([batch.select(["doc_id", "text"])])))
                yield batch.select(["row"]).filter(scored.column("kept").combine_chunks())

    return run


def fit(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> Model:
    """Models from all documents and all labelled ones; a fifth of the labelled, by hash of doc_id, sets the thresholds."""
    p = params or Params()
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    share = p.max_labels / max(1, known.count())
    if share < 1:
        known = known.where(F.expr(f"pmod(xxhash64(doc_id, 41), {1 << 30}) < {int(share * (1 << 30))}"))
    known = known.withColumn("held", F.expr("pmod(xxhash64(doc_id, 9), 5) = 0"))
    rows = docs.select("doc_id", "text").join(small_side(known), "doc_id", "left")
    learn = rows.select("text", F.expr("int(not held and quality = 1 and toxic = 0)").alias("good"), F.expr("if(held or quality = 0, null, toxic)").alias("toxic"))
    fn, kind = _counts(p)
    scratch = Scratch(docs.sparkSession)
    sums = scratch.put(learn.mapInArrow(fn, kind).groupBy("kind", "bucket").agg(F.sum("n").alias("n")))
    grams = sums.where("kind < 2 or kind > 3").toPandas()
    words = sums.where("kind in (2, 3)").groupBy("bucket").agg(F.sum(F.expr("if(kind = 2, n, 0)")).alias("t"), F.sum(F.expr("if(kind = 3, n, 0)")).alias("c"))
    words = words.where(f"t >= {p.least_toxic} and t > c").toPandas()
    scratch.drop(sums)
    raw, target = (np.full(1 << p.bits, 0.5) for _ in range(2))
    for k, counts in ((0, raw), (1, target)):
        counts[grams[grams.kind == k].bucket.to_numpy()] += grams[grams.kind == k].n.to_numpy()
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    bad, clean = (float(grams[grams.kind == k].n.sum()) for k in (4, 5))
    toxic = np.log((words.t.to_numpy(float) + 0.5) / (bad + 1)) - np.log((words.c.to_numpy(float) + 0.5) / (clean + 1))
    m = Model(ratio, words.bucket.to_numpy(), toxic, params=p)
    fn, kind = _scores(m)
    held = docs.select("doc_id", "text").join(small_side(known.where("held")), "doc_id", "left_semi").mapInArrow(fn, kind)
    table = held.join(known, "doc_id").groupBy(F.round("mean_ratio", 3).alias("r"), F.round("toxic_ratio", 2).alias("t"), F.col("quality") == 1, F.col("toxic") == 1).agg(F.count("*").alias("n")).toDF("r", "t", "good", "toxic", "n").toPandas()
    of = lambda rows, c: np.repeat(rows[c].to_numpy(float), rows.n.to_numpy())
    m.least = best_cut(of(table[table.good == True], "r"), of(table[table.good == False], "r"), p.keep)  # noqa: E712
    fine = table[table.good == True]  # noqa: E712
    m.most_toxic = -best_cut(-of(fine[fine.toxic == False], "t"), -of(fine[fine.toxic == True], "t"), p.keep)  # noqa: E712
    return m


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Params | None = None, model: Model | None = None) -> DataFrame:
    """One row for each row: doc_id, n_grams, log_weight, mean_ratio, toxic_ratio, kept.

    log_weight is the importance weight: the sum of the log ratios of all grams of the text. A text is rejected if its
    mean ratio is under the least one, or if one of its words is too much more frequent among toxic than clean texts.
    A null or empty text has no grams and is rejected; without labels (or labels of one kind) nothing else is. Labels that
    repeat a doc_id count with their worst values. Repeated rows score alike; null ids are scored. Other columns are
    ignored; an empty table gives no rows.
    """
    m = model or fit(docs, labels, params)
    fn, kind = _scores(m)
    return docs.select("doc_id", "text").mapInArrow(fn, kind)


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Params | None = None, model: Model | None = None) -> DataFrame:
    """The whole rows that ``score_quality`` marks as kept; scored and filtered in one pass, without a join."""
    rows = docs.select("doc_id", "text", pack_row(docs).alias("row"))
    return rows.mapInArrow(_accepted(model or fit(docs, labels, params)), rows.select("row").schema).select("row.*")


def gumbel_top_k(scored: DataFrame, share: float) -> DataFrame:
    """Adds gumbel_key and ``selected``: the share of rows with the highest log_weight plus Gumbel noise, drawn by doc_id.

    The k-th key is narrowed down by counts in bins, so that no task and not the driver sees all keys; ties at it are all drawn.
    """
    u = (F.expr("shiftrightunsigned(xxhash64(doc_id, 31), 11)").cast("double") + 0.5) / float(1 << 53)
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    known = keyed.agg(F.count("*").alias("n"), F.min("gumbel_key").alias("low"), F.max("gumbel_key").alias("high")).first()
    need, low, high = int(known.n * share), known.low, known.high
    while known.n and need and high - low > 1e-9 * max(1.0, abs(high)):
        width = (high - low) / 1024
        bins = keyed.where((F.col("gumbel_key") >= low) & (F.col("gumbel_key") <= high)).groupBy(F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit(1023)).alias("b")).count().collect()
        at = 0
        for r in sorted(bins, reverse=True):
            if need <= r["count"]:
                at = r.b
                break
            need -= r["count"]
        low, high = low + at * width, min(high, low + (at + 1) * width)
        if next(r["count"] for r in bins if r.b == at) == need:
            break
    return keyed.withColumn("selected", F.col("gumbel_key") >= F.lit(low if known.n and share > 0 else None))
