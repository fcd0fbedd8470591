"""Language of a text: averaged embeddings of hashed subwords with a linear softmax, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import batches, slices, small_side, texts

NONE = "und"
#: ASCII letters in lower case and all bytes of other signs stay, the rest separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Params:
    """per_language and max_texts bound the sample: about so many texts of each language, and of all, are learned from."""

    bits: int = 15
    grams: tuple[int, ...] = (2, 3, 4)
    dim: int = 16
    per_language: int = 500
    max_texts: int = 100_000
    epochs: int = 8
    rate: float = 0.5
    batch: int = 32
    held_back: float = 0.2
    accuracy: float = 0.99


@dataclass
class Model:
    """Embedding of each bucket, output weights, bias, temperature, least confidence.

    ``table`` has the embeddings, or where there are fewer languages than dimensions the product with the output weights;
    then ``out`` is None. Either way it is as large as the buckets and dimensions, however many languages there are.
    """

    langs: list[str]
    table: np.ndarray
    out: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    params: Params = field(default_factory=Params)


def subwords(docs: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all texts, and the text of each."""
    blob = np.frombuffer(b"    ".join([b"", *docs, b""]).translate(LETTERS), np.uint8)
    at = np.cumsum([4, *(len(d) + 4 for d in docs)])
    gap = blob == 32
    wide = blob.astype(np.uint32)
    found, place = [], []
    for n in p.grams:
        size = len(blob) - n + 1
        inner = np.zeros(size, bool)
        for k in range(1, n - 1):
            inner |= gap[k : size + k]
        if n == 2:
            inner = gap[:size] | gap[1 : size + 1]
        inner |= gap[:size] & gap[n - 1 : size + n - 1]
        i = np.flatnonzero(~inner)
        code = wide[i].copy()
        for k in range(1, n):
            code |= wide[i + k] << np.uint32(8 * k)
        found.append((code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - p.bits))
        place.append(i)
    place = np.concatenate(place)
    return np.concatenate(found), np.searchsorted(at, place + 3, "right") - 1


def has_letter(doc: bytes) -> bool:
    return bool(doc.translate(LETTERS).strip()) and (any(97 <= b <= 122 for b in doc.lower()[:64]) or any(c.isalpha() for c in doc.decode()))


def scored(bucket: np.ndarray, doc: np.ndarray, weight: np.ndarray | None, n: int, m: Model) -> np.ndarray:
    """Logits of n texts from the buckets of their subwords."""
    own = m.table[bucket] if weight is None else m.table[bucket] * weight[:, None]
    flat = np.stack([np.bincount(doc, own[:, c], n) for c in range(m.table.shape[1])], axis=1)
    mean = flat / np.maximum(1, np.bincount(doc, weight, n))[:, None]
    return (mean if m.out is None else mean @ m.out) + m.bias


def logits(docs: list[bytes], m: Model) -> np.ndarray:
    bucket, doc = subwords(docs, m.params)
    return scored(bucket, doc, None, len(docs), m)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], p: Params) -> Model:
    """Fit on 1 - held_back of the texts, given as buckets and their counts; fit the temperature and the least confidence on the others."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << p.bits, 0)), None, np.zeros(0), params=p)
    y = np.searchsorted(names, langs)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    held, own = np.split(order, [int(len(order) * p.held_back)])
    shares = [n / max(1, n.sum()) for _, n in rows]
    table, out, bias = rng.normal(0, 0.1, (1 << p.bits, p.dim)), rng.normal(0, 0.1, (p.dim, len(names))), np.zeros(len(names))
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        rng.shuffle(own)
        for at in range(0, len(own), p.batch):
            some = own[at : at + p.batch]
            k = np.concatenate([rows[i][0] for i in some])
            w = np.concatenate([shares[i] for i in some])
            of = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            mean = np.stack([np.bincount(of, table[k, d] * w, len(some)) for d in range(p.dim)], axis=1)
            off = softmax(mean @ out + bias)
            off[np.arange(len(some)), y[some]] -= 1
            back = off @ out.T
            out -= rate * mean.T @ off
            bias -= rate * off.mean(0)
            np.subtract.at(table, k, 20 * rate * w[:, None] * back[of])
    few = len(names) <= p.dim
    m = Model(names, (table @ out if few else table).astype(np.float32), None if few else out.astype(np.float32), bias.astype(np.float32), params=p)
    if len(held):
        z = np.concatenate([scored(rows[i][0], np.zeros(len(rows[i][0]), np.int64), rows[i][1].astype(float), 1, m) for i in held])
        scales = np.geomspace(0.02, 20, 80)
        m.temperature = float(min(scales, key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()))
        sure = softmax(z / m.temperature)
        right, top = sure.argmax(1) == y[held], sure.max(1)
        by = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= p.accuracy)
        m.reject_below = float(top[by[good[-1]]]) if len(good) else 1.0
    return m


def _counted(p: Params):
    """Buckets of each whole text and how often it has them: a text of any length makes no more than there are buckets."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("mark", pa.int64()), ("bucket", pa.binary()), ("n", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            docs = texts(batch.column("text"))
            for a, b in slices([len(x) for x in docs]):
                bucket, doc = subwords(docs[a:b], p)
                key, n = np.unique((doc << p.bits) | bucket, return_counts=True)
                cuts = np.searchsorted(key >> p.bits, np.arange(b - a + 1))
                key = (key & ((1 << p.bits) - 1)).astype(np.int32)
                parts = [(key[i:j].tobytes(), n[i:j].astype(np.int32).tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield batches({"bucket": [x for x, _ in parts], "n": [x for _, x in parts]} | {c: batch.column(c).slice(a, b - a) for c in ("doc_id", "lang", "mark")}, schema)

    return run, "doc_id long, lang string, mark long, bucket binary, n binary"


def fit(docs: DataFrame, params: Params | None = None) -> Model:
    """Learn from (doc_id, text, lang) rows with text and lang; the sample is chosen by a hash of doc_id. Only counts of
    buckets come to the driver, of ``per_language`` texts a language and ``max_texts`` in all."""
    p = params or Params()
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sizes.count()
    if not langs:
        return train([], [], p)
    share = F.least(F.lit(1.0), F.lit(min(float(p.per_language), p.max_texts / langs)) / F.col("n"))
    small = small_side(sizes.select("lang", (share * (1 << 30)).cast("long").alias("share")))
    sample = known.join(small, "lang").where(F.expr("pmod(xxhash64(doc_id), 1073741824)") < F.col("share"))
    fn, kind = _counted(p)
    rows = sample.select("doc_id", "lang", F.xxhash64("text").alias("mark"), "text").mapInArrow(fn, kind).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.mark))
    return train([(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.n, np.int32)) for r in rows], [r.lang for r in rows], p)


def _predictions(m: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            docs = texts(batch.column("text"))
            for a, b in slices([len(x) for x in docs]):
                some = docs[a:b]
                letters = np.array([has_letter(d) for d in some])
                if m.langs:
                    sure = softmax(logits(some, m) / m.temperature)
                    name, score = np.array(m.langs, object)[sure.argmax(1)], sure.max(1)
                else:
                    name, score, letters = np.full(b - a, NONE, object), np.zeros(b - a), np.zeros(b - a, bool)
                name, score = np.where(letters, name, NONE), np.where(letters, score, 0.0)
                yield batches({"doc_id": batch.column("doc_id").slice(a, b - a).cast(pa.int64()), "held_out": batch.column("held_out").slice(a, b - a), "lang_pred": name, "score": score, "rejected": ~letters | (score < m.reject_below)}, schema)

    return run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify_language(spark: SparkSession, docs: DataFrame, params: Params | None = None) -> DataFrame:
    """One row for each row: doc_id, held_out, lang_pred, score, rejected.

    Rows whose crc32 of doc_id, modulo 4, is 2 are held out from learning. score is the calibrated probability;
    ``rejected`` marks the texts whose score is under the least one at which the texts held back in training were
    99 % right. A null text or one without letters: und, 0, rejected. A null doc_id is predicted, never learned from,
    and not held out. Repeated rows are predicted alike; without any labelled row all are und. Other columns are ignored.
    """
    out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    m = fit(docs.where(~out), params)
    fn, kind = _predictions(m)
    return docs.select("doc_id", out.alias("held_out"), "text").mapInArrow(fn, kind)
