"""Operators that SQL can't express against plain versions that look at one record, byte or window at a time."""

import hashlib
import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpusloom.llm import fingerprints, quality
from corpusloom.llm.licenses import NEGATIONS, TEMPLATES, Templates
from corpusloom.llm.packing import best_fit_decreasing, pack
from corpusloom.llm.quality import Model, Params, gumbel_top_k, score_quality
from corpusloom.llm.sharding import shard_documents


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def chained(*parts: bytes) -> int:
    """The engine's xxhash64 of several values."""
    h = 42
    for p in parts:
        h = xxhash.xxh64(p, seed=h).intdigest()
    return h


@pytest.mark.parametrize("weights", [[1.0] * 16, [1.0, 2.5, 0.5]])
def test_shards_have_the_highest_score(spark, weights):
    def scores(key):
        u = [(int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for i in range(len(weights) + 1)]
        return [-w / math.log(x) for w, x in zip([*weights, sum(weights) / len(weights)], u, strict=True)]

    rows = [(i, f"text {i}") for i in range(400)] + [(None, "a"), (7, "again"), (-5, None)]
    out = shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()
    assert len(out) == len(rows)
    for r in out:
        found = scores("null" if r.doc_id is None else str(r.doc_id))
        assert r.shard == max(range(len(weights)), key=lambda i: found[i])
        assert r.grown_shard == max(range(len(weights) + 1), key=lambda i: found[i])


def plain_digest(text: bytes) -> bytes:
    counts, wide = [0] * fingerprints.BUCKETS, text + b"\0\0\0\0"
    for i in range(len(text)):
        for triplet in fingerprints.TRIPLETS:
            code = 0
            for table, k in zip(fingerprints.TABLES, triplet, strict=True):
                code ^= int(table[wide[i + k]])
            counts[code] += 1
    ordered, n = sorted(counts), fingerprints.BUCKETS
    q = [ordered[n // 4 - 1], ordered[n // 2 - 1], ordered[3 * n // 4 - 1]]
    codes = [sum(c > x for x in q) for c in counts]
    body = bytes(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, n, 4))
    top = max(1, q[2])
    return bytes([min(255, round(8 * math.log2(1 + len(text)))), (15 * q[0] // top) << 4 | 15 * q[1] // top]) + body


def plain_likeness(a: bytes, b: bytes) -> float:
    total = min(abs(a[0] - b[0]), 64) / 4 + sum(abs((a[1] >> s & 15) - (b[1] >> s & 15)) for s in (0, 4)) / 4
    for x, y in zip(a[2:], b[2:], strict=True):
        for s in (0, 2, 4, 6):
            d = abs((x >> s & 3) - (y >> s & 3))
            total += 6 if d == 3 else d
    return 1 - min(total, fingerprints.LIMIT) / fingerprints.LIMIT


def test_fingerprints(spark):
    rng = random.Random(31)
    texts = ["", None, "a", "ab", "abcd", "é" * 9, prose(rng, 5), prose(rng, 400), prose(rng, 400), "x" * 3000, prose(rng, 3000)]
    texts.append(texts[7])
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(t) // 4
        new = (t[: len(t) - n] + after[:n]).encode()
        own, edited, following = (plain_digest(x) for x in (t.encode(), new, after.encode()))
        assert out[i].fingerprint == own.hex() and out[i].edited_fingerprint == edited.hex() and out[i].n_chars == len(t)
        assert out[i].near_edited == pytest.approx(plain_likeness(own, edited)) and out[i].near_next == pytest.approx(plain_likeness(own, following))


def test_fingerprints_of_rows_without_or_with_one_id(spark):
    """Each row has its successor, in many ranges, though most ids are alike."""
    rng = random.Random(32)
    rows = [(i, "once") for i in range(30)] + [(7, f"seven {i}") for i in range(120)] + [(None, f"none {i}") for i in range(120)] + [(7, "seven 5")] * 3
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    out = fingerprints.fingerprint_documents(spark, docs, per_range=10).collect()
    h = lambda t: (x := chained(t.encode())) - (1 << 64) * (x >> 63)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1]), r[1]))
    want = Counter((i, hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()) for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == want


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 64, 300])
    lengths = [rng.randrange(1, window + 1) if seed % 2 else min(window, 1 + int(rng.expovariate(4 / window))) for _ in range(1500)]
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(window - n)
    used, seen = Counter(), Counter()
    for length, rank, count, first, offset in best_fit_decreasing(dict(Counter(lengths)), window):
        assert seen[length] == rank
        seen[length] += count
        for s in range(first, first + count):
            assert used[s] == offset
            used[s] += length
    assert seen == Counter(lengths) and sorted(window - n for n in used.values()) == sorted(room)


def test_packing_is_best_fit(spark):
    rng = random.Random(33)
    docs = spark.createDataFrame([(i, prose(rng, rng.randrange(1, 90))) for i in range(300)], "doc_id long, text string")
    out = pack(spark, docs, 128).collect()
    room: list[int] = []
    for n in sorted((r.length for r in out), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(128 - n)
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert sorted(128 - n for n in used.values()) == sorted(room)


def plain_grams(text: bytes, p: Params) -> Counter:
    """Buckets of byte triplets of a text and a blank, and of pairs of word shapes, one after the other."""
    out = Counter()
    closed = text + b" "
    for i in range(len(closed) - 2):
        code = closed[i] | closed[i + 1] << 8 | closed[i + 2] << 16
        out[(code * 2654435761 & 0xFFFFFFFF) >> 32 - p.bits] += 1
    words = text.split()
    shapes = []
    for i, w in enumerate(words):
        ups = sum(65 <= b <= 90 for b in w)
        signs = sum(not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in w)
        shapes.append((i > 0 and words[i - 1] == w) + 2 * (min(ups, 2) + 3 * min(signs, 3) + 12 * (signs == len(w)) + 24 * min(len(w) // 4, 3)))
    for a, b in zip(shapes, shapes[1:], strict=False):
        out[int(quality.mix(np.array([a * 1000 + b], np.uint64))[0]) >> 64 - p.bits] += 1
    return out


def test_quality_scores(spark):
    rng, p = random.Random(34), Params()
    texts = [prose(rng, 30).capitalize() + "." for _ in range(40)] + [f"{prose(rng, 9).upper()} !!! 12 12 12" for _ in range(20)] + ["", "ab", "ab cd"]
    good = {i for i in range(40) if xxhash_bucket(i, 9, 5)}
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        own = plain_grams(t.encode(), p)
        raw.update(own)
        if i in good:
            target.update(own)
    size = 1 << p.bits
    weight = lambda c, k: math.log((c[k] + 0.5) / (sum(c.values()) + size / 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in score_quality(spark, docs, labels).collect()}
    for i, t in enumerate(texts):
        own = plain_grams(t.encode(), p)
        assert out[i].n_grams == sum(own.values())
        assert out[i].log_weight == pytest.approx(sum(n * (weight(target, k) - weight(raw, k)) for k, n in own.items()))


def xxhash_bucket(i: int, salt: int, n: int) -> bool:
    """Whether a labelled row is learned from: its hash isn't 0 modulo n."""
    h = chained(struct.pack("<q", i), struct.pack("<i", salt))
    return (h - (1 << 64) if h >> 63 else h) % n != 0


def test_gumbel_top_k(spark):
    rng = random.Random(35)
    rows = [(i, rng.gauss(0, 30)) for i in range(700)]
    out = gumbel_top_k(spark.createDataFrame(rows, "doc_id long, log_weight double"), 0.3).collect()
    keys = {}
    for i, w in rows:
        u = ((chained(struct.pack("<q", i), struct.pack("<i", 31)) >> 11) + 0.5) / 2**53
        keys[i] = w - math.log(-math.log(u))
    best = sorted(keys, key=keys.get, reverse=True)[:210]
    assert {r.doc_id for r in out if r.selected} == set(best) and all(r.gumbel_key == pytest.approx(keys[r.doc_id]) for r in out)


def test_a_model_can_be_given(spark):
    p = Params()
    m = Model(np.zeros(1 << p.bits), np.zeros(0, int), np.zeros(0), params=p)
    assert score_quality(spark, spark.createDataFrame([(1, "some text")], "doc_id long, text string"), None, model=m).first().log_weight == 0


def word_edits(statement, words) -> float:
    """Words changed, left out or added between a statement and all the given words, by the textbook table."""
    n, inf = len(words), math.inf
    row = list(range(n + 1))
    for i, w in enumerate(statement.words, 1):
        new = [inf if statement.fixed[i - 1] else row[0] + 1]
        for j, x in enumerate(words, 1):
            ways = [row[j - 1] + (0 if w == x else inf if statement.fixed[i - 1] else 1)]
            if not statement.fixed[i - 1]:
                ways.append(row[j] + 1)
            if not (i < len(statement.words) and statement.glued[i - 1]):
                ways.append(new[j - 1] + 1)
            new.append(min(ways))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(8))
def test_license_statements_align_with_the_fewest_edits(seed):
    rng = random.Random(seed)
    t = Templates(TEMPLATES)
    for statement in rng.sample([x for own in t.statements.values() for x in own], 6):
        own = list(statement.words)
        for _ in range(rng.randrange(statement.most + 2)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], [own[k], "zz"], ["zz"], ["the"]])
            own = own or ["zz"]
        words = ["aa"] * rng.randrange(4) + own + ["bb"] * rng.randrange(4)
        hits = statement.align(words, Counter(words))
        costs = {(i, j): word_edits(statement, words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
        least = min(costs.values())
        negated = any(w in NEGATIONS for w in words) != any(w in NEGATIONS for w in statement.words)
        if least <= statement.most and not negated:
            assert hits and hits[0].differing == least == costs[hits[0].start, hits[0].end]
        elif least > statement.most:
            assert not hits


def test_templates_rank_by_compression():
    t = Templates(TEMPLATES)
    for name, statements in TEMPLATES.items():
        block = ("some words before it, " + max(statements, key=len) + " and after").encode()
        sizes = {x: len(t.packed[x].compress(block)) for x in TEMPLATES}
        assert t.ranked(block) == sorted(TEMPLATES, key=lambda x: (sizes[x], x)) and t.ranked(block)[0] == name or len(max(statements, key=len)) < 40
