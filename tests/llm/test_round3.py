"""Snapshot differences, clusters and repetition rules against brute force, and their special cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.llm.clusters import Bounds, cluster_vectors, squared
from corpusloom.llm.common import Scratch
from corpusloom.llm.repetition import COVERED, LONGEST, common_prefixes, heads, judge_repetition, repeats, suffix_array, word_counts
from corpusloom.llm.snapshots import later_snapshot, ranked, snapshot_difference

DOCS = "doc_id long, text string, lang string, source string"


def plain_difference(old, new):
    """The pairs by their definition; keys are unique in each snapshot."""
    by, out = {r[0]: r for r in old}, []
    later = {r[0]: r for r in new}
    sha = lambda r: hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()
    names = lambda a, b: ",".join(n for n, x, y in zip(("text", "lang", "source"), a[1:], b[1:], strict=True) if x != y)
    for k in by.keys() & later.keys():
        changed = names(by[k], later[k])
        out.append((k, k, "update" if changed else "same", changed, sha(later[k])))
    sides = defaultdict(lambda: ([], []))
    for i, (own, other) in enumerate(((by, later), (later, by))):
        for k in sorted((k for k in own.keys() - other.keys()), key=lambda k: (k is None, k or 0)):
            sides[own[k][1]][i].append(own[k])
    for a, b in sides.values():
        out += [(y[0], x[0], "rekey", names(x, y), sha(y)) for x, y in zip(a, b, strict=False)]
        out += [(x[0], x[0], "delete", "", None) for x in a[len(b) :]] + [(y[0], None, "insert", "", sha(y)) for y in b[len(a) :]]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("key", "old_key", "op", "changed", "row_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_difference(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([None, "", "~", "x", "x", "x", "y", "long\nline"])
    old = [(k, word(), word(), word()) for k in rng.sample(range(-400, 400), 300)]
    new = [(k, word(), word(), word()) for k in rng.sample(range(-400, 400), 280)] + [r for r in old if r[0] % 3 == 0]
    new = list({r[0]: r for r in new}.values())
    a, b = (spark.createDataFrame(x, DOCS).selectExpr("*", "1 as later", "2 as content", "3 as row") for x in (old, new))
    assert rows_of(snapshot_difference(spark, a, b)) == plain_difference(old, new)


def test_later_snapshot(spark):
    old = [(i, None if i % 7 == 0 else f"t{i % 5}", "en" if i % 2 else None, "web") for i in range(300)]
    want = []
    for k, t, g, s in old:
        c = zlib.crc32(str(k).encode()) % 16
        row = {1: (k, (t or "") + "+", g, s), 2: (k, t, s, g), 3: (-1 - k, t, g, s), 4: (-1 - k, t, g, None)}.get(c, (k, t, g, s))
        want += [] if c == 0 else [row, (-1 - k, t, g, s)] if c == 5 else [row]
    df = spark.createDataFrame(old, DOCS)
    got = later_snapshot(df)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert rows_of(snapshot_difference(spark, df, got)) == plain_difference(old, want)


def test_snapshots_with_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", "en", "s"), (1, "b", "en", "s"), (1, "b", "en", "s"), (None, "n", None, None), (None, "m", None, None), (2, "c", None, None)], DOCS)
    new = spark.createDataFrame([(1, "b", "en", "s"), (1, "a", "en", "s"), (None, "n", None, None), (3, "b", "de", "s"), (4, "c", "x", None)], DOCS)
    out = rows_of(snapshot_difference(spark, old, new))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    # by sha256 "b" comes before "a": b meets b, the other b meets a, and a is left
    assert {r for r in out if r[0] is not None} == {(1, 1, "same", "", sha("b\nen\ns")), (1, 1, "update", "text", sha("a\nen\ns")), (1, 1, "delete", "", None), (3, None, "insert", "", sha("b\nde\ns")), (4, 2, "rekey", "lang", sha("c\nx\n~"))}
    assert len(out) == 7 and sorted(r[2] for r in out if r[0] is None)[0] == "delete"
    assert rows_of(snapshot_difference(spark, old, old)) == sorted(((r[0], r[0], "same", "", hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()) for r in map(tuple, old.collect())), key=repr)
    empty = spark.createDataFrame([], DOCS)
    assert {r[2] for r in rows_of(snapshot_difference(spark, old, empty))} == {"delete"} and {r[2] for r in rows_of(snapshot_difference(spark, empty, new))} == {"insert"}
    assert rows_of(snapshot_difference(spark, empty, empty)) == []


def test_a_group_of_any_size_is_ranked_in_lots(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, id, 7) as content", "id as key").repartition(5)
    scratch, setting = Scratch(spark), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    out = ranked(scratch, rows, ["content"], ["key"], "nth", [F.col("content"), F.col("key")]).collect()
    spark.conf.unset(setting)
    hot = sorted((r.key, r.nth) for r in out if r.content == 7)
    assert [n for _, n in hot] == list(range(len(hot))) and len(out) == 20_000 and all(r.nth == 0 for r in out if r.content != 7)
    assert scratch.tables[0].where("content = 7").select("lot").distinct().count() > 1


def plain_clusters(vectors, k, size, rounds, seed=3):
    kept = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for r in range(rounds + 1):
        where = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if r == rounds:
            break
        for c in range(len(centroids)):
            own = [v for (_, v), w in zip(kept, where, strict=True) if w == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    d = [far(v, centroids[w]) for (_, v), w in zip(kept, where, strict=True)]
    by = [sum(x for x, w in zip(d, where, strict=True) if w == c) for c in range(len(centroids))]
    return sorted(((i, w, x, by[w], sum(d), hashlib.sha256(",".join(map(str, centroids[w])).encode()).hexdigest()) for (i, _), w, x in zip(kept, where, d, strict=True)), key=repr)


@pytest.mark.parametrize(("k", "n"), [(8, 400), (5, 90), (8, 3), (1, 20)])
def test_clusters(spark, k, n):
    rng = random.Random(n)
    middle = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    vectors = [(i, [rng.choice([0.0, 0.5, round(m + rng.gauss(0, 0.2), 2)]) for m in rng.choice(middle)]) for i in range(n)]
    vectors += [(n + i, v) for i, v in enumerate([None, [], [1.0] * 3, [1.0] * 5, [1.0, None, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0], [1.0, float("-inf"), 1.0, 1.0]])]
    vectors += [vectors[0], vectors[0], (None, vectors[1][1])]
    told = []
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as cluster").repartition(3)
    df = spark.createDataFrame(df.collect(), df.schema)
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    out = cluster_vectors(spark, df, k, 4, 6, told=told)
    assert sorted(map(tuple, out.collect()), key=repr) == plain_clusters(plain, k, 4, 6)
    assert n < 400 or sum(t["scanned"] for t in told[1:]) < 0.7 * sum(t["rows"] for t in told[1:])


def test_clusters_of_nothing_and_of_huge_numbers(spark):
    kind = "vec_id long, embedding array<float>"
    assert cluster_vectors(spark, spark.createDataFrame([], kind)).count() == 0
    assert cluster_vectors(spark, spark.createDataFrame([(1, [1.0] * 63), (2, None)], kind)).count() == 0
    with pytest.raises(PySparkException, match="would not fit"):
        cluster_vectors(spark, spark.createDataFrame([(1, [1e30] * 64)], kind)).count()


@pytest.mark.parametrize("b", [1, 2, 4, 6])
def test_bounds_decide_like_a_scan(b):
    rng = np.random.default_rng(b)
    v, c = rng.integers(-30, 30, (500, 3)), rng.integers(-30, 30, (7, 3))
    state, skipped = Bounds.scanned(v, c, b), 0
    for r in range(12):
        new = c + rng.integers(-4, 5, c.shape) // (1 + r // 3)
        state.moved(np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-12), b - (r > 8 and b > 1))
        c = new
        state.settle(c)
        assert (state.cluster == squared(v, c).argmin(1)).all()
        skipped += (state.needed == 0).sum()
    assert skipped > 0


def plain_repeats(doc, least):
    n, lcp = len(doc), [0] * len(doc)
    for i in range(n):
        for j in range(i):
            k = 0
            while max(i, j) + k < n and doc[i + k] == doc[j + k]:
                k += 1
            lcp[i], lcp[j] = max(lcp[i], k), max(lcp[j], k)
    return {x for i in range(n) if lcp[i] >= least for x in range(i, i + lcp[i])}, max(lcp, default=0)


@pytest.mark.parametrize("seed", range(40))
def test_repeats(seed):
    rng = random.Random(seed)
    letters = bytes(rng.choice([range(97, 99), range(97, 122), (0, 255, 97)]))
    piece = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
    doc = b"".join(rng.choice([piece, piece[: rng.randrange(40)], bytes(rng.choice(letters) for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(9)))
    doc += rng.choice([b"", b"\xff" * 40, b"ab" * 60])
    data = np.frombuffer(doc, np.uint8)
    if len(doc) > 1:
        order = suffix_array(data, heads(data))
        assert order.tolist() == sorted(range(len(doc)), key=lambda i: doc[i:])
        shared = common_prefixes(data, heads(data), order)
        for a, b in zip(order.tolist(), order[1:].tolist(), strict=False):
            k = shared[b]
            assert doc[a : a + k] == doc[b : b + k] and (max(a, b) + k == len(doc) or doc[a + k] != doc[b + k])
    for least in (1, 5, 20):
        spans, longest = repeats(doc, least)
        want, most = plain_repeats(doc, least)
        assert {x for a, b in spans for x in range(a, b)} == want and longest == most
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_long_repeats_end_soon():
    for doc in (b"a" * 300_000, (b"the same line again\n" * 20_000), np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8).tobytes() * 2):
        spans, longest = repeats(doc)
        assert spans == [(0, len(doc))] and longest >= len(doc) // 2


def test_word_counts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é ", "\n", "a b c d e\n", "#", "\t<", "\x0b", "\x1f", " ", "a b"]) for _ in range(rng.randrange(40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {x for i in range(len(words) - 4) if five[tuple(words[i : i + 5])] > 1 for x in range(i, i + 5)}
        assert word_counts(text.encode()) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_rules(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    clean, passage = prose(300), prose(40)
    unspaced = "".join(rng.choice("漢字仮名交文日本語") for _ in range(200))
    rows = [clean, prose(150) + " " + passage + " " + prose(500) + " " + passage, " ".join([passage] * 3), prose(200) + "x".join([unspaced] * 4), prose(3000) + "-" + unspaced * 2 + "-" + prose(3000), prose(20_000), "few words only", "", None]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(rows)] + [(0, clean, 1, 2), (None, clean, 1, 2)], "doc_id long, text string, kept int, spans int")
    out = judge_repetition(spark, df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 11 and sum(r.kept for r in out if r.doc_id in (0, None)) == 3
    assert by[1].kept and len(by[1].spans) == 2 and not by[1].base_failed
    assert by[2].base_failed and not by[2].kept
    assert not by[3].base_failed and not by[3].kept and 100 * by[3].n_covered > COVERED * len(rows[3].encode())
    assert by[4].longest == 600 and by[4].kept and by[5].kept
    assert all(by[i].base_failed and not by[i].kept for i in (6, 7, 8)) and by[8].n_words == 0
    strict = {r.doc_id: r for r in judge_repetition(spark, df, longest=500).collect()}
    assert LONGEST > 600 and strict[4].long_repeat and not strict[4].kept and strict[5].kept
    assert judge_repetition(spark, df.limit(0)).count() == 0
