"""Each stage of the pipeline against brute force on a small table with planted cases, nulls, repeats and clashing names."""

import random
import re

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

#: Names that the stages use for columns of their own.
NAMES = ["h", "d", "k", "a", "b", "n", "f", "g", "w", "at", "key", "row", "rid", "comp", "kept", "spans", "words", "hits", "items", "phrases", "trigger", "digest", "text_hash", "n_removed", "good", "toxic", "held", "a.b"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(21)
    return [prose(rng, 30) for _ in range(4)] + [prose(rng, 6)]


@pytest.fixture(scope="module")
def texts(items):
    rng = random.Random(22)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    passages = [prose(rng, n) for n in (55, 70, 120, 30)]
    near = [b.split() for b in base[:10]]
    for words in near:
        words[20] = "changed"
    out = base + base[:5] + [" ".join(w) for w in near]
    out += [f"{prose(rng, 70)} {passages[i % 4]} {prose(rng, 70)}" for i in range(16)]
    out += [f"{prose(rng, 60)} {items[i % 5].upper() if i % 2 else items[i % 5]} {prose(rng, 60)}" for i in range(10)]
    return out + ["", None, " \n ", "one two", "One TWO", "é" * 500, "ab " * 200, prose(rng, 30000), "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), *["1"] * len(NAMES)) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1, *["2"] * len(NAMES)), (None, texts[7], None, None, None, *[None] * len(NAMES)), (None, prose(random.Random(23), 90), None, None, None, *[None] * len(NAMES))]
    return spark.createDataFrame(rows, KIND).repartition(4).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, texts, items, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(enumerate(items)) + [(50, None), (51, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect()), key=str)


def shingles(text):
    words = SPACE.findall((text or "").encode().lower())
    return frozenset(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_near_dedup(spark, docs, sf_dir):
    rows = list(dict.fromkeys(rows_of(docs)))
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    found = rows_of(pipeline.near_dedup(spark, docs, sf_dir))
    groups = {}
    for r, row in zip(root, rows, strict=True):
        groups.setdefault(r, []).append(row)
    assert len(found) == len(groups) and set(found) <= set(rows)
    for rows_ in groups.values():
        named = [i for i, _ in rows_ if i >= 0]
        assert [i for i, t in found if (i, t) in rows_] == [min(named) if named else -1]


def plain_dedup(rows, least):
    """Each row's text without the runs of ``least`` words or more that lie in such runs of words that occur twice."""
    seen, want = {}, []
    for _, t in rows:
        w = SPACE.findall((t or "").encode().lower())
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])] = seen.get(tuple(w[k : k + least]), 0) + 1
    for i, t in rows:
        d = (t or "").encode()
        places, gone, left, at = [m.span() for m in SPACE.finditer(d)], set(), [], 0
        w = SPACE.findall(d.lower())
        for k in range(len(w) - least + 1):
            if seen[tuple(w[k : k + least])] > 1:
                gone.update(range(k, k + least))
        for k in sorted(gone):
            if k - 1 not in gone:
                left.append(d[at : places[k][0]])
            if k + 1 not in gone:
                at = places[k][1]
        rest = b"".join([*left, d[at:]]).decode()
        if not gone:
            want.append((i, t))
        elif rest.strip(" "):
            want.append((i, rest))
    return sorted(want, key=str)


def test_suffix_dedup(spark, docs, texts, sf_dir):
    rows = rows_of(docs)
    want = plain_dedup(rows, pipeline.PASSAGE_WORDS)
    got = pipeline.suffix_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns and rows_of(got) == want
    assert sum(len(t or "") for _, t in want) < sum(len(t or "") for _, t in rows) - 5000
    for r in got.where("doc_id >= 55 and doc_id < 71").collect():
        assert r.n_chars == len(r.text) and r["a.b"] == "1" and (len(r.text.split()) <= 142) == (r.doc_id % 4 != 2 or "x" in r.text)


@pytest.mark.parametrize("letters", [1, 2, 9])
def test_repeated_passages_of_short_and_long_words(spark, sf_dir, letters):
    """Passages of 50 words or more go however few or many bytes they have, in whatever case and white space; 49 words stay."""
    rng = random.Random(letters)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = lambda n: " ".join(word(letters) for _ in range(n))
    shared = [passage(rng.choice([49, 50, 51, 60, 130])) for _ in range(60)]
    rows = []
    for i in range(180):
        p = shared[i % 60]
        p = [p, p.upper(), re.sub(" ", lambda _: rng.choice([" ", "\n", "\t\r\n", "  "]), p)][i // 60]
        rows.append((i, f"{' '.join(word(7) for _ in range(rng.randrange(30)))} {p} {' '.join(word(7) for _ in range(rng.randrange(1, 30)))}", "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = plain_dedup(rows_of(docs), pipeline.PASSAGE_WORDS)
    assert rows_of(pipeline.suffix_dedup(spark, docs, sf_dir)) == want
    gone = [i for i in range(180) if len(shared[i % 60].split()) >= 50]
    assert all(len(t.split()) < 60 for i, t in want if i in gone) and all(len(t.split()) >= 49 for i, t in want if i not in gone)


def test_decontaminate(spark, docs, items, sf_dir):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in items:
        w = word.findall(t.encode().lower())
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}

    def clean(t):
        w = word.findall((t or "").encode().lower())
        return not any(tuple(w[k : k + n]) in windows for n in (6, 10) for k in range(len(w) - n + 1))

    found = rows_of(pipeline.decontaminate(spark, docs, sf_dir))
    assert found == [r for r in rows_of(docs) if clean(r[1])] and len(found) == docs.count() - 10


def test_quality_keeps_texts_with_grams(spark, docs, sf_dir):
    """All labels are good, so only texts without a gram go."""
    found = rows_of(pipeline.quality(spark, docs, sf_dir))
    assert found == [r for r in rows_of(docs) if len((r[1] or "").encode()) > 2]


def test_quality_rejects_what_labels_tell(spark, tmp_path):
    """Low quality and toxic texts go, labelled or not, and clean ones stay; labels may be null, repeated or of no document."""
    rng = random.Random(24)
    good = lambda: prose(rng, rng.randrange(60, 120))
    bad = lambda: " ".join("".join(rng.choice("qxzwv%$=") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(60, 120)))
    toxic = lambda: " ".join(rng.choice(["vilekk", "nastyjj", "foulhh"]) if rng.random() < 0.1 else w for w in good().split())
    kinds = ["good"] * 500 + ["bad"] * 200 + ["toxic"] * 150
    rng.shuffle(kinds)
    rows = [(i, {"good": good, "bad": bad, "toxic": toxic}[k](), "en", "s", 1) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = [(i, int(k != "bad"), int(k == "toxic")) for i, k in enumerate(kinds) if rng.random() < 0.6]
    labels += [*labels[:20], (None, 0, 1), (10**6, 0, 1), (rows[0][0], None, None), (rows[1][0], None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in pipeline.quality(spark, docs, str(tmp_path)).collect()}
    share = {k: sum(i in kept for i, x in enumerate(kinds) if x == k) / kinds.count(k) for k in ("good", "bad", "toxic")}
    assert share["good"] > 0.97 and share["bad"] == 0 and share["toxic"] < 0.05


def test_packing(spark, docs, sf_dir):
    out = pipeline.packing(spark, docs, sf_dir).collect()
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0) and sum(r.start == 0 for r in out) == docs.count()


def test_empty_table(spark, docs, sf_dir):
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
