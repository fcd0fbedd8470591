"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import hashlib
import random
import textwrap
import time
import zlib

import numpy as np
import pytest

from corpusloom.llm import near_dup, pretokens, repeats, token_counts
from corpusloom.llm.common import Scratch
from corpusloom.llm.components import connected
from corpusloom.llm.decontamination import find_contamination
from corpusloom.llm.fingerprints import digests, edited, fingerprint_documents, likeness
from corpusloom.llm.language import NONE, identify_language
from corpusloom.llm.licenses import Templates, scan_blocks, scan_licenses, TEMPLATES
from corpusloom.llm.packing import best_fit_decreasing, default_vocabulary, pack
from corpusloom.llm.parsing import corpus_order
from corpusloom.llm.pretokens import Encoder
from corpusloom.llm.quality import gumbel_top_k, score_quality
from corpusloom.llm.sharding import shard_documents
from corpusloom.llm.token_counts import count_tokens

KIND = "doc_id long, text string, lang string, source string, n_chars long, h long, pos int, words string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 90)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), prose(rng, 40) + " " + passage, prose(rng, 30) + "\n" + passage, "", None, "one two", "ONE Two", prose(rng, 9000), "é" * 30 + " x", "aaaa " * 300, "Released under the MIT License.", "!!! 123"]
    out = [(i, t, ["en", "de"][i % 2], "s", 1, 1, 1, "x") for i, t in enumerate(texts)]
    return [*out, (5, "", None, None, None, None, None, None), (None, base, None, None, None, None, None, None), (0, base, "en", "s", 1, 1, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_language(spark, docs, empty):
    out = identify_language(spark, docs).collect()
    assert len(out) == 17 and identify_language(spark, empty).count() == 0
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == NONE and by[i].score == 0 for i in (5, 6, 13)) and by[0].lang_pred in ("en", "de") and not by[None].held_out
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


@pytest.mark.parametrize("n", [3, 24])
def test_language_of_held_out_texts(spark, n):
    """Made languages, more and fewer than the model has dimensions, each with letters and word lengths of its own."""
    rng = random.Random(15)
    letters = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyzéßñ", 9)) for _ in range(n)]
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randrange(2, 8)))
    rows = [(i, " ".join(word(i % n) for _ in range(rng.randrange(20, 60))), f"l{i % n:02}") for i in range(n * 60)]
    out = identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len(out) > n * 8 and sum(r.lang_pred == rows[r.doc_id][2] for r in out) >= 0.95 * len(out)


def test_near_duplicates(spark, docs, empty):
    out = near_dup.near_duplicates(spark, docs).collect()
    assert len(out) == 17 and near_dup.near_duplicates(spark, empty).count() == 0
    by = {r.doc_id: r for r in out}
    assert by[1].component_id == by[2].component_id == 0 and by[8].component_id == 7 and by[None].component_id == 0
    assert by[5].n_shingles == by[6].n_shingles == 0 and by[5].kept and by[6].kept and by[7].n_shingles == 1 and not by[1].kept


def test_near_duplicates_without_or_with_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(11)
    lone, copied, clean, twin = (prose(rng, 120) for _ in range(4))
    rows = [(None, lone), (None, lone.replace(" ", "  ", 1)), (None, f"{lone} more"), (None, lone), (3, copied), (9, copied), (9, clean), (12, f"{clean} more"), (None, f"{copied} more"), (20, twin), (20, f"{twin} more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r.doc_id, r.text_hash, r.component_id) for r in near_dup.near_duplicates(spark, docs).collect()]
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    want = [(i, hashes[x], None if lone[:50] in x.replace("  ", " ") else 20 if twin in x else 9 if clean in x else 3) for i, x in rows]
    assert sorted(out, key=str) == sorted(want, key=str)
    left = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in left) == ["20", "3", "9", "None"] and (3, copied) in left and (9, clean) in left


def test_likelihood_and_blocks_agree_with_sets():
    rng = np.random.default_rng(1)
    p = near_dup.Params()
    a = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
    b = np.concatenate((a[:480], np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))))
    regs = near_dup.registers([np.sort(a), np.sort(b)], p)
    guess = near_dup.likely_similarity(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(guess - 480 / 720) < 0.2
    assert (near_dup.registers([np.union1d(a, b)], p)[0] == regs.max(0)).all()


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(2)
    base = prose(rng, 100).split()
    texts = []
    for _ in range(150):
        words = list(base)
        for k in rng.sample(range(100), rng.randrange(1, 9)):
            words[k] = "z" + str(rng.random())
        texts.append(" ".join(words))
    out = near_dup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), near_dup.Params(block_bytes=16_000)).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(root))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "u long, v long")
    assert {tuple(r) for r in connected(edges, Scratch(spark)).collect()} == {(i, 0) for i in range(21)} | {(40, 40), (50, 40)}


def test_decontamination(spark, docs, empty):
    text = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(10, text, "x"), (2, "w3 W4 w5", "x"), (3, "", "x"), (4, None, "x"), (None, "zz", "x"), (2, "w3 w4 w5", "x")], "item_id long, text string, words string")
    some = spark.createDataFrame([(1, "a " + " ".join(f"W{i}" for i in range(5, 16)) + ", b"), (1, "a " + " ".join(f"W{i}" for i in range(5, 16)) + ", b"), (2, "w3-w4-w5 w3 w4 w5"), (3, " ".join(f"w{i}" for i in range(9, 18))), (4, None), (None, "zz")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in find_contamination(spark, some, items).collect())
    assert got == [(-1, 1, 1, 1, True), (1, 13, 11, 1, True), (1, 13, 11, 1, True), (2, 6, 6, 1, True), (3, 9, 0, 0, False), (4, 0, 0, 0, False)]
    assert find_contamination(spark, docs, items).where("contaminated").count() == 0 and find_contamination(spark, empty, items).count() == 0
    assert find_contamination(spark, some, items.where("false")).where("n_hit > 0").count() == 0


def brute_repeats(rows, length):
    """(doc_id or -1, bytes, removed, spans, digest of the rest) by looking at each string of each text."""
    seen = {}
    data = [(r[1] or "").encode() for r in rows]
    for d in data:
        for k in range(len(d) - length + 1):
            seen[d[k : k + length]] = seen.get(d[k : k + length], 0) + 1
    want = []
    for r, d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((-1 if r[0] is None else r[0], len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(want)


def removed(out):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)


@pytest.mark.parametrize("group", [1000, 1])
def test_repeats(spark, docs, rows, empty, group):
    assert removed(repeats.remove_repeats(spark, docs, group=group).collect()) == brute_repeats(rows, 400)
    assert repeats.remove_repeats(spark, empty, group=group).count() == 0


def test_repeats_keep_rows_with_clashing_names(spark, docs):
    named = docs.selectExpr("*", "1 as d", "2 as k", "3 as spans", "4 as kept", "5 as `row`", "6 as n_removed", "7 as `a.b`")
    out = repeats.remove_repeats(spark, named, keep_text=True, carry=True).where("doc_id = 3").first()
    assert out.row.words == "x" and out.row.kept == 4 and out.row["a.b"] == 7 and hashlib.sha256(out.kept.encode()).hexdigest() == out.kept_sha256


@pytest.mark.parametrize(("group", "piece"), [(1000, 1 << 20), (6, 700), (1, 50)])
def test_repeats_of_common_passages(spark, monkeypatch, group, piece):
    """Passages a little shorter and longer than the strings, in many texts each, with other text around them."""
    monkeypatch.setattr(repeats, "PIECE_BYTES", piece)
    rng = random.Random(12)
    shared = [prose(rng, 200)[:n] for n in (90, 99, 100, 101, 117, 160, 260)]
    rows = [(i, f"{prose(rng, rng.randrange(30))} {shared[i % 7]} {prose(rng, rng.randrange(30))}{shared[i % 3] * (i % 5 == 0)}") for i in range(70)]
    rows += [(100, "ab" * 300), (101, "x" * 250), (102, "x" * 99), (103, shared[4] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(repeats.remove_repeats(spark, docs, 100, 16, group=group).collect()) == brute_repeats(rows, 100)


def test_repeats_without_case(spark):
    rng = random.Random(17)
    shared = prose(rng, 60)
    rows = [(0, f"{prose(rng, 9)} {shared}"), (1, f"{prose(rng, 9)} {shared.upper()}"), (2, shared.replace(" ", "\n"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed >= len(shared) for r in repeats.remove_repeats(spark, docs, 100, 16, fold=True).collect())
    assert removed(repeats.remove_repeats(spark, docs, 100, 16).collect()) == brute_repeats(rows, 100)


def test_repeats_of_enough_words(spark):
    rng = random.Random(13)
    few, many = prose(rng, 49), prose(rng, 51)
    rows = [(i, f"{prose(rng, 20)}\n{few if i < 2 else many}\n{prose(rng, 20)}") for i in range(4)]
    out = {r.doc_id: (r.n_spans, len(r.kept.split())) for r in repeats.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 100, 16, keep_text=True, least_words=50).collect()}
    assert out[0] == out[1] == (0, 89) and out[2][0] == out[3][0] == 1 and out[2][1] == 39  # the line breaks go too


def test_corpus_order_is_lexicographic():
    rng = random.Random(4)
    blocks = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 300))) for _ in range(12)]
    text, order = corpus_order(blocks + blocks[:2], 64)
    keys = [tuple(text[i : i + 64].tolist()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(text)))


def test_sharding(spark, docs, empty):
    out = shard_documents(spark, docs, per_lot=1).collect()
    assert len(out) == 17 and shard_documents(spark, empty).count() == 0
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert all(r.grown_shard in (r.shard, 16) for r in out) and len({r.shard for r in out if r.doc_id == 0}) == 1
    assert {(r["size"], r.text_crc32) for r in out if r.doc_id == 6} == {(1, 0)}
    many = shard_documents(spark, spark.range(20000).selectExpr("id doc_id", "'' text"), [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs(next(r["count"] for r in many if r.shard == 1) - 15000) < 500


def test_fingerprints(spark, docs, rows, empty):
    out = fingerprint_documents(spark, docs).collect()
    assert len(out) == 17 and fingerprint_documents(spark, empty).count() == 0
    ordered = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in rows))
    want = sorted((a[0], hashlib.sha256(edited(a[1], b[1]).encode()).hexdigest()) for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.edited_sha256) for r in out) == want
    assert len({r.fingerprint for r in out if r.doc_id in (0, 1, None)}) == 1 and all(0 <= r.near_next <= 1 for r in out)
    d = digests([b"", b"abc", b"abc"])
    assert likeness(d[1:2], d[2:3])[0] == 1


def test_packing(spark, docs, rows, empty):
    out = pack(spark, docs, 64).collect()
    assert pack(spark, empty).count() == 0
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    encoder = Encoder(default_vocabulary())
    for i, text in ((2, rows[2][1]), (6, ""), (10, rows[10][1])):
        ids = np.append(encoder.whole([text.encode()])[0], 1).astype("<u4")
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in mine] == list(range(0, len(ids), 64)) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in mine)
    plan = best_fit_decreasing({5: 3, 4: 3, 2: 4, 1: 1}, 9)
    assert sum(p[2] for p in plan) == 11 and max(p[3] + p[2] for p in plan) == 4


def test_encoder_equals_tokenizer():
    encoder = Encoder(default_vocabulary())
    texts = [x.encode() for x in ("it's 'sabc ''s 5's I'LL we'rex !!'s", "É'S Çà 12 3a", "", "' 'd", "'ve'll", "<|endoftext|> a", "naïve × ÷ ÿß", "日本 ＡＢ", "á\x1cb")]
    assert [x.tolist() for x in encoder.encode(texts)] == [x.tolist() for x in encoder.whole(texts)]


def test_encoder_of_long_texts(monkeypatch):
    monkeypatch.setattr(pretokens, "PART_BYTES", 50)
    encoder, rng = Encoder(default_vocabulary()), random.Random(16)
    texts = [x.encode() for x in (prose(rng, 60), "x" * 300 + " it's\n'll " + "y" * 80, "a b" * 100, "é" * 99 + " it's", " " * 200 + "z", "word" * 40)]
    assert [x.tolist() for x in encoder.encode(texts)] == [x.tolist() for x in encoder.whole(texts)]


def test_texts_are_cut_where_pre_tokens_end(monkeypatch):
    """Parts of any size give the ids of the whole text, also where tabs, returns, digits and signs are all that divide words."""
    encoder, rng = Encoder(default_vocabulary()), random.Random(31)
    made = ["ab", "it's", "we'll", "'s", "''t", "x'", "12", "7", "!", "?!", "é", "ß's", "\t", "\r\n", "\n", " ", "  ", "a'b", "'", "<", "{\"k\":1}", "I'M"]
    texts = ["".join(rng.choice(made) for _ in range(400)).encode() for _ in range(30)] + ["".join(rng.choice([*made, "漢字", "ж", "<|x|>"]) for _ in range(400)).encode() for _ in range(10)] + [b"q" * 900, b"!" * 700, b"a" * 300 + b"\t" + b"b" * 300]
    want = [x.tolist() for x in encoder.whole(texts)]
    for size in (16, 64, 257):
        monkeypatch.setattr(pretokens, "PART_BYTES", size)
        monkeypatch.setattr(pretokens, "STEP", 8)
        assert max(map(len, pretokens.cut_up(texts[0]))) <= size and b"".join(pretokens.cut_up(texts[0])) == texts[0]
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == want[texts.index(t)], (size, t)


def test_one_line_of_distinct_words_ends():
    """A line without a blank, of more distinct words than the table has slots."""
    text = b"\t".join(b"%x" % (i * 2654435761 % 2**32) for i in range(1_500_000))
    text = text.translate(bytes(range(48)) + bytes(range(103, 113)) + bytes(range(58, 256)))  # digits would be words of their own
    began = time.time()
    encoder = Encoder(default_vocabulary())
    ids = encoder.encode([text])[0]
    assert time.time() - began < 90 and len(text) > 12_000_000
    head = text[: text.index(b"\t", 200_000)]
    assert ids[: len(encoder.whole([head])[0])].tolist() == encoder.whole([head])[0].tolist()


def test_more_distinct_words_than_slots():
    """A text with more distinct words than the encoder remembers at a time ends, with the tokenizer's ids."""
    encoder = Encoder(default_vocabulary())
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}{'qxz'[i // 456976 % 3]}" for i in range(1_300_000)]
    text = " ".join(words).encode()
    ids = encoder.encode([text, b"abc"])
    assert len(text) > 3 * pretokens.PART_BYTES and ids[0].tolist() == encoder.whole([text])[0].tolist() and len(ids[1])


def test_licenses(spark, docs, empty):
    out = {r.doc_id: r.licenses for r in scan_licenses(spark, docs).collect()}
    assert out[12] == ["MIT"] and all(not x for i, x in out.items() if i != 12) and scan_licenses(spark, empty).count() == 0
    t = Templates(TEMPLATES)
    for name, statements in TEMPLATES.items():
        assert {h[0] for h in scan_blocks(("x\n" + statements[0] + "\ny").encode(), t)[1]} == {name}
    assert not scan_blocks(b"A licence to be different, granted by none.", t)[1]


def test_license_in_longer_text():
    t, rng = Templates(TEMPLATES), random.Random(8)
    mit = "This package is released under the MIT License and is maintained by volunteers who answer questions on the list in their free time"
    for text, name in ((mit, "MIT"), (f"{prose(rng, 300)} {TEMPLATES['GPL-3.0'][1]} {prose(rng, 300)}", "GPL-3.0")):
        hits = scan_blocks(text.encode(), t)[1]
        assert {h[0] for h in hits} == {name} and all(h[1] > 0.3 for h in hits)


def test_wrapped_and_changed_licenses():
    t, rng = Templates(TEMPLATES), random.Random(9)
    for name, statements in TEMPLATES.items():
        for text in statements:
            for mark in ("", "# ", " * ", "// "):
                wrapped = "\n".join(mark + x for x in textwrap.wrap(text, 40))
                hits = scan_blocks(f"{prose(rng, 80)}\n{wrapped}\n{prose(rng, 80)}".encode(), t)[1]
                assert [(h[0], h[2], h[3]) for h in hits] == [(name, 0, h[3]) for h in hits[:1]] and wrapped.removeprefix(mark).startswith(hits[0][3][:20])
    gpl = TEMPLATES["GPL-3.0"][1]
    changed = gpl.replace("This program is", "Foo and bar are").replace("either ", "").replace("and/or modify", "and modify", 1)
    for text, name, n in ((changed, "GPL-3.0", 5), ("Distributed under the MIT Licence.", "MIT", 1), ("Licensed under the Apache License 2.0", "Apache-2.0", 1)):
        assert [(h[0], h[2]) for h in scan_blocks(f"x {text} y".encode(), t)[1]] == [(name, n)]
    assert [h[0] for h in scan_blocks(gpl.replace("GNU General", "GNU Lesser General").encode(), t)[1]] == ["LGPL-3.0"]
    assert [h[0] for h in scan_blocks(b"Licensed under CC BY-ND 4.0.", t)[1]] == ["CC-BY-ND-4.0"]
    for other in (gpl.replace("GNU General", "GNU Library General"), gpl.replace("version 3", "version 1"), "Licensed under CC BY-ND 5.0.", "Released under the BSD License.", "This work is not licensed under the GNU General Public License, version 3."):
        assert not scan_blocks(other.encode(), t)[1]
    both = f"{TEMPLATES['MIT'][0]} {TEMPLATES['Apache-2.0'][1]}\n" * 3
    assert [h[0] for h in scan_blocks(both.encode(), t)[1]] == ["MIT", "Apache-2.0"] * 3


def test_paragraphs_and_identifiers():
    """Second paragraphs, families that differ by a word or a version, identifiers and mentions; other licenses aren't taken for them."""
    t, rng = Templates(TEMPLATES), random.Random(12)
    texts = {
        "The above copyright notice and this permission notice shall be included in all\n copies or substantial portions of the Software.": ["MIT"],
        "This project uses the MIT License.": ["MIT"],
        "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"],
        "# SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"],
        "SPDX-License-Identifier: LGPL-2.1": ["LGPL-2.1"],
        "SPDX-License-Identifier: SomethingElse-1.0": [],
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": ["CC-BY-3.0"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
        TEMPLATES["LGPL-2.1"][0]: ["LGPL-2.1"],
        TEMPLATES["LGPL-2.1"][0].replace("2.1", "2"): [],
        TEMPLATES["AGPL-3.0"][0]: ["AGPL-3.0"],
        TEMPLATES["ISC"][0]: ["ISC"],
        "See the License for the specific language governing permissions and limitations under the License.": ["Apache-2.0"],
        " ".join(TEMPLATES["BSD"][:2]) + " " + TEMPLATES["BSD-2-Clause"][1]: ["BSD", "BSD-2-Clause"],
        TEMPLATES["BSD"][0] + " " + TEMPLATES["BSD-3-Clause"][1]: ["BSD", "BSD-3-Clause"],
        "The software is provided for review, and the author disclaims nothing.": [],
        "Permission to use the pool is granted to members.": [],
    }
    for text, names in texts.items():
        for around in ("", prose(rng, 60)):
            assert sorted({h[0] for h in scan_blocks(f"{around} {text} {around}".encode(), t)[1]}) == names, text


def test_rights_notices():
    t, rng = Templates(TEMPLATES), random.Random(10)
    notices = {
        "All rights reserved.": ["All-Rights-Reserved"],
        "Copyright (C) 2019-2024 Jane Doe. All rights\n# reserved.": ["Copyright", "All-Rights-Reserved"],
        "© 2021 Jane Doe": ["Copyright"],
        "Copyright © Jane Doe": ["Copyright"],
        "copyright 1999, Jane Doe": ["Copyright"],
        "This file is in the\npublic domain.": ["Public-Domain"],
        "Licensed under CC0 1.0": ["CC0-1.0"],
        "This work is not in the public domain.": [],
        "A lawyer explains copyright and the rights of readers.": [],
    }
    for text, names in notices.items():
        assert [h[0] for h in scan_blocks(f"{prose(rng, 80)}\n{text}\n{prose(rng, 80)}".encode(), t)[1]] == names, text


def test_quality(spark, empty):
    rng = random.Random(6)
    good = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(12)), "x") for i in range(300)]
    toxic = [(300 + i, good[i][1].replace(". ", " vile. ", 1), "x") for i in range(60)]
    bad = [(360 + i, " | ".join(prose(rng, 60).upper().split()), "x") for i in range(60)]
    docs = spark.createDataFrame([*good, *toxic, *bad, (500, None, "x"), (None, "", "x")], "doc_id long, text string, good string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 360), int(300 <= i < 360)) for i in range(420)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in score_quality(spark, docs, labels).collect()}
    assert len(out) == 422 and not out[500].kept and not out[None].kept
    assert sum(out[i].kept for i in range(300)) >= 297 and not any(out[i].kept for i in range(360, 420)) and sum(out[i].kept for i in range(300, 360)) == 0
    assert score_quality(spark, empty, labels).count() == 0
    unlabelled = score_quality(spark, docs, labels.where("false"))
    assert unlabelled.where("kept").count() == 420
    drawn = gumbel_top_k(unlabelled, 0.25).collect()
    keys = sorted((r.gumbel_key for r in drawn if r.gumbel_key is not None), reverse=True)
    assert {r.gumbel_key for r in drawn if r.selected} == set(keys[: len([r for r in drawn if r.selected])]) and abs(sum(bool(r.selected) for r in drawn) - 105) <= 1


def best_segmentation(word, scores, unknown):
    """(score, pieces) by looking at each split; of equal scores the one with fewer pieces."""
    best = [(0.0, ())]
    for i in range(1, len(word) + 1):
        found = [(best[j][0] + scores[word[j:i]], (*best[j][1], word[j:i])) for j in range(max(0, i - 60), i) if word[j:i] in scores]
        if word[i - 1 : i] not in scores:
            found.append((best[i - 1][0] + unknown, (*best[i - 1][1], None)))
        best.append(max(found, key=lambda f: (f[0], -len(f[1]))))
    return best[-1]


def test_token_counts(spark, docs, rows, empty):
    rng = random.Random(14)
    assert count_tokens(spark, empty).count() == 0
    texts = [r[1] for r in rows if not r[1] or len(r[1]) < 3000] + ["the naïve\tquick brownish fox 日", "".join(rng.choice("etaoin shrdlu") for _ in range(900)).replace(" ", ""), "x" * 300 + " " + "日本" * 40]
    pieces = token_counts.pieces_of(token_counts.default_vocabulary())
    scores = token_counts.rank_scores(len(pieces))
    for rounds in (0, 1, 2):
        if rounds:
            scores = token_counts.estimated(counts)
        known, counts, want = dict(zip(pieces, scores.tolist(), strict=True)), np.zeros(len(pieces)), []
        number = {x: i for i, x in enumerate(pieces)}
        for t in texts:
            found = [best_segmentation(b" " + w.encode(), known, scores.min() - 10) for w in (t or "").split()]
            for _, used in found:
                np.add.at(counts, [number[x] for x in used if x], 1)
            want.append((len(found), sum(len(u) for _, u in found), sum(s for s, _ in found)))
        some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = sorted(count_tokens(spark, some, rounds=rounds).collect())
        assert [(r.n_words, r.n_tokens) for r in got] == [w[:2] for w in want]
        assert np.allclose([r.log_prob for r in got], [w[2] for w in want])
    assert count_tokens(spark, docs).count() == 17


def test_token_counts_of_a_long_run():
    rng = np.random.default_rng(1)
    long = bytes(rng.integers(97, 123, 1 << 20).astype(np.uint8))
    pieces = token_counts.pieces_of(token_counts.default_vocabulary())
    model = token_counts.Pieces(pieces, token_counts.rank_scores(len(pieces)))
    began = time.time()
    words, tokens, scores, used = token_counts.count_block([long, b"a word", long[:200]], model)
    assert time.time() - began < 30 and words.tolist() == [1, 2, 1] and tokens[0] > 1 << 17
    assert tokens[2] == len(best_segmentation(b" " + long[:200], dict(zip(pieces, model.scores.tolist(), strict=True)), model.unknown)[1])


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == docs.columns, name
        docs = Scratch(spark).put(after)
    assert docs.count() > 100 and corpus_pipeline.run(spark, d).select("doc_id").distinct().count() == docs.count()
