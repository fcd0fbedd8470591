"""The stored index: segments, views, plans without shuffles, pages by ranges; the algebra that carries labels."""

import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index, snippets, virtual
from corpusloom.operators import intervals as I
from corpusloom.operators.constraints import ConstraintError, constrained
from corpusloom.plans.query import QueryError, Searcher, parse
from corpusloom.plans.service import ask, matches, page_of
from corpusloom.sources import tokens as T
from corpusloom.streaming.indexing import index_stream

WORDS = "a b c d e f g h".split()


def got(df):
    return {tuple(r) for r in df.select("doc_id", "l", "r").collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def minimal(found):
    return {a for a in found if not any(b != a and b[0] == a[0] and b[1] >= a[1] and b[2] <= a[2] for b in found)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = {i: [rng.choice(WORDS) + "." * (rng.random() < 0.15) for _ in range(rng.randrange(25))] for i in range(900)}
    for i in (5, 411, 412, 800):
        out[i] = ["rare", "a", *out[i], "b"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")


@pytest.fixture(scope="module")
def path(docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index") / "i")
    index.write_index(T.plain_documents(docs), out, ["token", "lower"])
    return out


@pytest.fixture(scope="module")
def stored(spark, path):
    return index.StoredIndex(spark, path)


def test_documents_as_arrays_are_the_token_rows(spark, docs):
    rows = T.with_sentences(T.plain_tokens(docs))
    arrays = T.plain_documents(docs.union(spark.createDataFrame([(1000, None), (1001, " \n ")], docs.schema)))
    assert {r.doc_id for r in arrays.where("size(token) = 0").collect()} >= {1000, 1001}
    want = {tuple(r) for r in rows.select("doc_id", "pos", "token", "lower", F.col("sen_no").cast("long")).collect()}
    assert {tuple(r) for r in index.token_rows(arrays, ["token", "lower", "sen_no"]).collect()} == want


@pytest.mark.parametrize("query", ["a b", "(a | b)", '"a b"', "a < b", "(a b)~3", "(a < b) - c", "(a < b) - _SENT_", "a !b", "!a", "(a < c) > b", "b @ (a < c)", '"a .. b"', '"a .1. b .0-2. c"', "rare a", "a < rare", '"rare a"', "(rare b) - c", "ra*", "(rare | c) a"])
def test_the_index_finds_what_token_rows_have(stored, docs, query):
    assert got(Searcher(stored).search(query, "lower")) == got(Searcher(T.with_sentences(T.plain_tokens(docs))).search(query, "lower"))


@pytest.mark.parametrize(("query", "test"), [('"a .. b"', (0, 4)), ('"a .2. b"', (0, 2)), ('"a .1-3. b"', (1, 3))])
def test_gaps_against_brute_force(stored, texts, query, test):
    low, high = test
    want = {(d, i, j) for d, w in texts.items() for i in range(len(w)) for j in range(i + 1 + low, min(len(w), i + high + 2)) if w[i] == "a" and w[j] == "b"}
    assert got(Searcher(stored).search(query)) == minimal(want)


def test_interval_operators_against_brute_force(spark):
    """Holding, lying in and gapped phrases on 20,000 made cases."""
    rng = random.Random(2)
    sides, words, n = ([], []), [], 20_000
    for d in range(n):
        for side in sides:
            side += minimal({(d, l, l + rng.randrange(5)) for l in rng.sample(range(10), rng.randrange(4))})
        words += [(d, p, rng.randrange(3)) for p in range(rng.randrange(8))]
    a, b = (spark.createDataFrame(x, "doc_id long, l int, r int") for x in sides)
    by = {}
    for d, l, r in sides[1]:
        by.setdefault(d, []).append((l, r))
    assert got(I.holding(a, b)) == {x for x in sides[0] if any(x[1] <= l and r <= x[2] for l, r in by.get(x[0], ()))}
    assert got(I.inside(a, b)) == {x for x in sides[0] if any(l <= x[1] and x[2] <= r for l, r in by.get(x[0], ()))}
    assert got(I.difference(a, b)) == {x for x in sides[0] if not any(x[1] <= l and r <= x[2] for l, r in by.get(x[0], ()))}
    gaps = [(0, 0), (0, 2), (1, 3)]
    places = {}
    for d, p, k in words:
        places.setdefault(d, ([], [], []))[k].append(p)
    found = {(d, x, z) for d, (p, q, r) in places.items() for x, y, z in itertools.product(p, q, r) if 0 <= y - x - 1 <= 2 and 1 <= z - y - 1 <= 3}
    by_doc = {}
    for x in found:
        by_doc.setdefault(x[0], set()).add(x)
    hits = spark.createDataFrame(words, "doc_id long, pos int, k int")
    assert got(I.gapped(hits, gaps)) == set().union(*(minimal(x) for x in by_doc.values()))


def test_searches_and_documents_are_never_shuffled(spark, stored):
    """Rows come in buckets of documents' ranges: one scan, windows and aggregates without an exchange before the result."""
    for query in ("a", '"a b"', "a b", "(a b)~4", "a < b", "a - _SENT_", "a - b", "a ^ token:a"):
        plan = plan_of(Searcher(stored).search(query, "lower"))
        assert "Exchange" not in plan and plan.count("FileScan") == 1, query
    plan = plan_of(Searcher(stored).search("(a < b) - _SENT_", "lower"))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 2  # intervals made of intervals are dealt anew
    plans = [constrained(Searcher(stored).matches("1:a < 2:b", "lower", marks=True), stored, "1.token = 2.token"), snippets.plain_snippets(Searcher(stored).search("a < b", "lower"), stored)]
    for plan in map(plan_of, plans):
        assert plan.count("/documents]") == 1 and plan.count("/postings]") == 1, plan  # each table is read once
        above = plan[: plan.index("/documents]")].splitlines()
        depth = re.search(r"\S", above[-1].replace("|", " ").replace(":", " ")).start()
        path = []
        for line in reversed(above):
            at = re.search(r"\S", line.replace("|", " ").replace(":", " ")).start()
            if at < depth:
                path.append(line)
                depth = at
        join = next(i for i, line in enumerate(path) if "Join" in line)
        assert not any("hashpartitioning" in line for line in path[:join]), plan


def test_the_rarest_word_leads(spark, stored, docs):
    s = Searcher(stored)
    led = s.led(parse("(rare a)~5", "lower"))
    word = F.expr("field = 'lower' and term = 'a'")
    blocks, all_blocks = led.source.blocks(word), stored.blocks(word)
    assert led is not s and 0 < blocks.count() <= 4 < all_blocks.count() / 20
    plan = plan_of(s.search("(rare a)~5", "lower"))
    assert re.search(r"SelectedBucketsCount: [1-4] out of 8", plan) and "In(part" in plan
    assert s.led(parse("a b", "lower")) is s and s.led(parse("(rare | a) b", "lower")) is s
    named = Searcher.NAMED
    try:
        Searcher.NAMED = 0  # a semi join of blocks instead of names
        joined = s.led(parse("(rare a)~5", "lower"))
        assert joined.source.blocks(word).count() == blocks.count()
        assert got(s.search("(rare a)~5", "lower")) == got(Searcher(T.plain_tokens(docs)).search("(rare a)~5", "lower"))
    finally:
        Searcher.NAMED = named


def test_segments(spark, docs, texts, tmp_path):
    """Documents in three batches are found like those of one; a batch leaves what is there alone; merging changes no result."""
    path, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    batch = lambda a, b: T.plain_documents(docs.where(F.col("doc_id").between(a, b)))
    index.write_index(batch(0, 600), path, ["token", "lower"])
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}
    size = lambda: sum(map(os.path.getsize, files()))
    before, bytes_before = files(), size()
    index.append_documents(batch(601, 609), path)
    assert before.items() <= files().items() and size() - bytes_before < 0.5 * bytes_before  # nine documents: mostly what empty files need
    index.append_documents(batch(610, 899), path)
    index.write_index(T.plain_documents(docs), whole, ["token", "lower"])
    one, many = index.StoredIndex(spark, whole), index.StoredIndex(spark, path)
    rows = lambda df: sorted(map(tuple, df.collect()))

    def same(x, y):
        assert len(y.tables) in (1, 3) and rows(x.terms) == rows(y.terms.select(x.terms.columns)) and rows(x.fields) == rows(y.fields.select(x.fields.columns))
        for query in ("a b", '"a b c"', "(rare b)~9", "!a", "(a < b) - _SENT_"):
            assert got(Searcher(x).search(query, "lower")) == got(Searcher(y).search(query, "lower")), query
        request = {"query": "lower:a < lower:b", "snippets": 30, "offset": 595}
        assert got(page_of(x, request)[0]) == got(page_of(y, request)[0])

    same(one, many)
    index.merge_segments(spark, path)
    merged = index.StoredIndex(spark, path)
    assert len(merged.tables) == 1 and len(many.tables) == 3
    same(one, merged)
    same(one, many)  # still readable by who has it open
    index.merge_segments(spark, path)
    assert len(index._versions(spark, path)) == 4


@pytest.mark.parametrize(("snippets_", "offset"), [(0, 0), (0, 300), (7, 0), (120, 40), (-1, 2), (5000, 0), (10, 100_000)])
def test_pages_by_ranges(stored, snippets_, offset):
    found = Searcher(stored).matches("a < b", "lower")
    seen = []

    def evaluate(view):
        seen.append(view)
        return Searcher(view).matches("a < b", "lower")

    by, view = snippets.page_by_ranges(stored, evaluate, 400, snippets_, offset)
    assert got(by) == got(snippets.page(found, snippets_, offset))
    assert got(Searcher(view).matches("a < b", "lower")) == got(by) or not got(by)
    if offset == 0 and snippets_ <= 7:
        assert len(seen) == 2  # the first range holds the page, which is then read alone


def test_a_tie_of_labels_and_own_matches(spark, docs, stored, texts):
    """Labels are those of the atoms an interval is made of; other places of the same word inside it don't count."""
    query = "1:a < (c | 2:b)"
    out = got(constrained(Searcher(stored).matches(query, "lower", marks=True), stored, "2.token = b"))
    assert out == {x for x in got(Searcher(stored).search(query, "lower")) if texts[x[0]][x[2]] == "b"}
    rows = spark.createDataFrame([(1, p, w) for p, w in enumerate("x b b c".split())], "doc_id long, pos int, token string")
    s = Searcher(rows.withColumn("pos", F.col("pos").cast("int")))
    found = s.matches("x 2:b c", marks=True).collect()
    assert [(r.l, r.r, [tuple(m) for m in r.marks]) for r in found] == [(0, 3, [(2, 2)])]  # the latest b, not both
    with pytest.raises(QueryError, match="no labels"):
        Searcher(stored).matches("a b", marks=True)
    with pytest.raises(ConstraintError, match="no field"):
        constrained(Searcher(stored).matches("1:a", marks=True), stored, "1.nosuch = b")
    assert matches(stored, {"query": "1:token:a 2:token:b", "constraint": "3.token = a"}).count() == 0
    assert matches(stored, {"query": "1:token:a 2:token:b", "constraint": "3.token = a or 1.token = a"}).count() > 0


def test_more_that_queries_refuse_and_read():
    for bad in ('person.name:"a b"', '"a .. "', '".. a"', '"a .. .. b"', '"a .3-1. b"', "a > _SENT_", "{{a->b}}", "person.name:(a < b)"):
        with pytest.raises(QueryError):
            tree = parse(bad)
            Searcher.plan(Searcher.__new__(Searcher), tree) if tree.kind == "holding" else None
    assert parse('person.name:"a"').kind == "aligned" and parse("person.name:(a | b)").parts[0].kind == "or"
    assert parse("a {{lower->token}} b").parts[1].parts[0].field == "lower"
    assert parse('"a .. b"').gaps == [(0, 0), (0, 4)] and parse('"a .2. b .1-3. c"').gaps == [(0, 0), (0, 2), (1, 3)]
    assert parse("semi-longbow").value == "semi-longbow" and parse("a@b").value == "a@b"


def test_ranges(spark, tmp_path):
    """Whole numbers and days by value, not by text; what is neither is in no range."""
    cells = ["7", "-3", "10", "1999", "+12", "x7", "2001-02-28", "2001-02-30", "1999-12-31", "0", "9|2000-01-01", "12345678901234567890"]
    rows = [(d, p, cells[(d + p) % len(cells)]) for d in range(300) for p in range(5)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, year string")
    index.write_index(tokens, str(tmp_path / "i"), ["year"])
    stored = index.StoredIndex(spark, str(tmp_path / "i"))
    day = lambda x: re.fullmatch(r"\d{4}-\d\d-\d\d", x) and x != "2001-02-30"
    number = lambda x: re.fullmatch(r"[+-]?\d{1,18}", x)
    for query, test in (("[0..10]", lambda x: number(x) and 0 <= int(x) <= 10), ("[-5..-1]", lambda x: number(x) and -5 <= int(x) <= -1), ("[11..]", lambda x: number(x) and int(x) >= 11), ("[..2000-06-01]", lambda x: day(x) and x <= "2000-06-01"), ("[2000-01-01..2001-12-31]", lambda x: day(x) and "2000-01-01" <= x <= "2001-12-31")):
        want = {(d, p, p) for d, p, c in rows if any(test(x) for x in c.split("|"))}
        assert got(Searcher(stored).search(query, "year")) == want == got(Searcher(tokens, multi=True).search(query, "year")), query
    plan = plan_of(Searcher(stored).search("[11..50]", "year"))
    assert re.search(r"value#\d+L >= 11\b.*value#\d+L <= 50\b", plan) and "PushedFilters: [IsNotNull(field)" in plan and "Exchange" not in plan
    assert got(Searcher(stored).search("([0..10] 1:[2000-01-01..])~2", "year"))
    for bad in ("[a..b]", "[..]", "[1..2001-01-01]", "year:[1..x]"):
        with pytest.raises(QueryError):
            parse(bad, "year")


def test_streams_of_documents_become_segments(spark, docs, tmp_path):
    """Batches of a stream are added as segments, each once, also where a batch comes again; the index equals one built whole."""
    source, path = str(tmp_path / "in"), str(tmp_path / "stream")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        query = index_stream(stream, path, ["token", "lower"], T.plain_documents).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        many = index.StoredIndex(spark, path)
        assert len(many.tables) == 3 and many.size == index.documents_with_words(T.plain_documents(docs)).count()
    index.append_documents(docs.where("doc_id % 3 = 1"), path, T.plain_documents, batch=1)
    assert len(index.StoredIndex(spark, path).tables) == 3
    index.write_index(docs, str(tmp_path / "whole"), ["token", "lower"], make=T.plain_documents)
    one = index.StoredIndex(spark, str(tmp_path / "whole"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one.terms) == rows(many.terms.select(one.terms.columns))
    for query in ("a b", "(rare b)~9", "(a < b) - _SENT_"):
        assert got(Searcher(one).search(query, "lower")) == got(Searcher(many).search(query, "lower")), query
    index.merge_segments(spark, path)
    index.append_documents(docs.where("doc_id % 3 = 1"), path, T.plain_documents, batch=1)
    assert len(index.StoredIndex(spark, path).tables) == 1  # what was merged is still known


def test_virtual_documents(spark, tmp_path):
    """Links as their pages resolve them; a target of very many links lies in many lots."""
    base = "http://a.b/c/d?x#y"
    cases = {"/p": "http://a.b/p", "p": "http://a.b/c/p", "//h/p": "http://h/p", "https://z/q#f": "https://z/q", "#f": None, "": None, "?q": "http://a.b/c/?q"}
    df = spark.createDataFrame([(h, base) for h in cases] + [("p", "http://a.b")], "h string, b string")
    got_ = [r[0] for r in df.select(virtual.resolved(F.col("h"), F.col("b"))).collect()]
    assert got_ == [*cases.values(), "http://a.b/p"]
    link = lambda i: f'<A class="x" href="{"/hot" if i % 3 else f"/t{i}"}"><b>Word{i % 5}</b> and\n more</a><a href="/none"> </a><a name="q">lost</a>'
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{link(i)}{link(i)}</p>") for i in range(3000)] + [(9000, None, None), (9001, "http://h/", "")], "page_id long, url string, html string").repartition(4)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    found = virtual.virtual_postings(spark, pages, str(tmp_path / "lots"), 10).collect()
    spark.conf.unset(setting)
    hot = sorted((r.page_id, r.positions) for r in found if r.target == "http://h/hot" and r.term == "and")
    assert hot == [(i, [26 * k + 1, 26 * k + 14]) for k, i in enumerate(i for i in range(3000) if i % 3)]
    assert {r.target for r in found} == {"http://h/hot", *(f"http://h/t{i}" for i in range(0, 3000, 3))} and {r.term for r in found} == {"and", "more", *(f"word{i}" for i in range(5))}
    assert spark.read.parquet(str(tmp_path / "lots")).where("target = 'http://h/hot'").select("lot").distinct().count() > 1


def test_answers_and_errors(stored):
    about = stored.documents.select("doc_id", F.lit("t").alias("title"))
    both = {"x": (stored, about), "y": (stored.where(F.col("doc_id") % 2 == 0), about)}
    out = ask(both, {"query": "lower:a < lower:b", "snippets": 9})
    assert out["error"] == "" and int(out["total"]) >= 9 and set(out["offset"]) == {"x", "y"} and out["offset"]["x"] > 0 and out["hostname"] and int(out["time"]) > 0
    assert {int(r["doc"]) % 2 for r in out["results"] if r["thread"] == "y"} == {0}
    bad = ask(both, {"query": "(a", "snippets": 9})
    assert bad["error"] == "query" and bad["results"] == [] and "time" in bad
