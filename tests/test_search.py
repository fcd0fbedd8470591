import gzip
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.entities import FIELDS
from corpusloom.functions.sexpr import compile_expression
from corpusloom.operators import index, snippets
from corpusloom.operators import intervals as I
from corpusloom.operators.constraints import ConstraintError, condition, constrained, parse
from corpusloom.plans.query import QueryError, Searcher
from corpusloom.plans.query import parse as parse_query
from corpusloom.plans import console
from corpusloom.plans.service import ask, respond, search_all
from corpusloom.plans.settings import Settings, client_settings, read_cursor, read_hosts, read_settings, write_cursor, write_settings
from corpusloom.sources import tokens as T
from corpusloom.streaming.counts import stream_term_counts


def minimal(found):
    return {a for a in found if not any(b != a and b[0] == a[0] and b[1] >= a[1] and b[2] <= a[2] for b in found)}


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(3)
    out = []
    for _ in range(3):
        out.append(minimal({(d, l, l + rng.randrange(3)) for d in range(40) for l in rng.sample(range(14), rng.randrange(5))}))
    return out


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows), "doc_id long, l int, r int")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def got(df):
    return {tuple(r) for r in df.select("doc_id", "l", "r").collect()}


def test_interval_algebra_against_brute_force(spark, lists):
    a, b, c = lists
    fa, fb, fc = (frame(spark, x) for x in lists)
    assert got(I.any_of(fa, fb)) == minimal(a | b)
    want = {(x[0], min(x[1], y[1], z[1]), max(x[2], y[2], z[2])) for x, y, z in itertools.product(a, b, c) if x[0] == y[0] == z[0]}
    assert got(I.all_of(fa, fb, fc)) == minimal(want)
    assert got(I.ordered(fa, fb)) == minimal({(x[0], x[1], y[2]) for x in a for y in b if x[0] == y[0] and x[2] < y[1]})
    assert got(I.difference(fa, fb)) == {x for x in a if not any(x[0] == y[0] and x[1] <= y[1] and y[2] <= x[2] for y in b)}
    assert got(I.aligned(fa, fb)) == a & b
    assert got(I.within(fa, 2)) == {x for x in a if x[2] - x[1] < 2}


def test_queries_read_and_refuse():
    assert parse_query("a b | c").kind == "or"
    assert parse_query("a < b < c").kind == "ordered"
    assert parse_query('1:nertag:person "x y"~3').kind == "and"
    assert parse_query("semi-longbow").value == "semi-longbow"
    assert parse_query("person.name:Hill").parts[0].field == "param2"
    for bad in ("", "(a", "a ~b", "a )", '""', "person.size:1"):
        with pytest.raises(QueryError):
            parse_query(bad)


def cells(**given):
    return "\t".join(given.get(f, "0") for f in FIELDS)


@pytest.fixture(scope="module")
def vertical(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vertical")
    rows = ["FILENAME\tx", "header", "%%#DOC\tid-1", "%%#PAGE A title\thttp://x/y z", cells(token="Head", lower="head"), "%%#PAR 1 wx1", "%%#SEN 1 wx1"]
    rows += [cells(token="Howard", lower="howard", lemma="how", nerid="e:12"), cells(token="Hill|G__", lower="hill", lemma="hill", nerid="e:12", nertag="person", param2="Howard_Hill", param3="M", param8="archer|actor", nerlength="2"), cells(token="saw", lower="saw"), "%%#SEN 2 wx2", cells(token="Rome", lower="rome", nerid="e:99", nertag="location", param2="Rome", nerlength="1"), "%%#DOC\tid-2"]
    (path / "a.vert").write_text("\n".join(rows))
    with gzip.open(path / "b.vert.gz", "wt") as f:
        f.write("\n".join(["%%#DOC\tid-3", "%%#SEN 1 wx1", cells(token="Rome", lower="rome")]))
    return T.vertical_lines(spark, str(path)).cache()


def test_vertical_positions_and_documents(vertical):
    tokens = T.vertical_tokens(vertical)
    assert [(r.pos, r.token) for r in tokens.where("doc_id = 0").orderBy("pos").collect()] == [(0, "Head"), (1, "§"), (2, "¶"), (3, "Howard"), (4, "Hill|G__"), (5, "saw"), (6, "¶"), (7, "Rome")]
    found = T.vertical_documents(vertical).orderBy("doc_id").collect()
    assert [(r.uuid, r.title) for r in found] == [("id-1", "A title"), ("id-2", "Unknown"), ("id-3", "Unknown")]
    assert found[0].uri == "http%3A%2F%2Fx%2Fy+z"
    assert T.sentences_as_documents(tokens).groupBy("doc_id").count().orderBy("doc_id").collect()[0]["count"] == 3


def test_vertical_files_in_splits(spark, tmp_path):
    """Documents are numbered in order of files and rows, wherever the splits of a file begin."""
    for name, n in (("a", 40), ("b", 1), ("c", 25)):
        rows = ["head"] + [x for i in range(n) for x in (f"%%#DOC\t{name}{i}", "%%#SEN 1 wx1", cells(token="t" * (i % 7 + 1)))]
        written(tmp_path / f"{name}.vert", "\n".join(rows) + "\n")
    want = [f"{name}{i}" for name, n in (("a", 40), ("b", 1), ("c", 25)) for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", "97b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = T.vertical_documents(T.vertical_lines(spark, str(tmp_path))).orderBy("doc_id").collect()
            assert [(r.doc_id, r.uuid) for r in found] == list(enumerate(want)), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_search_render_and_constrain(spark, vertical):
    tokens = T.vertical_tokens(vertical).cache()
    s = Searcher(tokens, multi=True)
    assert got(s.search('"Howard Hill"')) == {(0, 3, 4)}
    assert got(s.search("person.name:Howard_Hill")) == {(0, 4, 4)}
    assert got(s.search("(Hill Rome) - _SENT_")) == set()
    assert got(s.search("(Hill saw) - _SENT_")) == {(0, 4, 5)}
    query = "1:nertag:person 2:nertag:location"
    found, source = s.search(query), s.source
    marked = s.matches(query, marks=True)
    assert got(constrained(marked, source, "1.nerid != 2.nerid and 1.person.profession = actor")) == {(0, 4, 7)}
    assert got(constrained(marked, source, "1.nerlength <= 1")) == set()
    html = snippets.rendered(found, source, 2).first().snippet
    assert ">Howard Hill</a>" in html and 'data-gender="male"' in html and 'data-profession="archer, actor"' in html
    assert snippets.rendered(found, source, 0, "ascii", {"person": ["gender"]}).first().snippet.startswith('\x1b[34m<person gender="male">Hill</person>\x1b[0m')
    shown = snippets.rendered(found, source, 2, "raw", {"person": ["lemma", "nertag"]}, ["param2"], "lower").first().snippet
    assert '<person lemma="how hill" nertag="person"><field name="">howard</field> <field name="Howard_Hill">hill</field></person>' in shown and '<field param2="">saw</field>' in shown
    assert "<person" in snippets.rendered(found, source, 2, "raw", {"person": ["name"]}).first().snippet
    documents = T.vertical_documents(vertical)
    out = respond(tokens, documents, {"query": "rome | Rome", "snippets": 5}, True)
    assert out["documents"] == "2" and out["results"][0]["title"] == "A title"
    assert respond(tokens, documents, {"query": "(", "snippets": 5}, True)["error"] == "query"
    assert respond(tokens, documents, {"get": 0}, True)["results"][0]["data"][0] == "Head"
    assert respond(tokens, documents, {"query": "Hill", "field": "lower"}, True)["results"][0]["data"][0].count("hill</a>") == 1
    assert respond(tokens, documents, {"get": 0}, True)["results"][0]["title"] == "A title"
    both = {"x": (tokens, documents), "y": (tokens, documents)}
    assert search_all(both, {"query": "saw"}, True).count() == 2
    assert search_all(both, {"query": "rome | Rome", "snippets": 2, "cursor": {"y": 1}}, True).collect()[0].doc_id == 2
    out = ask(both, {"query": "rome | Rome", "snippets": 3}, True)
    assert out["received"] == {"x": 2, "y": 2} and [(r["thread"], r["doc"]) for r in out["results"]] == [("x", "0"), ("x", "2"), ("y", "0"), ("y", "2")]
    assert ask(both, {"get": 0, "thread": "y"}, True)["results"][0]["data"][0] == "Head"


def test_settings_reach_queries_constraints_and_snippets(spark, vertical):
    """Properties, expressions, colours and merged attributes of a collection's settings, in place of the usual ones."""
    tokens, documents = T.vertical_tokens(vertical).cache(), T.vertical_documents(vertical)
    own = Settings(mapping={"person": {"fullname": "param2", "sex": "param3"}, "location": {"name": "param2"}}, expressions={"person": {"data-who": '(concatenate "Mr " param2)', "data-lost": "(concatenate param9 param2)"}}, style="raw", entityExpressions={}, tokenExpressions={"data-lemma": "lemma"}, nonDuplicateFields=("lemma",), dye={"person": "Red"})
    out = respond(tokens, documents, {"query": "person.sex:M"}, True, own)["results"][0]["data"][0]
    assert '<person lemma="hill" who="Mr Howard_Hill" lost="<error: concatenate: NIL is no string>">Howard Hill</person>' in out
    assert respond(tokens, documents, {"query": "person.gender:M"}, True, own)["error"] == "query"
    assert respond(tokens, documents, {"query": "1:nertag:person 2:nertag:location", "constraint": "1.person.sex = M"}, True, own)["total"] == "1"
    assert respond(tokens, documents, {"query": "1:nertag:person", "constraint": "1.person.gender = M"}, True, own)["error"] == "query"
    assert respond(tokens, documents, {"query": "Hill", "style": "ascii"}, True, own)["results"][0]["data"][0].count("\x1b[31m<person") == 1
    assert "person.fullname" in respond(tokens, documents, {"allowedFields": True}, True, own)["allowed"]
    assert ask({"x": (tokens, documents, own), "y": (tokens, documents)}, {"query": "person.sex:M"}, True)["error"] == "query"


def test_sentences_paragraphs_and_long_intervals(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for d in range(20):
        n = 0
        for pos in range(90):
            rows.append((d, pos, rng.choice("abcdefgh") + "." * (rng.random() < 0.2), n))
            n += rows[-1][2].endswith(".")
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, token string, sen_no int").withColumn("par_no", F.floor(F.col("sen_no") / 2))
    s, part = Searcher(tokens), {(d, p): n for d, p, _, n in rows}
    found = got(s.search("a < b"))
    assert got(s.search("(a < b) - _SENT_")) == {x for x in found if part[x[0], x[1]] == part[x[0], x[2]]}
    assert got(s.search("(a < b) - _PAR_")) == {x for x in found if part[x[0], x[1]] // 2 == part[x[0], x[2]] // 2}
    long = spark.createDataFrame([(0, d, 0, 89, [(1, p) for x, p, t, _ in rows if x == d and t == "a"]) for d in range(20)], "part int, doc_id long, l int, r int, marks array<struct<label:int,pos:int>>")
    assert constrained(long, s.source, "1.token = a").count() == len({d for d, _, t, _ in rows if t == "a"})


def test_constraint_semantics(spark):
    kind = "m array<struct<label:int,pos:int,f:string>>"
    rows = spark.createDataFrame([([(1, 0, "a|b"), (2, 5, "b"), (2, 6, "7")],)], kind)
    check = lambda text: rows.where(condition(parse(text), F.col("m"))).count() == 1
    assert check("1.f = b") and not check("1.f != b") and check("1.f != c") and check("2.f >= 7") and not check("2.f > 7")
    lone = spark.createDataFrame([([(1, 0, "a"), (2, 0, "a")],)], kind)
    assert lone.where(condition(parse("1.f != 2.f"), F.col("m"))).count() == 1  # no pair at different places
    assert check("1.f = 2.f") and not check("1.f != 2.f") and not check("3.f = a") and check("3.f = a or 1.f = a & 2.f < 8")
    with pytest.raises(ConstraintError):
        parse("1.f = ")


def test_expressions(spark):
    rows = spark.createDataFrame([("M", "a_b", None)], "param3 string, param2 string, param4 string")
    value = lambda text: rows.select(compile_expression(text, lambda n: F.col(n) if n in rows.columns else None)).first()[0]
    assert value('(if (eq param3 "M") "male" "female")') == "male"
    assert value("(subst #\\_ #\\  param2)") == "a b"
    assert value('(concatenate (or param4 "0") "-" param2)') == "0-a_b"
    assert value('(progn (defun twice (x &optional y) (concatenate x x)) (twice "q"))') == "qq"
    assert value("(car (cdr '(\"a\" \"b\")))") == "b"
    assert value('(last \'("a" "b"))') == "b" and value('(first \'("a" "b"))') == "a"
    assert value("(and param3 param4)") is None and value('(or nosuch "d")') == "d"
    assert value("(nosuch 1)").startswith("<error")
    assert value('((lambda (x &rest y) (car y)) "a" "b")') == "b"
    assert value("(list '(1))").startswith("<error") and value('(concatenate "a" nil)').startswith("<error") and value('(or (concatenate "a" nil) "d")') == "d"
    assert value('(eq "a" #\\a)') is None and value('(eq "a" "a")') == "" and value('(eq #\\a #\\a)') == "" and value("(eq param3 #\\M)") is None
    assert value("(subst (car '(#\\_)) #\\- param2)") == "a-b"
    assert value("(cons \"x\" '(\"y\" z))") == "(x y Z)" and value("'()") is None and value("(last '())") is None


def test_errors_and_lists_of_rows(spark):
    """An error is met by a row alone and can be made up for; lists may be made of a field."""
    rows = spark.createDataFrame([(1, "a|b|c", "x"), (2, "", "x"), (3, None, "x"), (4, "d", None)], "id int, f string, g string")
    value = lambda text: [r[0] for r in rows.orderBy("id").select(compile_expression(text, lambda n: F.col(n) if n in ("f", "g") else None)).collect()]
    wrong = "<error: concatenate: NIL is no string>"
    assert value('(concatenate f "-" g)') == ["a|b|c-x", "-x", wrong, wrong]
    assert value('(or (concatenate f g) "d")') == ["a|b|cx", "x", "d", "d"] and value('(and (concatenate f g) "d")') == ["d", "d", None, None]
    assert value('(replace "x" "y" (concatenate f g))') == ["a|b|cy", "y", wrong, wrong]
    assert value('(if f (concatenate f g) "none")') == ["a|b|cx", "x", "none", wrong] and value('(if (concatenate f g) "y" "n")') == ["y", "y", wrong, wrong]
    assert value('(eq (concatenate f g) "x")') == [None, "", wrong, wrong]
    assert value('(car (split "|" f))') == ["a", "", None, "d"] and value('(last (split "|" f))') == ["c", "", None, "d"]
    assert value('(cdr (split "|" f))') == ["(b c)", None, None, None] and value('(car (cdr (split "|" f)))') == ["b", None, None, None]
    assert value('(cons g (split "|" f))') == ["(x a b c)", "(x )", "(x)", "(NIL d)"]
    assert value('(if (atom (cdr (split "|" f))) "one" "more")') == ["more", "one", "one", "one"]
    assert value("(and (setq y f) y)") == ["a|b|c", "", None, "d"] and value("(and f g)") == ["x", "x", None, None]
    walk = '(progn (defun all (xs) (if xs (concatenate (car xs) (all (cdr xs))) "")) (all {}))'
    assert value(walk.format("'(\"p\" \"q\" \"r\")")) == ["pqr"] * 4
    assert value(walk.format('(split "|" f)')) == ["<error: a function calls itself without end>"] * 4
    assert value("(progn (defun f2 (x) (or (f2 x) (f2 x))) (f2 g))") == ["<error: a function calls itself without end>"] * 4


def test_index_and_pages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a|c."), (2, "b"), (3, ""), (4, None)], "doc_id long, text string")
    documents = T.plain_documents(docs)
    assert {r.term: (r.df, r.cf, r.max_count) for r in index.term_stats(documents, "lower").collect()} == {"a": (1, 2, 2), "b": (2, 2, 1), "c.": (1, 1, 1)}
    assert index.index_totals(documents, docs, "lower").first().documents == 4
    path = str(tmp_path / "index")
    index.write_index(documents, path, ["token", "lower"])
    stored = index.StoredIndex(spark, path)
    assert stored.blocks(F.expr("field = 'lower' and term = 'b'")).selectExpr("explode(docs)").count() == 2 and stored.terms.where("field = 'lower' and term = 'a'").first().df == 1
    assert got(Searcher(stored).search("c.", "lower")) == {(1, 2, 2)} and got(Searcher(stored).search('"a b a"', "lower")) == {(1, 0, 2)}
    plan = plan_of(stored.any_hits([("lower", "b", False)]))
    assert "EqualTo(field,lower)" in plan and "EqualTo(term,b)" in plan
    spark.read.parquet(f"{path}/manifest/1").withColumn("documents", F.lit(9).cast("long")).write.parquet(f"{path}/manifest/2")
    with pytest.raises(ValueError):
        index.StoredIndex(spark, path)
    assert [snippets.page_size(n) for n in (-1, 0, 5, 99, 100, 1000)] == [15, 15, 1, 1, 10, 100]
    found = spark.createDataFrame([(d, k, k) for d in range(50) for k in range(3)], "doc_id long, l int, r int")
    assert snippets.page(found, 100).select("doc_id").distinct().count() == 40
    assert snippets.page(found, 0).select("doc_id").distinct().count() == 15
    assert snippets.page(found, 4, 48).count() == 6
    assert snippets.next_cursor({"h": 5}, {"h": 2, "g": 1}, {"h": 3, "g": 3}, {"h": 3, "g": 1}) == {"h": 7}


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = stream_term_counts(stream).writeStream.outputMode("complete").format("memory").queryName("terms").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("terms").collect()} == {("a", 2), ("b", 1)}


def test_entry_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_settings_and_console(spark, tmp_path):
    assert read_hosts(str(written(tmp_path / "hosts", "a\nb:7\n\n"))) == ["a:12000", "b:7"]
    write_settings(str(tmp_path / "s.json"), Settings(style="raw"))
    assert read_settings(str(tmp_path / "s.json")) == Settings(style="raw") and Settings().nonDuplicateFields == ("href", "style", "nertag")
    assert read_settings(str(written(tmp_path / "t.json", '{"field": "lower", "other": 1}'))).field == "lower"
    client = client_settings(str(written(tmp_path / "c.xml", "<x><head><title/><uri/></head><servers><style>raw</style></servers><format><attributes/><nertags><person><name/></person><all/></nertags></format><dye><person>Light gray</person></dye></x>")))
    assert client == {"head": ["title", "uri"], "dye": {"person": "Light gray"}, "format": {"attributes": [], "nertags": {"person": ["name"], "all": ["all"]}}, "style": "raw"}
    write_cursor(str(tmp_path / "cursor"), {"a": 3})
    assert read_cursor(str(tmp_path / "cursor")) == {"a": 3} and read_cursor(str(tmp_path / "none")) == {}
    assert console.painted("<person name='x'>A</person> <personal>", client["dye"]) == "\x1b[37m<person name='x'>A</person>\x1b[0m <personal>"
    assert console.boxed({"title": "T", "uri": "a%20b", "doc": "12"}, ["title", "uri", "host"]) == "----------\n| title: T |\n| uri: a b |\n----------\n".replace("----------", "-" * 12)
    assert list(console.printed({"error": "query", "errorMessage": "bad"})) == ["query: bad"]
    assert console.evaluated(spark, '(concatenate "a" "b")') == "ab" and console.evaluated(spark, "nil") == "NIL"


def written(path, text):
    path.write_text(text)
    return path


def test_collections_from_files_to_answers(spark, tmp_path, capsys):
    rows = [["%%#DOC\tone", "%%#PAGE A title\thttp://x", "%%#PAR 1 wx1", "%%#SEN 1 wx1", cells(token="Rome", lower="rome", nerid="e:99", nertag="location", param2="Rome", nerlength="1"), cells(token="fell", lower="fell")], ["%%#DOC\ttwo", "%%#SEN 1 wx1", cells(token="Rome", lower="rome")]]
    for i, name in enumerate("ab"):
        (tmp_path / "in" / name).mkdir(parents=True)
        written(tmp_path / "in" / name / "x.vert", "\n".join(sum(rows[i:], [])))
        console.main(["index", str(tmp_path / "in" / name), str(tmp_path / "out" / name)])
    found = console.load_collections(spark, str(tmp_path / "out"))
    assert sorted(found) == ["a", "b"]
    lines = list(console.answered(found, "Rome", {"snippets": 5, "style": "raw", "head": ["title"]}))
    assert len(lines) == 4 and "A title" in lines[0] and "<location" in lines[0] and lines[-1].startswith("3 results in 3 documents")
    written(tmp_path / "queries", "(Rome\n\nRome\n")
    console.main(["search", str(tmp_path / "out" / "b"), "--input", str(tmp_path / "queries"), "--cursor", str(tmp_path / "cursor")])
    said = capsys.readouterr().out
    assert said.startswith("query: ") and "Rome" in said  # a bad line doesn't end the session
