"""Registered queries of the search engine over ``documents`` and their SQL. Searches read the stored index alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions.sexpr import compile_expression
from corpusloom.operators import index, snippets
from corpusloom.operators.constraints import constrained
from corpusloom.operators.index import StoredIndex, append_documents, is_index, opened, write_index
from corpusloom.operators.virtual import GAP, virtual_documents, virtual_postings
from corpusloom.plans import annotated
from corpusloom.plans.query import Searcher
from corpusloom.plans.service import page_of, search_all
from corpusloom.sources.storage import shared_dir, version
from corpusloom.sources.tokens import plain_documents, plain_tokens, with_sentences

TOKENS = r"t0 AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), t AS MATERIALIZED (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS token, lower(w[i]) AS lower FROM t0, unnest(generate_series(1, len(w))) AS g(i)), s AS MATERIALIZED (SELECT *, coalesce(sum(CASE WHEN token LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sen_no FROM t)"
MINIMAL = "SELECT doc_id, l, r FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = a.doc_id AND b.l >= a.l AND b.r <= a.r AND (b.l <> a.l OR b.r <> a.r))"


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokens(spark, sf_dir):
    return plain_tokens(docs(spark, sf_dir))


def at(word: str) -> str:
    return f"(SELECT DISTINCT doc_id, pos AS l, pos AS r FROM t WHERE lower = '{word}')"


def both(a: str, b: str) -> str:
    """SQL of all candidate intervals of two terms: each with the nearest other before or after it."""
    pair = "SELECT x.doc_id, {l} AS l, {r} AS r FROM {x} x ASOF JOIN {y} y ON x.doc_id = y.doc_id AND x.r >= y.r"
    return " UNION ".join(pair.format(l="least(x.l, y.l)", r="x.r", x=x, y=y) for x, y in ((at(a), at(b)), (at(b), at(a))))


def place(spark, sf_dir, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{index.FORMAT}-{version(spark, f'{sf_dir}/documents.parquet')}"


def stored(spark, sf_dir) -> StoredIndex:
    """The index over ``documents``, written where it isn't yet."""
    path = place(spark, sf_dir, "index")
    if not is_index(spark, path):
        write_index(docs(spark, sf_dir), path, ["token", "lower"], docs(spark, sf_dir).count(), plain_documents)
    return opened(spark, path)


def batched(spark, sf_dir) -> StoredIndex:
    """An index over ``documents`` in two batches: those of all languages but one, then the rest."""
    path, late = place(spark, sf_dir, "batches"), F.coalesce(F.col("lang") == "de", F.lit(False))
    if not is_index(spark, path):
        write_index(docs(spark, sf_dir).where(~late), path, ["token", "lower"], docs(spark, sf_dir).count(), plain_documents)
        append_documents(docs(spark, sf_dir).where(late), path, plain_documents)
    return opened(spark, path)


def search(text: str, source=stored):
    return lambda spark, sf_dir: Searcher(source(spark, sf_dir)).search(text, "lower")


def term_postings(spark, sf_dir):
    found = index.postings(docs(spark, sf_dir), "lower")
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


def page_of_snippets(spark, sf_dir):
    """The first pages of a search, up to 100 snippets, in words around each interval."""
    return snippets.plain_snippets(*page_of(stored(spark, sf_dir), {"query": "of < that", "snippets": 100}, "lower"))


def page_at(size: int, offset: int = 0):
    """The intervals of a page of documents."""
    return lambda spark, sf_dir: page_of(stored(spark, sf_dir), {"query": "of < that", "snippets": size, "offset": offset}, "lower")[0].select("doc_id", "l", "r")


def two_collections(spark, sf_dir):
    """Documents with even and odd ids as two collections, each with its share of the snippets."""
    index = stored(spark, sf_dir)
    parts = {name: (index.where(F.col("doc_id") % 2 == k), index.documents) for k, name in enumerate(("even", "odd"))}
    return search_all(parts, {"query": "lower:of < lower:that", "snippets": 20}).select("doc_id", "thread", F.size("data").alias("n"))


def constraint(text: str, query: str = "(1:of 2:th*)~6"):
    def run(spark, sf_dir):
        index = stored(spark, sf_dir)
        return constrained(Searcher(index).matches(query, "lower", marks=True), index, text).select("doc_id", "l", "r")

    return run


def virtual(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return virtual_postings(spark, pages, f"{shared_dir(spark)}/links-{uuid.uuid4().hex}")


def link_postings(spark, sf_dir):
    """Each term of each virtual document, its positions over all pages folded into sums."""
    at = F.explode("positions").alias("pos")
    return virtual(spark, sf_dir).select("target", "term", at).groupBy("target", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("pos").alias("sum_pos"))


def stored_terms(spark, sf_dir):
    return stored(spark, sf_dir).terms.where("field = 'lower'").drop("field")


def batched_terms(spark, sf_dir):
    return batched(spark, sf_dir).terms.where("field = 'lower'").drop("field")


#: name: (expression, SQL)
EXPRESSIONS = {
    "shown": ('(concatenate (or (if (eq lang "en") "english") "other") "-" (subst #\\r #\\R (replace "src" "source " source)))', "concat(CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END, '-', translate(replace(source, 'src', 'source '), 'r', 'R'))"),
    "both": ('(or (and (eq lang "en") source) lang)', "CASE WHEN lang = 'en' THEN source ELSE lang END"),
    "listed": ("(car (cdr '(\"a\" \"b\" \"c\")))", "'b'"),
    "ends": ("(concatenate (first '(\"x\" \"y\")) (last '(\"x\" \"y\" \"z\")))", "'xz'"),
    "built": ("(car (cons source '(\"y\")))", "source"),
    "chosen": ('(if (atom lang) (quote "atom") "list")', "'atom'"),
    "evaluated": ("(eval '(concatenate \"e\" \"v\"))", "'ev'"),
    "stepped": ('(progn (setq x lang) (set (quote y) source) (concatenate x "+" y))', "lang || '+' || source"),
    "applied": ('(progn (defun tell (a &optional b) (concatenate a "/" (or b "none"))) (concatenate (tell lang) ((lambda (p &rest q) (car q)) "1" source)))', "lang || '/none' || source"),
    "split": ('(car (split "o" source))', "split_part(source, 'o', 1)"),
    "rest": ('(car (cdr (split "o" source)))', "string_split(source, 'o')[2]"),
    "failed": ('(concatenate "a" (if (eq lang "en") lang))', "CASE WHEN lang = 'en' THEN 'aen' ELSE '<error: concatenate: NIL is no string>' END"),
    "mended": ('(or (concatenate "a" (if (eq lang "en") lang)) source)', "CASE WHEN lang = 'en' THEN 'aen' ELSE source END"),
    "nothing": ('(and (eq lang "xx") lang)', "CAST(NULL AS VARCHAR)"),
}


def expression(spark, sf_dir):
    value = lambda text: compile_expression(text, lambda n: F.col(n) if n in ("lang", "source") else None)
    return docs(spark, sf_dir).select("doc_id", *[value(text).cast("string").alias(name) for name, (text, _) in EXPRESSIONS.items()])


def sentence_sizes(spark, sf_dir):
    return with_sentences(tokens(spark, sf_dir)).groupBy("doc_id", F.col("sen_no").cast("long").alias("sen_no")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))


NEAR = f"c0 AS ({both('of', 'that')}), c AS (SELECT * FROM c0), a AS ({MINIMAL})"
PAIRS = "p AS (SELECT doc_id, pos AS l, pos AS r FROM t WHERE starts_with(lower, 'th')), o AS (SELECT doc_id, pos AS l, pos AS r FROM t WHERE lower = 'of'), c AS (SELECT o.doc_id, least(o.l, p.l) AS l, greatest(o.r, p.r) AS r FROM o JOIN p ON o.doc_id = p.doc_id AND abs(o.l - p.l) < 6)"
ORDERED = f"{TOKENS}, c AS (SELECT y.doc_id, x.l, y.r FROM {at('that')} y ASOF JOIN {at('of')} x ON y.doc_id = x.doc_id AND y.l > x.r), m AS MATERIALIZED ({MINIMAL}), n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1)"
#: name: (query, SQL)
_ALL = {
    "tokenize": (lambda s, d: tokens(s, d), f"WITH {TOKENS} SELECT doc_id, pos, token, lower FROM t"),
    "sentences": (sentence_sizes, f"WITH {TOKENS} SELECT doc_id, CAST(sen_no AS BIGINT) AS sen_no, count(*) AS n, min(pos) AS first FROM s GROUP BY ALL"),
    "index_postings": (term_postings, f"WITH {TOKENS} SELECT lower AS term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (SELECT doc_id, pos, unnest(list_filter(string_split(lower, '|'), lambda x: x <> '')) AS lower FROM t) GROUP BY ALL"),
    "index_terms": (lambda s, d: index.term_stats(docs(s, d), "lower"), f"WITH {TOKENS}, o AS (SELECT doc_id, pos, unnest(list_filter(string_split(lower, '|'), lambda x: x <> '')) AS term FROM t), p AS (SELECT term, doc_id, count(*) AS tf, max(pos) AS last FROM o GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_count, CAST(sum(last) AS BIGINT) AS sum_max_pos FROM p GROUP BY term"),
    "index_totals": (lambda s, d: index.index_totals(plain_documents(docs(s, d)), docs(s, d), "lower"), f"WITH {TOKENS}, o AS (SELECT doc_id, pos, unnest(list_filter(string_split(lower, '|'), lambda x: x <> '')) AS term FROM t), p AS (SELECT term, doc_id, count(*) AS tf FROM o GROUP BY ALL), q AS (SELECT term, count(*) AS df, sum(tf) AS cf, max(tf) AS m FROM p GROUP BY term) SELECT count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, CAST(sum(cf) AS BIGINT) AS occurrences, max(m) AS maxcount, (SELECT max(pos) + 1 FROM t) AS maxdocsize, (SELECT count(*) FROM documents) AS documents FROM q"),
    "search_term": (search("that"), f"WITH {TOKENS} SELECT doc_id, pos AS l, pos AS r FROM t WHERE lower = 'that'"),
    "search_field": (search("token:That"), f"WITH {TOKENS} SELECT doc_id, pos AS l, pos AS r FROM t WHERE token = 'That'"),
    "search_prefix": (search("then*"), f"WITH {TOKENS} SELECT doc_id, pos AS l, pos AS r FROM t WHERE starts_with(lower, 'then')"),
    "search_values": (search("lower:(of OR that OR und)"), f"WITH {TOKENS} SELECT doc_id, pos AS l, pos AS r FROM t WHERE lower IN ('of', 'that', 'und')"),
    "search_and": (search("of that"), f"WITH {TOKENS}, c AS ({both('of', 'that')}) {MINIMAL}"),
    "search_or": (search("(of | lower:that)"), f"WITH {TOKENS} SELECT doc_id, pos AS l, pos AS r FROM t WHERE lower IN ('of', 'that')"),
    "search_not": (search("that !of"), f"WITH {TOKENS} SELECT doc_id, pos AS l, pos AS r FROM t WHERE lower = 'that' AND doc_id NOT IN (SELECT doc_id FROM t WHERE lower = 'of')"),
    "search_not_alone": (search("!of"), f"WITH {TOKENS} SELECT DISTINCT doc_id, CAST(NULL AS INTEGER) AS l, CAST(NULL AS INTEGER) AS r FROM t WHERE doc_id NOT IN (SELECT doc_id FROM t WHERE lower = 'of')"),
    "search_phrase": (search('"of the"'), f"WITH {TOKENS} SELECT doc_id, pos AS l, pos + 1 AS r FROM (SELECT doc_id, pos, lower, lead(lower) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM t) WHERE lower = 'of' AND next = 'the'"),
    "search_ordered": (search("of < that"), f"WITH {TOKENS}, c AS (SELECT y.doc_id, x.l, y.r FROM {at('that')} y ASOF JOIN {at('of')} x ON y.doc_id = x.doc_id AND y.l > x.r) {MINIMAL}"),
    "search_near": (search("(of that)~5"), f"WITH {TOKENS}, {NEAR} SELECT doc_id, l, r FROM a WHERE r - l + 1 <= 5"),
    "search_difference": (search("(of that) - the"), f"WITH {TOKENS}, {NEAR} SELECT doc_id, l, r FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = a.doc_id AND lower = 'the' AND pos BETWEEN a.l AND a.r)"),
    "search_sentence": (search("(of that) - _SENT_"), f"WITH {TOKENS}, w AS MATERIALIZED (SELECT doc_id, pos, sen_no, lower FROM s WHERE lower IN ('of', 'that')), n AS (SELECT *, lead(pos) OVER o AS r, lead(lower) OVER o AS other, lead(sen_no) OVER o AS sen FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos AS l, r FROM n WHERE lower <> other AND sen = sen_no"),
    "constraint_equal": (constraint("2.lower = that"), f"WITH {TOKENS}, {PAIRS}, m AS ({MINIMAL}) SELECT doc_id, l, r FROM m WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = m.doc_id AND pos BETWEEN l AND r AND lower = 'that')"),
    "constraint_unequal": (constraint("2.lower != that"), f"WITH {TOKENS}, {PAIRS}, m AS ({MINIMAL}) SELECT doc_id, l, r FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = m.doc_id AND pos BETWEEN l AND r AND lower = 'that')"),
    "snippet_page": (page_of_snippets, f"WITH {TOKENS}, c AS (SELECT y.doc_id, x.l, y.r FROM {at('that')} y ASOF JOIN {at('of')} x ON y.doc_id = x.doc_id AND y.l > x.r), m AS ({MINIMAL}), n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1), k AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS page FROM n), g AS (SELECT page, coalesce(sum(sum(n)) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k GROUP BY page), f AS (SELECT m.* FROM m JOIN k USING (doc_id) JOIN g USING (page) WHERE before < 100) SELECT f.doc_id, f.l, f.r, string_agg(regexp_replace(regexp_replace(token, '\\|G\\S*', '', 'g'), '[¶§]', '', 'g'), ' ' ORDER BY pos) AS snippet FROM f JOIN t ON t.doc_id = f.doc_id AND t.pos BETWEEN f.l - 5 AND f.r + 5 GROUP BY ALL"),
    "search_remap": (search("of {{token->lower}} That"), f"WITH {TOKENS}, w AS (SELECT doc_id, pos, lower FROM t WHERE lower = 'of' OR token = 'That'), n AS (SELECT *, lead(pos) OVER o AS r, lead(lower) OVER o AS other FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos AS l, r FROM n WHERE lower <> other"),
    "search_holding": (search("(of < that) > the"), f"WITH {ORDERED} SELECT doc_id, l, r FROM m WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = m.doc_id AND lower = 'the' AND pos BETWEEN m.l AND m.r)"),
    "search_inside": (search("the @ (of < that)"), f"WITH {ORDERED} SELECT doc_id, pos AS l, pos AS r FROM t WHERE lower = 'the' AND EXISTS (SELECT 1 FROM m WHERE m.doc_id = t.doc_id AND pos BETWEEN m.l AND m.r)"),
    "search_gap": (search('"of .1-3. that"'), f"WITH {TOKENS}, c AS (SELECT x.doc_id, max(x.pos) AS l, y.pos AS r FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.lower = 'of' AND y.lower = 'that' AND y.pos - x.pos BETWEEN 2 AND 4 GROUP BY x.doc_id, y.pos) {MINIMAL}"),
    "search_rare_first": (search("(hewh of)~20"), f"WITH {TOKENS}, c AS ({both('hewh', 'of')}), a AS ({MINIMAL}) SELECT doc_id, l, r FROM a WHERE r - l + 1 <= 20"),
    "page_at_offset": (page_at(12, 20), f"WITH {ORDERED}, k AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 20 AS page FROM n), g AS (SELECT *, coalesce(sum(n) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE page > 0) SELECT m.doc_id, l, r FROM m JOIN g USING (doc_id) WHERE before < 12"),
    "page_without_budget": (page_at(-1), f"WITH {ORDERED} SELECT doc_id, l, r FROM m WHERE doc_id IN (SELECT doc_id FROM n ORDER BY doc_id LIMIT 15)"),
    "two_collections": (two_collections, f"WITH {ORDERED}, k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id % 2 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS thread, CAST(n AS INTEGER) AS n FROM k WHERE before < 10"),
    "scalar_expression": (expression, f"SELECT doc_id, {', '.join(f'{sql} AS {name}' for name, (_, sql) in EXPRESSIONS.items())} FROM documents"),
}
LINKS = rf"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a\s*>')) AS link, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a\s*>')))) AS no FROM pages),
b AS (SELECT page_id, no, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS page, regexp_replace(trim(regexp_extract(link, '(?is)^<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)), '#.*$', '') AS href, list_filter(regexp_split_to_array(regexp_replace(link, '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM a),
l AS MATERIALIZED (SELECT page_id, no, w, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(host, '^[^:]*:') || href WHEN starts_with(href, '/') THEN host || href WHEN page = host THEN host || '/' || href ELSE regexp_replace(page, '[^/]*$', '') || href END AS target FROM b WHERE href <> '' AND len(w) > 0),
s AS (SELECT *, coalesce(sum(len(w) + {GAP}) OVER (PARTITION BY target ORDER BY page_id, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
t AS MATERIALIZED (SELECT target, page_id, lower(unnest(w)) AS term, CAST(before + unnest(range(len(w))) AS BIGINT) AS pos FROM s)"""
_ALL["virtual_postings"] = (link_postings, f"WITH {LINKS} SELECT target, term, count(*) AS tf, min(pos) AS first, max(pos) AS last, CAST(sum(pos) AS BIGINT) AS sum_pos FROM t GROUP BY ALL")
_ALL["virtual_documents"] = (lambda s, d: virtual_documents(virtual(s, d)), f"WITH {LINKS} SELECT target, count(DISTINCT page_id) AS pages, count(*) AS words, max(pos) + 1 AS size FROM t GROUP BY ALL")
_ALL["index_stored_terms"] = (stored_terms, _ALL["index_terms"][1])
_ALL["index_batched_terms"] = (batched_terms, _ALL["index_terms"][1])
_ALL["search_batches"] = (search('"of the"', batched), _ALL["search_phrase"][1])
QUERIES = {name: q for name, (q, _) in _ALL.items()} | annotated.QUERIES
ORACLE = {name: sql for name, (_, sql) in _ALL.items()} | annotated.ORACLE
