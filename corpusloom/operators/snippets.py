"""Snippets around intervals, entity merging and rendering; pages of results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.entities import CODES, USUAL, Entities, missing_as_null
from corpusloom.functions.sexpr import compile_expression
from corpusloom.operators.blocks import token_rows
from corpusloom.sources.tokens import PIECE, in_batches, pieces


def display(token: Column) -> Column:
    """Without boundary marks and glue suffix."""
    return F.regexp_replace(F.regexp_replace(token, r"\|G\S*", ""), "[¶§]", "")


def cut(context: int, columns: list[str]):
    """Tokens (doc_id, l, r, pos, ...) in and around each interval of batches of documents as arrays, as ``snippet_tokens`` has them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size, n = (pc.list_value_length(batch.column(c)).to_numpy().astype(np.int64) for c in (columns[0], "found"))
            found, row = pc.list_flatten(batch.column("found")), np.repeat(np.arange(len(batch)), n)
            l, r = (pc.struct_field(found, c).to_numpy().astype(np.int64) for c in ("l", "r"))
            low = np.maximum(l - context, 0)
            count = np.minimum(r + context, size[row] - 1) - low + 1
            each = np.repeat(np.arange(len(row)), count)
            pos = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + low[each]
            at = pa.array((np.cumsum(size) - size)[row[each]] + pos)
            taken = [pc.list_flatten(batch.column(c)).take(at) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[each])), *[pa.array(x, pa.int32()) for x in (l[each], r[each], pos)], *taken], names=["doc_id", "l", "r", "pos", *columns])

    return run


def snippet_tokens(found: DataFrame, source, context: int, columns: list[str]) -> DataFrame:
    """(lot, doc_id, l, r, pos, ...): tokens in and around each interval, cut out of the arrays of its document, whose part is the lot."""
    if hasattr(source, "cut"):
        return source.cut(found.select("doc_id", "l", "r").where("l is not null"), context, columns)
    rows = source.beside(found.select("doc_id", "l", "r").where("l is not null"), columns).withColumnRenamed("part", "lot")
    token = lambda x: lambda p: F.struct(x["l"].alias("l"), x["r"].alias("r"), p.alias("pos"), *[F.get(F.col(c), p).alias(c) for c in columns])
    each = F.transform("found", lambda x: F.transform(_places(x, context, columns[0]), token(x)))
    return rows.select("lot", "doc_id", F.explode(F.flatten(each)).alias("t")).select("lot", "doc_id", "t.*")


def _places(x: Column, context: int, field: str) -> Column:
    """The positions in and around an interval."""
    return F.sequence(F.greatest(x["l"] - context, F.lit(0)), F.least(x["r"] + context, F.size(field) - 1))


def plain_snippets(found: DataFrame, source, context: int = 5, field: str = "token") -> DataFrame:
    """(doc_id, l, r, snippet); empty snippets are dropped."""
    rows = source.beside(found.select("doc_id", "l", "r").where("l is not null"), [field])
    words = lambda x: F.transform(_places(x, context, field), lambda p: display(F.get(F.col(field), p)))
    each = F.transform("found", lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r"), F.array_join(words(x), " ").alias("snippet")))
    return rows.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*").where("length(snippet) > 0")


def mentions(source) -> DataFrame:
    """(doc_id, pos, mention, entity): position and tag of the last token of the entity that a token belongs to; the last mention wins."""
    return token_rows(source.forward(["mention", "entity"]), ["mention", "entity"]).where("mention is not null").select("doc_id", "pos", "mention", "entity")


def field_value(name: str) -> Column | None:
    return missing_as_null(F.col(name)) if name in NAMES else display(F.col("token")) if name == "content" else None


def entity_values(tags: dict[str, list[str]] | None = None, entities: Entities = USUAL, read: set[str] | None = None) -> tuple[Column, Column]:
    """(picks, values): what a token adds to its entity (column ``entity``), and the names and places of the attributes to show.

    ``tags`` limits them to some tags and their attribute names ("all" for any). Of tokens before the last, properties
    count only if they have any. The names of the fields that are read are added to ``read``.
    """

    def _field(name: str) -> Column | None:
        (set() if read is None else read).add(name)
        return field_value(name)

    asked = lambda k, wanted: "all" in wanted or k in wanted or k.removeprefix("data-") in wanted
    shown = [w for t in entities.mapping if (w := (tags or {"all": ["all"]}).get(t, (tags or {"all": ["all"]}).get("all"))) is not None]
    shared = {k: compile_expression(v, _field).cast("string") for k, v in (entities.common | entities.entity).items() if any(asked(k, w) for w in shown)}
    has_own = reduce(Column.__or__, [_field(f"param{i}").isNotNull() for i in range(10)]) | (F.col("mention") == F.col("pos"))
    picks, own = F.array().cast("array<struct<name:string,at:int>>"), F.array().cast("array<string>")
    for tag in entities.mapping:
        wanted = (tags or {"all": ["all"]}).get(tag, (tags or {"all": ["all"]}).get("all"))
        if wanted is not None:
            named = entities.expressions.get(tag, {})
            chosen = [(k, i) for i, k in enumerate([*shared, *named]) if asked(k, wanted)]
            if any(i >= len(shared) for _, i in chosen):
                own = F.when(F.col("entity") == tag, F.array(*[compile_expression(v, _field).cast("string") for v in named.values()])).otherwise(own)
            if chosen:
                picks = F.when(F.col("entity") == tag, F.array(*[F.struct(F.lit(k).alias("name"), F.lit(i).alias("at")) for k, i in chosen])).otherwise(picks)
    return picks, F.concat(F.array(*shared.values()).cast("array<string>"), F.when(has_own, own).otherwise(F.array().cast("array<string>")))


def merged_attributes(picks: Column, values: Column, last_only: tuple[str, ...]) -> Column:
    """One attribute string of an entity from the arrays of its tokens' values, in order; some come from the last token alone."""

    def one(p: Column) -> Column:
        own = F.transform(values, lambda v: F.get(v, p["at"]))
        merged = F.array_join(F.filter(own, lambda x: x.isNotNull() & (x != "")), " ")
        return F.concat(F.lit(" "), p["name"], F.lit('="'), F.when(p["name"].isin(*last_only), F.coalesce(F.element_at(own, -1), F.lit(""))).otherwise(merged), F.lit('"'))

    return F.array_join(F.transform(picks, one), "")


NAMES = {"position", "token", "tag", "lemma", "parpos", "function", "parword", "parlemma", "paroffset", "link", "length", "docuri", "lower", "nerid", "nertag", "nertype", "nerlength", *[f"param{i}" for i in range(10)]}


def token_attributes(attributes: list[str], style: str, entities: Entities = USUAL) -> Column:
    """Attributes of one token; params of an entity's tokens bear the names of its properties."""
    mark = "data-" if style == "html" else ""
    out = []
    for a in attributes:
        named = reduce(lambda rest, x: F.when(F.col("entity") == x[0], F.lit(f" {mark}{x[1]}=")).otherwise(rest), [(t, n) for t, own in entities.mapping.items() for n, p in own.items() if p == a], F.lit(f" {mark}{a}="))
        out.append(F.concat(named, F.lit('"'), F.coalesce(missing_as_null(F.col(a)), F.lit("")), F.lit('"')))
    return F.concat(*out) if out else F.lit("")


def rendered(found: DataFrame, source, context: int = 5, style: str = "html", tags: dict[str, list[str]] | None = None, attributes: list[str] | None = None, field: str = "token", entities: Entities = USUAL) -> DataFrame:
    """(doc_id, l, r, snippet) in html, raw or ascii style, showing one field of the tokens.

    Tokens of one entity are one part, clipped where the snippet begins, whose attributes are joined from all of them.
    """
    read, params = set(), {f"param{i}" for i in range(10)}
    picks, values = entity_values(tags, entities, read)
    columns = [*dict.fromkeys(["token", field, *sorted((read | params) & NAMES & set(source.columns)), *(attributes or []), "mention", "entity"])]
    rows = snippet_tokens(found, source, context, columns).where(display(F.col("token")) != "")
    own, each = token_attributes(attributes or [], style, entities), "span" if style == "html" else "field"
    text = display(F.col(field))
    text = F.when((own != "") & (text != ""), F.concat(F.lit(f"<{each}"), own, F.lit(">"), text, F.lit(f"</{each}>"))).otherwise(text)
    rows = rows.select("lot", "doc_id", "l", "r", "pos", "entity", F.coalesce("mention", "pos").alias("part"), text.alias("text"), picks.alias("picks"), values.alias("values"))
    parts = rows.groupBy("lot", "doc_id", "l", "r", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "values"))).alias("t"), F.first("picks").alias("picks"), F.first("entity").alias("tag"))
    parts = parts.withColumn("text", F.array_join(F.filter("t.text", lambda x: x != ""), " ")).withColumn("attrs", merged_attributes(F.col("picks"), F.col("t.values"), entities.last_only))
    plain = F.replace("attrs", F.lit("data-"), F.lit(""))
    element = F.concat(F.lit("<"), "tag", plain, F.lit(">"), "text", F.lit("</"), "tag", F.lit(">"))
    if style == "ascii":
        code = reduce(lambda out, x: F.when(F.col("tag") == x[0], F.lit(f"\x1b[{CODES[x[1]]}m")).otherwise(out), entities.dye.items(), F.lit(f"\x1b[{CODES['Default']}m"))
        element = F.concat(code, element, F.lit("\x1b[0m"))
    elif style != "raw":
        element = F.concat(F.lit("<a"), "attrs", F.lit(">"), "text", F.lit("</a>"))
    out = parts.withColumn("shown", F.when(F.col("tag").isNotNull(), element).otherwise(F.col("text"))).groupBy("lot", "doc_id", "l", "r").agg(F.array_sort(F.collect_list(F.struct("part", "shown")))["shown"].alias("s"))
    return out.select("doc_id", "l", "r", F.array_join(F.filter("s", lambda x: x != ""), " ").alias("snippet")).where("length(snippet) > 0")


def paragraphs_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(it, "token", PIECE):
        size = pc.list_value_length(batch.column("token")).to_numpy().astype(np.int64)
        row, number = np.repeat(np.arange(len(batch)), size), pc.list_flatten(batch.column("par_no")).to_numpy().astype(np.int64)
        text = pc.replace_substring_regex(pc.replace_substring_regex(pc.list_flatten(batch.column("token")), r"\|G\S*", ""), "[¶§]", "")
        shown = pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)
        row, number, text = row[shown], number[shown], text.filter(pa.array(shown))
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1]))) if len(row) else row
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), text), " ")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[new])), pa.array(number[new], pa.int64()), joined], names=["doc_id", "par_no", "snippet"])


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, par_no, snippet): texts by paragraph of documents (doc_id, arrays par_no and token by position), made within each document."""
    return in_batches(documents.select("doc_id", "par_no", "token"), paragraphs_of, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, par_no long, snippet string")


def page_size(snippets: int) -> int:
    """Documents in a page: 15 without a budget, else 10 to the number of its digits less two."""
    return 15 if snippets <= 0 else 10 ** max(0, len(str(snippets)) - 2)


def _open_pages(counts: list[int], size: int, snippets: int) -> int:
    """How many of the documents, which have so many snippets each, are in the pages to show."""
    shown, got = 0, 0
    while shown < len(counts) and (shown == 0 or got < max(snippets, 1)):
        got += sum(counts[shown : shown + size])
        shown = min(shown + size, len(counts))
    return shown


def page(found: DataFrame, snippets: int, offset: int = 0) -> DataFrame:
    """Whole documents in order of doc_id from ``offset`` on, page by page, until there are as many snippets as asked for.

    Of each document that a page may need its count comes to the driver: as many as there are snippets asked for, since each has one at least.
    """
    size = page_size(snippets)
    need = size if snippets <= 0 else -(-snippets // size) * size
    counts = found.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").offset(offset).limit(need).collect()
    shown = counts[: _open_pages([r.n for r in counts], size, snippets)]
    return found.where(F.col("doc_id").between(shown[0].doc_id, shown[-1].doc_id)) if shown else found.limit(0)


def page_by_ranges(index, evaluate, expected: int, snippets: int, offset: int = 0) -> tuple[DataFrame, object]:
    """The same page of what ``evaluate`` finds in a view of a stored index, and the view of its documents.

    Ranges of documents are evaluated one after the other, each wider than the last, until the page is full; the first is as
    wide as ``expected`` matching documents in all suggest. What lies behind the page is never read.
    """
    size = page_size(snippets)
    need = size if snippets <= 0 else -(-snippets // size) * size
    parts = index.high - index.low + 1
    at, width, left, rows = index.low, max(1, -(-2 * (offset + need) * parts // max(1, expected))), offset, []
    while at <= index.high and len(rows) < need and _open_pages([r.n for r in rows], size, snippets) == len(rows):
        last = min(at + width - 1, index.high)
        counts = evaluate(index.between(at << index.bits, (last + 1 << index.bits) - 1)).groupBy("doc_id").agg(F.count("*").alias("n"))
        skipped = counts.count() if left else 0
        if not left or skipped > left:
            rows += counts.orderBy("doc_id").offset(left).limit(need - len(rows)).collect()
            left = 0
        else:
            left -= skipped
        at, width = last + 1, width * 4
    shown = rows[: _open_pages([r.n for r in rows], size, snippets)]
    if not shown:
        return evaluate(index).limit(0), index
    view = index.between(shown[0].doc_id, shown[-1].doc_id)
    return evaluate(view), view


def next_cursor(cursor: dict[str, int], returned: dict[str, int], quota: dict[str, int], received: dict[str, int]) -> dict[str, int]:
    """Offsets for the next request: only collections that filled their quota go on."""
    return {host: cursor.get(host, 0) + returned[host] for host in returned if received[host] >= quota[host]}


def budget(snippets: int, hosts: int) -> int:
    """Snippets that each collection is asked for; none means a page of documents of each."""
    return -(-snippets // max(1, hosts)) if snippets > 0 else snippets
