"""Requests against one or more collections: query, constraint, pages, snippets, counters."""

from __future__ import annotations

import socket
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.entities import FIELDS
from corpusloom.operators.blocks import documents_of
from corpusloom.operators.constraints import constrained
from corpusloom.operators.index import StoredIndex, TokenTable
from corpusloom.operators.snippets import budget, next_cursor, page, page_by_ranges, paragraphs, plain_snippets, rendered
from corpusloom.plans.query import Searcher, needed, parse
from corpusloom.plans.settings import Settings

STYLES = ("html", "raw", "ascii")
Source = TokenTable | StoredIndex
DEFAULT = Settings()


def as_source(tokens: DataFrame | Source, multi: bool = False) -> Source:
    return TokenTable(tokens, multi) if isinstance(tokens, DataFrame) else tokens


def allowed_fields(settings: Settings = DEFAULT) -> list[str]:
    return [*settings.fields, *(f"{tag}.{name}" for tag, own in settings.mapping.items() for name in own)]


def matches(source: Source, request: dict, field: str = "token", settings: Settings = DEFAULT) -> DataFrame:
    """(part, doc_id, l, r) of all intervals of a request's query that meet its constraint."""
    s = Searcher(source, mapping=settings.mapping)
    if request.get("constraint"):
        return constrained(s.matches(request["query"], field, marks=True), source, request["constraint"], settings.mapping)
    return s.matches(request["query"], field)


def page_of(source: Source, request: dict, field: str = "token", settings: Settings = DEFAULT) -> tuple[DataFrame, Source]:
    """The intervals of a request's page of documents, and a view of the source that has these alone, if it is stored."""
    snippets, offset = int(request.get("snippets", 0)), int(request.get("offset", 0))
    if not isinstance(source, StoredIndex):
        return page(matches(source, request, field, settings), snippets, offset), source
    groups = needed(parse(request["query"], field, settings.mapping))
    counts = iter(source.frequency([w for g in groups for w in g]))
    expected = min((sum(next(counts) for _ in g) for g in groups), default=source.size)
    return page_by_ranges(source, lambda view: matches(view, request, field, settings), expected, snippets, offset)


def search(tokens: DataFrame | Source, documents: DataFrame, request: dict, multi: bool = False, thread: str = "0", settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, title, uri, thread, data): the snippets of a page of documents, showing the request's field if there is
    such a one; columns that ``documents`` lacks are null.
    """
    source = as_source(tokens, multi)
    style, field = request.get("style", settings.style).lower(), request.get("field", settings.field)
    field = field if field in source.columns else "token"
    found, source = page_of(source, request, settings=settings)
    wanted = request.get("format", {})
    if set(FIELDS) <= set(source.columns):
        attributes = wanted.get("attributes") or []
        cut = rendered(found, source, style=style if style in STYLES else "html", tags=wanted.get("nertags"), attributes=FIELDS if "all" in attributes else attributes, field=field, entities=settings.entities())
    else:
        cut = plain_snippets(found, source, field=field)
    data = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l", "snippet")))["snippet"].alias("data"))
    extra = [F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("title", "uri")]
    return data.join(documents.select("doc_id", *extra), "doc_id").withColumn("thread", F.lit(thread))


def search_all(collections: dict[str, tuple], request: dict, multi: bool = False) -> DataFrame:
    """Union of the results of all collections (tokens or index, documents, and settings if there are such), each with its name as
    thread; one job serves them all.

    Each collection has its share of the snippets, from the request's ``cursor`` on (collection: offset); with a cursor,
    those that it doesn't name are at their end.
    """
    cursor = request.get("cursor")
    parts = []
    for name, (t, d, *own_settings) in sorted(collections.items(), key=lambda x: x[0]):
        if not cursor or name in cursor:
            own = {"snippets": budget(int(request.get("snippets", 0)), len(cursor or collections)), "offset": (cursor or {}).get(name, int(request.get("offset", 0)))}
            parts.append(search(t, d, request | own, multi, name, *own_settings))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shown(row) -> dict:
    return {"data": row["data"], "title": row.title, "uri": row.uri, "doc": str(row.doc_id), "thread": row.thread}


def ask(collections: dict[str, tuple], request: dict, multi: bool = False) -> dict:
    """The answer of all collections to a request, asked again until there are as many snippets as wanted or no more.

    Results come in order of collection and document, with counts by collection, the cursor of the next request, how far each
    collection has been read (``offset``), the time it took and the name of the machine that answered; an error is told instead of
    raised. ``get`` and ``allowedFields`` go to the collection that the request names as ``thread``, else to the first.
    """
    if "get" in request or "allowedFields" in request:
        tokens, documents, *settings = collections[request.get("thread", min(collections))]
        return respond(tokens, documents, request, multi, *settings)
    began = time.time_ns()
    about = {"hostname": socket.gethostname(), "expectedSnippets": int(request.get("snippets", 0))}
    results, received, wanted = [], dict.fromkeys(sorted(collections), 0), int(request.get("snippets", 0))
    cursor = request.get("cursor") or dict.fromkeys(sorted(collections), int(request.get("offset", 0)))
    offset = dict(cursor)
    try:
        while True:
            left = wanted - sum(received.values())
            rows = search_all(collections, request | {"cursor": cursor, "snippets": left}, multi).orderBy("thread", "doc_id").collect()
            got, documents = dict.fromkeys(cursor, 0), dict.fromkeys(cursor, 0)
            for r in rows:
                got[r.thread] += len(r["data"])
                documents[r.thread] += 1
                results.append(_shown(r))
            received = {k: n + got.get(k, 0) for k, n in received.items()}
            offset = {k: n + documents.get(k, 0) for k, n in offset.items()}
            quota = dict.fromkeys(cursor, max(1, budget(left, len(cursor))))
            cursor = next_cursor(cursor, documents, quota, got)
            if not cursor or not rows or sum(received.values()) >= wanted:
                break
    except ValueError as e:
        return {"results": [], "received": received, "total": "0", "documents": "0", "cursor": {}, "offset": offset, "time": str(time.time_ns() - began), "error": "query", "errorMessage": str(e)} | about
    results.sort(key=lambda r: (r["thread"], int(r["doc"])))
    return {"results": results, "received": received, "total": str(sum(received.values())), "documents": str(len(results)), "cursor": cursor, "offset": offset, "time": str(time.time_ns() - began), "error": ""} | about


def respond(tokens: DataFrame | Source, documents: DataFrame, request: dict, multi: bool = False, settings: Settings = DEFAULT) -> dict:
    """The JSON answer of one collection; a page's results are gathered, and an error is told instead of raised.

    total and documents count the results of the answer.
    """
    began = time.time_ns()
    try:
        source = as_source(tokens, multi)
        if "get" in request:
            rows = paragraphs(documents_of(source.tokens_of([int(request["get"])]).select("doc_id", "pos", "par_no", "token"))).orderBy("par_no").collect()
            about = documents.where(F.col("doc_id") == int(request["get"])).first()
            told = {k: about[k] if about and k in documents.columns else None for k in ("title", "uri")}
            return {"results": [{"data": [r.snippet for r in rows], "doc": str(request["get"]), **told}], "time": str(time.time_ns() - began), "error": ""}
        if "allowedFields" in request:
            return {"allowed": allowed_fields(settings), "error": ""}
        results = [_shown(r) for r in search(source, documents, request, settings=settings).orderBy("doc_id").collect()]
        return {"results": results, "total": str(sum(len(r["data"]) for r in results)), "documents": str(len(results)), "offset": int(request.get("offset", 0)) + len(results), "expectedSnippets": int(request.get("snippets", 0)), "time": str(time.time_ns() - began), "hostname": socket.gethostname(), "error": ""}
    except ValueError as e:
        return {"results": [], "error": "query", "errorMessage": str(e), "time": str(time.time_ns() - began)}
