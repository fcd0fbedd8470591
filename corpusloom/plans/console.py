"""Answers as text for a terminal, and the commands: index, search, lisp, settings."""

from __future__ import annotations

import argparse
import json
import re
import sys
import time
from collections.abc import Iterable, Iterator
from dataclasses import asdict
from urllib.parse import unquote_plus

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.entities import CODES, DYE
from corpusloom.functions.sexpr import compile_expression
from corpusloom.operators.index import StoredIndex, is_index, write_index
from corpusloom.plans.service import ask
from corpusloom.plans.settings import Settings, read_cursor, read_settings, settings_of, write_cursor, write_settings
from corpusloom.sources.storage import exists
from corpusloom.sources.tokens import vertical_arrays, vertical_documents, vertical_lines

SHADES = {name.replace(" ", "").lower(): code for name, code in CODES.items()}


def painted(snippet: str, dye: dict[str, str] | None = None) -> str:
    """A raw snippet with each entity's element in the colour of its tag."""
    for tag, colour in (dye or DYE).items():
        code = SHADES.get(colour.replace(" ", "").lower())
        if code:
            snippet = re.sub(rf"<{tag}(?=[ >])", f"\x1b[{code}m<{tag}", snippet).replace(f"</{tag}>", f"</{tag}>\x1b[0m")
    return snippet


def boxed(result: dict, wanted: Iterable[str]) -> str:
    """A box with what is wanted of title, uri, document, thread and host of a result."""
    found = {"title": result.get("title"), "uri": unquote_plus(result["uri"]) if result.get("uri") else None, "document": result.get("doc"), "thread": result.get("thread"), "host": result.get("host")}
    rows = [f"{name}: {value}" for name, value in found.items() if name in set(wanted) and value is not None]
    width = max(map(len, rows), default=0)
    line = "-" * (width + 4)
    return "\n".join([line, *(f"| {r:<{width}} |" for r in rows), line, ""])


def printed(answer: dict, head: Iterable[str] = (), dye: dict[str, str] | None = None, style: str = "raw", whole: bool = False) -> Iterator[str]:
    """Lines of an answer: a snippet each, or ``whole`` documents, under their head; allowed fields; or the error."""
    if answer.get("error"):
        yield f"{answer['error']}: {answer.get('errorMessage', '')}"
    if "allowed" in answer:
        yield ", ".join(answer["allowed"])
    for result in answer.get("results", []):
        for text in ["".join(result["data"])] if whole else result["data"]:
            shown = painted(text, dye) if style == "raw" else text
            yield (boxed(result, head) if head else "") + shown


def index_collection(spark: SparkSession, source: str, target: str, settings: Settings | None = None) -> None:
    """The index over vertical files, with what is known of their documents."""
    lines = vertical_lines(spark, source)
    write_index(lines, target, list((settings or Settings()).indexed), lines.count(), vertical_arrays)
    vertical_documents(lines).write.mode("overwrite").parquet(f"{target}/about")
    if settings:
        spark.createDataFrame([(json.dumps(asdict(settings)),)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{target}/settings")


def load_collections(spark: SparkSession, root: str) -> dict[str, tuple[StoredIndex, DataFrame, Settings]]:
    """The indexes in the folders of a folder, or in it itself, by name, with their documents and the settings they were made with."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = folder(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    places = [folder(root), *(x.getPath() for x in files.listStatus(folder(root)) if x.isDirectory())]
    there = [p for p in places if is_index(spark, p.toString())]

    def settings(path: str) -> Settings:
        return settings_of(json.loads(spark.read.parquet(f"{path}/settings").first()[0])) if exists(spark, f"{path}/settings/_SUCCESS") else Settings()

    return {p.getName(): (StoredIndex(spark, p.toString()), spark.read.parquet(f"{p.toString()}/about"), settings(p.toString())) for p in there}


def evaluated(spark: SparkSession, text: str) -> str:
    """The value of an expression without fields, as text."""
    value = spark.range(1).select(compile_expression(text, lambda _: None).cast("string")).first()[0]
    return "NIL" if value is None else value


def answered(collections: dict, query: str, request: dict) -> Iterator[str]:
    """The answer to one line of input, and how long it took."""
    began = time.time()
    answer = ask(collections, request | {"query": query})
    yield from printed(answer, request.get("head", ()), request.get("dye"), request.get("style", "raw"))
    took = time.time() - began
    yield f"{answer.get('total', 0)} results in {answer.get('documents', 0)} documents; {1000 * took:.0f} ms"


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="corpusloom")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("settings").add_argument("target")
    index = sub.add_parser("index")
    for name in ("source", "target"):
        index.add_argument(name)
    index.add_argument("--settings")
    search = sub.add_parser("search")
    search.add_argument("root")
    search.add_argument("--input", help="file of queries; else they are read line by line")
    search.add_argument("--snippets", type=int, default=0)
    search.add_argument("--style", default="raw")
    search.add_argument("--constraint")
    search.add_argument("--cursor", help="file with where the last answer ended")
    sub.add_parser("lisp")
    said = top.parse_args(argv)
    if said.command == "settings":
        write_settings(said.target)
        return
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if said.command == "index":
        index_collection(spark, said.source, said.target, read_settings(said.settings) if said.settings else None)
    elif said.command == "lisp":
        for line in filter(str.strip, sys.stdin):
            print(evaluated(spark, line))
    else:
        collections = load_collections(spark, said.root)
        request = {"snippets": said.snippets, "style": said.style, "constraint": said.constraint}
        with open(said.input, encoding="utf-8") if said.input else sys.stdin as lines:
            for line in filter(str.strip, lines):
                try:
                    if said.cursor:
                        answer = ask(collections, request | {"query": line.strip(), "cursor": read_cursor(said.cursor)})
                        if not answer["error"]:
                            write_cursor(said.cursor, answer.get("cursor", {}))
                        print(*printed(answer, style=said.style), sep="\n")
                    else:
                        print(*answered(collections, line.strip(), request), sep="\n")
                except PySparkException as e:  # a line that Spark refuses doesn't end the session
                    print(f"error: {e}")


if __name__ == "__main__":
    main()
