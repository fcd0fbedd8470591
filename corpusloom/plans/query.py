"""The search language: text to a tree, tree to a plan of interval operators.

  a b, a & b, a AND b    both            a | b, a OR b   either          !a       documents without a
  "a b"   phrase         a < b  in order (a b)~5  within 5 positions     a ^ b    same place
  a - b   holds no b     a > b   holds a b      a @ b   lies in a b     a - _SENT_, a - _PAR_    in one sentence, paragraph
  f:[a..b]  whole numbers or days from a to b, either may be left out
  "a .. b"  up to 4 words between, "a .2. b" up to 2, "a .1-3. b" from 1 to 3     {{f->g}} q   words of field f at g's places
  f:w, f:"a b", f:(a OR b)  in a field   w*  by prefix    1:f:w  labelled   tag.property:w  an entity's property
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.entities import MAPPING
from corpusloom.operators import intervals as I
from corpusloom.operators.blocks import KEY
from corpusloom.operators.index import StoredIndex, TokenTable, bound

LEX = re.compile(r'\s*(?:"([^"]*)"|([()&|!<>^~])|\{\{\s*([^\s{}>-]+)\s*->\s*([^\s{}>-]+)\s*\}\}|\[([^\s\]]*?)\.\.([^\s\]]*)\](?=[\s)]|$)|([-@](?=\s)|(?<=\s)-(?=[\s(_]))|([^\s()&|!<>^~":]+(?:\.[A-Za-z]+)?):(?=\S)|([^\s()&|!<>^~":]+))')
GAP = re.compile(r"\.(?:(\d+)(?:-(\d+))?)?\.")
#: Words that a gap without a number spans at most.
ANY_GAP = 4


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass
class Node:
    kind: str
    parts: list = field(default_factory=list)
    gaps: list = field(default_factory=list)
    field: str = ""
    value: object = None
    label: int | None = None


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEX.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unreadable at {at}: {text[at : at + 10]}")
        at = m.end()
        if m[1] is not None:
            out.append(("phrase", m[1]))
        elif m[2]:
            out.append(("op", m[2]))
        elif m[3]:
            out.append(("remap", f"{m[3]} {m[4]}"))
        elif m[5] is not None:
            out.append(("range", f"{m[5]} {m[6]}"))
        elif m[7]:
            out.append(("op", m[7]))
        elif m[8]:
            out.append(("field", m[8]))
        else:
            out.append(("op", {"OR": "|", "AND": "&"}[m[9]]) if m[9] in ("OR", "AND") else ("word", m[9]))
    return out


class Parser:
    def __init__(self, text: str, default: str, mapping: dict[str, dict[str, str]]):
        self.items, self.at, self.default, self.mapping = lex(text), 0, default, mapping

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.items[self.at - 1] if self.at <= len(self.items) else ("end", "")

    def is_op(self, *signs: str) -> bool:
        return self.peek()[0] == "op" and self.peek()[1] in signs

    def whole(self) -> Node:
        out = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]}")
        return out

    def either(self) -> Node:
        parts = [self.both()]
        while self.is_op("|"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both(self) -> Node:
        parts = [self.order()]
        while self.is_op("&", "!", "(") or self.peek()[0] in ("phrase", "field", "word", "remap", "range"):
            if self.is_op("&"):
                self.take()
            parts.append(self.order())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def order(self) -> Node:
        out = self.unary()
        while self.is_op("<"):
            self.take()
            out = Node("ordered", [out, self.unary()])
        return out

    def unary(self) -> Node:
        if self.is_op("!"):
            self.take()
            return Node("not", [self.unary()])
        out = self.atom()
        while self.is_op("~", "^", "-", ">", "@"):
            sign = self.take()[1]
            if sign == "~":
                kind, n = self.take()
                if kind != "word" or not n.isdigit():
                    raise QueryError("~ needs a number")
                out = Node("within", [out], value=int(n))
            else:
                out = Node({"^": "aligned", "-": "difference", ">": "holding", "@": "inside"}[sign], [out, self.atom()])
        return out

    def atom(self, name: str = "", label: int | None = None) -> Node:
        kind, text = self.take()
        name = name or self.default
        if (kind, text) == ("op", "("):
            outer, self.default = self.default, name
            out = self.either()
            self.default = outer
            if self.take() != ("op", ")"):
                raise QueryError("missing )")
            out.label = label if label is not None else out.label
            return out
        if kind == "remap":
            # words that name no field are the first one's; fields share one axis of positions, so places need no conversion
            return Node("remap", [self.atom(text.split(" ")[0], label)], value=text.split(" "))
        if kind == "field":
            if re.fullmatch("[1-9][0-9]*", text):
                return self.atom(name, int(text))
            tag, _, prop = text.partition(".")
            if prop:
                if prop not in self.mapping.get(tag, {}):
                    raise QueryError(f"no property {text}")
                inner = self.atom(self.mapping[tag][prop])
                if inner.kind not in ("term", "prefix", "or", "range"):
                    raise QueryError(f"{text} has one value, so no phrase or order of words is in it")
                return Node("aligned", [inner, Node("term", field="nertag", value=tag)], label=label)
            return self.atom(text, label)
        if kind == "range":
            ends = [bound(x) if x else None for x in text.split(" ")]
            kinds = {e[0] for e in ends if e}
            if len(kinds) != 1 or any(x and not e for x, e in zip(text.split(" "), ends, strict=True)):
                raise QueryError("a range goes from one whole number or day (YYYY-MM-DD) to another")
            return Node("range", field=name, value=(kinds.pop(), *(e and e[1] for e in ends)), label=label)
        if kind == "phrase":
            words, gaps = [], []
            for w in text.split():
                gap = GAP.fullmatch(w)
                if not gap:
                    words.append(w)
                    gaps += [(0, 0)] * (len(words) - len(gaps))
                elif not words or len(gaps) > len(words):
                    raise QueryError("a gap stands between two words")
                else:
                    low, high = (int(gap[1]) if gap[2] else 0), int(gap[2] or gap[1] or ANY_GAP)
                    gaps.append((low, high))
            if not words or len(gaps) > len(words) or any(a > b for a, b in gaps):
                raise QueryError("a phrase needs words, and a gap two of them")
            if any(b for _, b in gaps):
                return Node("gapped", field=name, value=words, gaps=gaps, label=label)
            return Node("term" if len(words) == 1 else "phrase", field=name, value=words[0] if len(words) == 1 else words, label=label)
        if kind == "word" and text in ("_SENT_", "_PAR_"):
            return Node("bound", value=text)
        if kind == "word":
            return Node("prefix" if text.endswith("*") and len(text) > 1 else "term", field=name, value=text.rstrip("*") if len(text) > 1 else text, label=label)
        raise QueryError(f"unexpected {text or 'end'}")


def parse(text: str, default: str = "token", mapping: dict[str, dict[str, str]] = MAPPING) -> Node:
    return Parser(text, default, mapping).whole()


def words_of(node: Node) -> list[tuple[str, str, bool]]:
    """(field, word, by prefix) of a term, a prefix or the words of a phrase; bounds are postings of the empty term."""
    if node.kind == "bound":
        return [(node.value, "", False)]
    if node.kind == "range":
        return []
    return [(node.field, w, node.kind == "prefix") for w in (node.value if node.kind in ("phrase", "gapped") else [node.value])]


def all_nodes(node: Node) -> list[Node]:
    return [node, *(x for p in node.parts for x in all_nodes(p))]


def needed(node: Node) -> list[list[tuple[str, str, bool]]]:
    """Groups of words of which every document that matches has one each."""
    if node.kind in ("term", "prefix"):
        return [words_of(node)]
    if node.kind in ("phrase", "gapped"):
        return [[w] for w in words_of(node)]
    if node.kind == "or":
        return [[w for p in node.parts for w in words_of(p)]] if all(p.kind in ("term", "prefix") for p in node.parts) else []
    if node.kind == "difference":
        return needed(node.parts[0])
    return [] if node.kind in ("not", "range", "bound") else [g for p in node.parts if p.kind != "not" for g in needed(p)]


class Searcher:
    """Plans over a stored index, or over a token table (whose cells hold alternatives between bars if ``multi``)."""

    #: The rarest word leads if another is in so many times the documents; its parts are named if it is in so few.
    LEAD, NAMED = 8, 1000

    def __init__(self, source: DataFrame | TokenTable | StoredIndex, multi: bool = False, mapping: dict[str, dict[str, str]] = MAPPING):
        self.mapping = mapping
        self.source = TokenTable(source, multi) if isinstance(source, DataFrame) else source

    def wanted(self, *nodes: Node) -> list[tuple[str, str, bool]]:
        for n in nodes:
            if n.kind != "bound" and n.field not in self.source.names:
                raise QueryError(f"no field {n.field}")
        return [w for n in nodes for w in words_of(n)]

    def _single(self, node: Node, marks: bool) -> list[Node] | None:
        """The atoms of an operand that one scan can find beside others: a term, a prefix, a bound, or a choice of such."""
        if node.kind in ("term", "prefix", "bound"):
            return [node]
        if node.kind == "or" and all(p.kind in ("term", "prefix") and not (marks and p.label is not None) for p in node.parts):
            return node.parts
        return None

    def _labelled(self, df: DataFrame, node: Node, marks: bool) -> DataFrame:
        """Adds a node's label, which is at its last position."""
        if not marks:
            return df
        own = I.no_marks() if node.label is None else F.array(F.struct(F.lit(node.label).alias("label"), F.col("r").cast("int").alias("pos")))
        return df.withColumn("marks", F.concat("marks", own) if I.marked(df) else own)

    def operands(self, parts: list[Node], marks: bool, once: bool = False) -> DataFrame:
        """The intervals of several operands, numbered by k: those of one word or a choice of words come from one scan; if asked
        for, each of the first operand's once.
        """
        single = {i: atoms for i, p in enumerate(parts) if (atoms := self._single(p, marks)) is not None}
        rest = {i: self.plan(p, marks) for i, p in enumerate(parts) if i not in single}
        found = []
        if single:
            wanted = [(i, w) for i, atoms in single.items() for w in self.wanted(*atoms)]
            which = F.element_at(F.array(*[F.lit(i) for i, _ in wanted]), F.col("k") + 1)
            rows = self.source.hits([w for _, w in wanted]).select(*KEY, F.col("pos").alias("l"), F.col("pos").alias("r"), which.alias("k"))
            if marks:
                own = [F.when(F.col("k") == i, F.array(F.struct(F.lit(parts[i].label).alias("label"), F.col("r").cast("int").alias("pos")))) for i in single if parts[i].label is not None]
                rows = rows.withColumn("marks", F.coalesce(*own, I.no_marks()) if own else I.no_marks())
            found.append(rows)
            if once and 0 in single and (len(single[0]) > 1 or single[0][0].kind == "prefix"):
                found[0] = rows.distinct()
        for i, df in rest.items():
            found.append(df.withColumn("k", F.lit(i)))
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def plan(self, node: Node, marks: bool = False) -> DataFrame:
        """(part, doc_id, l, r) of a node, with ``marks`` also the labels met and where."""
        return self._labelled(self._plan(node, marks), node, marks)

    def _plan(self, node: Node, marks: bool) -> DataFrame:
        parts = node.parts
        single = self._single(node, marks)
        if single is not None and node.kind != "bound":
            return I.points(self.source.any_hits(self.wanted(*single)))
        if node.kind == "range":
            return I.points(self.source.range_hits(node.field, *node.value))
        if node.kind == "phrase":
            return I.phrase(self.source.hits(self.wanted(node)), len(node.value))
        if node.kind == "gapped":
            return I.gapped(self.source.hits(self.wanted(node)), node.gaps)
        if node.kind == "or":
            return I.antichain(self.operands(parts, marks))
        if node.kind == "and":
            gone, own = [p.parts[0] for p in parts if p.kind == "not"], [p for p in parts if p.kind != "not"]
            if not own:
                return self._plan(Node("not", [Node("or", gone)]), marks)
            if not gone:
                return I.all_tagged(self.operands(own, marks), len(own))
            if len(own) > 1:
                own = [Node("and", own)]
            return I.without(self.operands([*own, *gone], marks, once=True))
        if node.kind == "not":
            out = I.absent(self.source.documents, self.plan(parts[0]))
            return out.select(*KEY, F.lit(None).cast("int").alias("l"), F.lit(None).cast("int").alias("r"))
        if node.kind == "ordered":
            return I.ordered_tagged(self.operands(parts, marks))
        if node.kind == "within":
            return I.within(self.plan(parts[0], marks), node.value)
        if node.kind == "remap":
            if missing := [f for f in node.value if f not in self.source.columns]:
                raise QueryError(f"no field {missing[0]}")
            return self.plan(parts[0], marks)
        if node.kind == "aligned":
            return I.aligned_tagged(self.operands(parts, marks))
        if node.kind in ("difference", "holding", "inside"):
            if node.kind != "difference" and parts[1].kind == "bound":
                raise QueryError(f"{parts[1].value} stands after - alone")
            made = {"holding": I.holding_tagged, "inside": I.inside_tagged, "difference": I.unbroken_tagged if parts[1].kind == "bound" else I.difference_tagged}
            return made[node.kind](self.operands(parts, marks, once=True))
        raise QueryError(f"{node.kind} can't stand alone")

    def led(self, node: Node) -> Searcher:
        """The same search over the parts alone that the rarest word is in, if that leaves out much of another."""
        if not isinstance(self.source, StoredIndex) or len(groups := needed(node)) < 2:
            return self
        counts = iter(self.source.frequency([w for g in groups for w in g]))
        sums = [sum(next(counts) for _ in g) for g in groups]
        rare = min(range(len(groups)), key=sums.__getitem__)
        if sums[rare] * self.LEAD > max(sums):
            return self
        test = [(F.col("field") == f) & (F.col("term").startswith(w) if prefix else F.col("term") == w) for f, w, prefix in groups[rare]]
        parts = self.source.blocks(reduce(Column.__or__, test)).select("part").distinct()
        if sums[rare] <= self.NAMED:
            parts = [r.part for r in parts.collect()]
        return Searcher(self.source.among(parts), mapping=self.mapping)

    def matches(self, text: str, default: str = "token", marks: bool = False) -> DataFrame:
        """(part, doc_id, l, r) of all minimal intervals, with the labels that they carry if asked for."""
        tree = parse(text, default, self.mapping)
        nodes = all_nodes(tree)
        if marks and all(n.label is None for n in nodes):
            raise QueryError("no labels")
        self.wanted(*[n for n in nodes if n.kind in ("term", "prefix", "phrase", "gapped", "range")])
        return self.led(tree).plan(tree, marks)

    def search(self, text: str, default: str = "token") -> DataFrame:
        """(doc_id, l, r) of all minimal intervals, unranked."""
        return self.matches(text, default).select("doc_id", "l", "r")
