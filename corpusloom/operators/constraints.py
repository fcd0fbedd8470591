"""Constraints between labelled matches (1.nerid != 2.nerid, 1.param2 = word), as one boolean Column per match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.entities import MAPPING

LEX = re.compile(r"\s*(?:(\d+)\.([A-Za-z_]\w*(?:\.\w+)?)|(>=|<=|!=|=|<|>)|([&|()])|\"([^\"]*)\"|([^\s&|()<>=!\"]+))")


class ConstraintError(ValueError):
    """A constraint that can't be read."""


def parse(text: str):
    """Nested tuples: ("and"|"or", left, right) or (op, (label, field), word or (label, field)); AND binds tighter."""
    items, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEX.match(text, at)
        if not m:
            raise ConstraintError(f"unreadable at {at}")
        at = m.end()
        if m[1]:
            items.append(("ref", (int(m[1]), m[2])))
        elif m[3]:
            items.append(("op", m[3]))
        elif m[4]:
            items.append(("sign", m[4]))
        elif m[5] is not None:
            items.append(("word", m[5]))
        else:
            items.append(("sign", "&") if m[6].lower() == "and" else ("sign", "|") if m[6].lower() == "or" else ("word", m[6]))
    items.append(("end", ""))
    items.reverse()

    def either():
        out = both()
        while items[-1] == ("sign", "|"):
            items.pop()
            out = ("or", out, both())
        return out

    def both():
        out = one()
        while items[-1] == ("sign", "&"):
            items.pop()
            out = ("and", out, one())
        return out

    def one():
        if items[-1] == ("sign", "("):
            items.pop()
            out = either()
            if items.pop() != ("sign", ")"):
                raise ConstraintError("missing )")
            return out
        (kind, ref), (is_op, op), (right_kind, right) = (items.pop() if items else ("end", "") for _ in range(3))
        if kind != "ref" or is_op != "op" or right_kind not in ("ref", "word"):
            raise ConstraintError("expected label.field, a comparison and a value")
        return (op, ref, right)

    out = either()
    if items[-1][0] != "end":
        raise ConstraintError(f"unexpected {items[-1][1]}")
    return out


def _field(name: str, mapping: dict[str, dict[str, str]]) -> str:
    """The field that a name means: a tag's property is one of its params."""
    tag, _, prop = name.partition(".")
    if prop and prop not in mapping.get(tag, {}):
        raise ConstraintError(f"no property {name}")
    return mapping[tag][prop] if prop else name


def _equal(a: Column, b: Column) -> Column:
    """Null equals null alone; cells are equal if they share an alternative."""
    share = F.arrays_overlap(F.split(a, r"\|"), F.split(b, r"\|"))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(share)


def _number(a: Column, b: Column, op: str) -> Column:
    x, y = a.try_cast("int"), b.try_cast("int")
    return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))


def condition(tree, matches: Column, mapping: dict[str, dict[str, str]] = MAPPING) -> Column:
    """Whether an array of matches (structs of label, pos and fields) meets the constraint."""
    op, left, right = tree
    if op in ("and", "or"):
        a, b = condition(left, matches, mapping), condition(right, matches, mapping)
        return a & b if op == "and" else a | b
    own, name = F.filter(matches, lambda m: m["label"] == left[0]), _field(left[1], mapping)
    if isinstance(right, str):
        if op in ("=", "!="):
            same = F.exists(own, lambda m: F.coalesce(_equal(m[name], F.lit(right)), F.lit(False)))
            return (F.size(own) > 0) & (same if op == "=" else ~same)
        return F.exists(own, lambda m: _number(m[name], F.lit(right), op))
    other, other_name = F.filter(matches, lambda m: m["label"] == right[0]), _field(right[1], mapping)

    def pair(test) -> Column:
        return F.exists(own, lambda m: F.exists(other, lambda n: (m["pos"] != n["pos"]) & F.coalesce(test(m[name], n[other_name]), F.lit(False))))

    # an absent label meets no comparison at all; of labels that are there, != holds unless two different positions are equal,
    # so also where there is no pair of different positions
    there = (F.size(own) > 0) & (F.size(other) > 0)
    if op == "=":
        return there & pair(_equal)
    return there & ~pair(_equal) if op == "!=" else there & pair(lambda a, b: _number(a, b, op))


def fields_of(tree, mapping: dict[str, dict[str, str]] = MAPPING) -> set[str]:
    """Fields that a constraint reads."""
    if tree[0] in ("and", "or"):
        return fields_of(tree[1], mapping) | fields_of(tree[2], mapping)
    return {_field(x[1], mapping) for x in tree[1:] if isinstance(x, tuple)}


def constrained(found: DataFrame, source, text: str, mapping: dict[str, dict[str, str]] = MAPPING) -> DataFrame:
    """(part, doc_id, l, r) of the intervals whose own labelled matches meet the constraint.

    Intervals (doc_id, l, r, marks) bring the labels and positions of the atoms they are made of. Their values are taken
    from ``source``'s arrays of documents, so only intervals are shuffled, never tokens; a match that lies in an interval but isn't
    its own doesn't count.
    """
    tree = parse(text)
    fields = sorted(fields_of(tree, mapping))
    if missing := [f for f in fields if f not in source.columns]:
        raise ConstraintError(f"no field {missing[0]}")
    rows = source.beside(found.select("doc_id", "l", "r", "marks"), fields)
    value = lambda m: F.struct(m["label"].alias("label"), m["pos"].alias("pos"), *[F.get(F.col(f), m["pos"]).alias(f) for f in fields])
    each = F.transform("found", lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r"), F.transform(x["marks"], value).alias("matches")))
    return rows.select("part", "doc_id", F.explode(each).alias("x")).select("part", "doc_id", "x.*").where(condition(tree, F.col("matches"), mapping)).select("part", "doc_id", "l", "r")
