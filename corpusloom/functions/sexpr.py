"""S-expressions over token fields, compiled to Column expressions: no code runs per row outside the engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s*(?:(\()|(\))|(\')|"((?:[^"\\]|\\.)*)"|#\\([^\s()]+|.)|([^\s()\'"]+))', re.S)


def nil() -> Column:
    return F.lit(None).cast("string")


class Failure(Exception):
    """An expression that can't be compiled."""


class Symbol(str):
    """A name in an expression."""


def parse(text: str) -> list:
    """Expressions of a text as nested lists; strings are one-tuples, characters have a # as second part."""
    stack: list[list] = [[]]
    quotes: list[int] = []
    at = 0
    text = text.rstrip()

    def add(x):
        stack[-1].append(x)
        while quotes and quotes[-1] == len(stack):
            quotes.pop()
            stack[-1][-1] = [Symbol("quote"), stack[-1][-1]]

    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Failure(f"unreadable at {at}")
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise Failure("unbalanced )")
            done = stack.pop()
            add(done)
        elif m[3]:
            quotes.append(len(stack))
        elif m[4] is not None:
            add((re.sub(r"\\(.)", r"\1", m[4]),))
        elif m[5] is not None:
            add(({"Space": " ", "Newline": "\n"}.get(m[5], m[5]), "#"))
        else:
            add(Symbol(m[6]))
    if len(stack) > 1:
        raise Failure("unbalanced (")
    return stack[0]


BUILT_IN = ("quote", "lambda", "defun", "set", "setq", "progn", "eval", "if", "eq", "and", "or", "concatenate", "subst", "replace", "split", "atom", "car", "cdr", "cons", "first", "last")
#: Calls within calls; functions are expanded, so one that calls itself without a constant to end on has no end.
DEEPEST = 60


class Refused(Exception):
    """An expression that nothing within it can make up for."""


@dataclass
class Cell:
    """What is known only of a row: its value, a text or a list of texts, and the error met instead, null where there is none; ``sure`` is never NIL."""

    value: Column
    error: Column | None = None
    is_list: bool = False
    sure: bool = False

    def sound(self) -> Column:
        """The value where there is no error."""
        return self.value if self.error is None else F.when(self.error.isNull(), self.value)


def either(*cells) -> Column | None:
    """The first error of some values."""
    errors = [c.error for c in cells if isinstance(c, Cell) and c.error is not None]
    return F.coalesce(*errors) if errors else None


class Compiler:
    """Compiles with fields as variables; functions are expanded where they are called.

    Values that are known are Python's own: None for NIL, True for T, one-tuples for texts, lists; others are cells.
    """

    def __init__(self, variable: Callable[[str], Column | None]):
        self.variable, self.functions, self.depth = variable, {}, 0

    def compile(self, text: str) -> Column:
        out, env = None, {}
        for form in parse(text):
            out = self.run(form, env)
        if isinstance(out, Cell) and out.error is not None:
            return F.coalesce(F.concat(F.lit("<error: "), out.error, F.lit(">")), self.column(out))
        return self.column(out)

    @staticmethod
    def column(x) -> Column:
        """A value as text."""
        if isinstance(x, Cell):
            return F.concat(F.lit("("), F.array_join(x.value, " ", "NIL"), F.lit(")")) if x.is_list else x.value
        if isinstance(x, tuple):
            return F.lit(x[0])
        if x is True:
            return F.lit("")
        if x is None or x == []:
            return nil()
        if isinstance(x, Symbol):
            return F.lit(x.upper())
        if isinstance(x, list):
            return F.concat(F.lit("("), *[y for i, v in enumerate(x) for y in ([F.lit(" ")] if i else []) + [F.coalesce(Compiler.column(v), F.lit("NIL"))]], F.lit(")"))
        raise Failure(f"not a value: {x}")

    def run(self, form, env: dict):
        if isinstance(form, (tuple, Cell)):
            return form
        if isinstance(form, Symbol):
            name = form.lower()
            if name in ("nil", "t"):
                return None if name == "nil" else True
            if name in env:
                return env[name]
            found = self.variable(name)
            if found is None:
                raise Failure(f"unbound {form}")
            return Cell(found)
        if not form:
            return None
        head, *args = form
        if isinstance(head, list):
            return self.call(self.run(head, env), [self.run(a, env) for a in args], env)
        name = head.lower()
        if name in BUILT_IN:
            return getattr(self, f"_{name}")(args, env)
        if name in self.functions:
            return self.call(self.functions[name], [self.run(a, env) for a in args], env)
        raise Failure(f"undefined {head}")

    def call(self, fn, values: list, env: dict):
        if not (isinstance(fn, tuple) and fn[0] == "lambda"):
            raise Failure("not a function")
        _, names, body, scope = fn
        own, kind, i = dict(scope), None, 0
        for name in names:
            if name.lower() in ("&optional", "&rest"):
                kind = name.lower()
            elif kind == "&rest":
                own[name.lower()], i = values[i:], len(values)
            elif i < len(values):
                own[name.lower()], i = values[i], i + 1
            elif kind == "&optional":
                own[name.lower()] = None
            else:
                raise Failure("too few arguments")
        if i < len(values):
            raise Failure("too many arguments")
        self.depth += 1
        if self.depth > DEEPEST:
            raise Refused("a function calls itself without end")
        out = None
        for x in body:
            out = self.run(x, own)
        self.depth -= 1
        return out

    def _quote(self, a, env):
        return a[0]

    def _lambda(self, a, env):
        return ("lambda", a[0], a[1:], env)

    def _defun(self, a, env):
        self.functions[a[0].lower()] = ("lambda", a[1], a[2:], {})
        return None

    def _set(self, a, env):
        name = self.run(a[0], env)
        env[str(name).lower()] = out = self.run(a[1], env)
        return out

    def _setq(self, a, env):
        env[a[0].lower()] = out = self.run(a[1], env)
        return out

    def _progn(self, a, env):
        out = None
        for x in a:
            out = self.run(x, env)
        return out

    def _eval(self, a, env):
        return self.run(self.run(a[0], env), env)

    def _if(self, a, env):
        test = self.run(a[0], env)
        if not isinstance(test, Cell):
            chosen = a[1:2] if test not in (None, []) else a[2:3]
            return self.run(chosen[0], env) if chosen else None
        yes, no = self.run(a[1], env), self.run(a[2], env) if len(a) > 2 else None
        holds, lists = test.value.isNotNull(), any(isinstance(x, Cell) and x.is_list for x in (yes, no))
        own = [self.array(x) if lists else self.column(x) for x in (yes, no)]
        error = None
        if any(isinstance(x, Cell) and x.error is not None for x in (test, yes, no)):
            branch = [x.error if isinstance(x, Cell) and x.error is not None else nil() for x in (yes, no)]
            error = F.coalesce(nil() if test.error is None else test.error, F.when(holds, branch[0]).otherwise(branch[1]))
        return Cell(F.when(holds, own[0]).otherwise(own[1]), error, lists)

    def _eq(self, a, env):
        x, y = (self.run(v, env) for v in a)
        if any(isinstance(v, tuple) and len(v) > 1 for v in (x, y)) and any(isinstance(v, Cell) for v in (x, y)):
            return None  # a field is a string, never a character
        if isinstance(x, Cell) or isinstance(y, Cell):
            return Cell(F.when(self.column(x).eqNullSafe(self.column(y)), F.lit("")), either(x, y))
        return True if x == y else None

    def _and(self, a, env):
        found = []
        for x in a:  # from left to right, so that later arguments see what earlier ones set
            try:
                found.append(self.run(x, env))
            except Failure:
                return None
        if any(x in (None, []) for x in found if not isinstance(x, Cell)):
            return None
        cells = [x for x in found if isinstance(x, Cell)]
        if not cells:
            return found[-1] if found else True
        last = found[-1]
        lists = isinstance(last, Cell) and last.is_list
        hold = reduce(Column.__and__, [x.sound().isNotNull() for x in cells])
        return Cell(F.when(hold, self.array(last) if lists else self.column(last)), None, lists)

    def _or(self, a, env):
        found = []
        for x in a:
            try:
                found.append(self.run(x, env))
            except Failure:
                continue
            if not isinstance(found[-1], Cell) and found[-1] not in (None, []):
                break
        found = [x for x in found if x not in (None, [])] if not any(isinstance(x, Cell) for x in found) else [x for x in found if isinstance(x, Cell) or x not in (None, [])]
        if not found or not isinstance(found[0], Cell):
            return found[0] if found else None
        lists = all(not isinstance(x, Cell) or x.is_list for x in found) and any(isinstance(x, Cell) for x in found)
        sound = [Cell(x.sound(), None, x.is_list) if isinstance(x, Cell) else x for x in found]
        return Cell(F.coalesce(*[self.array(x) if lists else self.column(x) for x in sound]), None, lists, any(not isinstance(x, Cell) or x.sure for x in sound))

    def _concatenate(self, a, env):
        found = [self.run(x, env) for x in a]
        if any(x in (None, []) for x in found if not isinstance(x, Cell)):
            raise Failure("concatenate: NIL is no string")
        cells = [x for x in found if isinstance(x, Cell)]
        if not cells:
            return ("".join(x[0] for x in found),) if all(isinstance(x, tuple) for x in found) else Cell(F.concat(*map(self.column, found)))
        errors, open_ = [x.error for x in cells if x.error is not None], [x.value.isNull() for x in cells if not x.sure]
        if open_:
            errors.append(F.when(reduce(Column.__or__, open_), F.lit("concatenate: NIL is no string")))
        return Cell(F.concat(*[self.column(x) for x in found]), F.coalesce(*errors) if errors else None, sure=not errors)

    def _subst(self, a, env):
        old, new, text = (self.run(x, env) for x in a)
        return Cell(F.replace(self.column(text), self.column(old), self.column(new)), either(old, new, text))

    def _replace(self, a, env):
        old, new, text = (self.run(x, env) for x in a)
        return Cell(F.replace(self.column(text), self.column(old), self.column(new)), either(old, new, text))

    def _split(self, a, env):
        """The parts of a text between separators; NIL of NIL."""
        by, text = (self.run(x, env) for x in a)
        if not isinstance(by, tuple):
            raise Failure("split: the separator is a text")
        return Cell(F.split(self.column(text), re.escape(by[0])), either(text), True)

    def _atom(self, a, env):
        x = self.run(a[0], env)
        if isinstance(x, Cell):
            return Cell(F.when(x.value.isNull(), F.lit("")), x.error) if x.is_list else True
        return None if isinstance(x, list) and x else True

    def array(self, x) -> Column:
        """A value as an array of texts."""
        if isinstance(x, Cell) and x.is_list:
            return x.value
        if x is not None and not isinstance(x, list):
            raise Failure("not a list")
        return F.array(*[self.column(y) for y in x]).cast("array<string>") if x else F.lit(None).cast("array<string>")

    def list_of(self, a, env):
        found = self.run(a[0], env)
        if isinstance(found, Cell) and found.is_list:
            return found
        if found is not None and not isinstance(found, list):
            raise Failure("not a list")
        return found or []

    def _car(self, a, env):
        x = self.list_of(a, env)
        return Cell(F.get(x.value, F.lit(0)), x.error) if isinstance(x, Cell) else next(iter(x), None)

    _first = _car

    def _cdr(self, a, env):
        x = self.list_of(a, env)
        if isinstance(x, Cell):
            return Cell(F.when(F.size(x.value) > 1, F.slice(x.value, 2, F.greatest(F.size(x.value), F.lit(1)))), x.error, True)
        return x[1:] or None

    def _last(self, a, env):
        x = self.list_of(a, env)
        return Cell(F.get(x.value, F.size(x.value) - 1), x.error) if isinstance(x, Cell) else next(iter(x[-1:]), None)

    def _cons(self, a, env):
        one, rest = self.run(a[0], env), self.list_of(a[1:], env)
        if isinstance(rest, Cell):
            return Cell(F.concat(F.array(self.column(one)), F.coalesce(rest.value, F.array().cast("array<string>"))), either(one, rest), True)
        return [one, *rest]


def compile_expression(text: str, fields: Callable[[str], Column | None]) -> Column:
    """Value of the expression; an error shows in the rows that meet it, or in all if the expression can't be compiled."""
    try:
        return Compiler(fields).compile(text)
    except (Failure, Refused) as e:
        return F.lit(f"<error: {e}>")
