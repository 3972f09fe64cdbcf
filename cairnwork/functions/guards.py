"""Three-valued logic: native for columns, and a small evaluator for preprocessor conditions.

Null stands for unknown. SQL's AND, OR and NOT are Kleene's, so combining known statuses needs no
function of ours; only reading an expression does.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|\d+)([uUlL]*)|([A-Za-z_]\w*)|(<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^~!<>()]))")
#: Binary operators by precedence, loosest first.
_LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!=", "<", "<=", ">", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]


class Unreadable(Exception):
    """An expression that the evaluator does not read; its text says why."""


def _apply(op: str, a: int | None, b: int | None) -> int | None:
    if op == "&&":
        return 0 if a == 0 or b == 0 else None if a is None or b is None else 1
    if op == "||":
        return 1 if a or b else None if a is None or b is None else 0
    if a is None or b is None:
        return None
    if op in ("/", "%"):
        if b == 0:
            raise Unreadable("division_by_zero")
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return q if op == "/" else a - q * b
    if op in ("<<", ">>"):
        if b < 0:
            raise Unreadable("negative_shift")
        return a << min(b, 64) if op == "<<" else a >> b
    return {"|": a | b, "^": a ^ b, "&": a & b, "==": int(a == b), "!=": int(a != b), "<": int(a < b), "<=": int(a <= b), ">": int(a > b), ">=": int(a >= b), "+": a + b, "-": a - b, "*": a * b}[op]


def _value(name: str, macros: dict[str, str]) -> int | None:
    """A macro's number, through aliases; a macro without a value is 1; unknown if absent."""
    seen = set()
    while name in macros:
        if name in seen:
            raise Unreadable("macro_alias_cycle")
        seen.add(name)
        value = (macros[name] or "1").strip().strip("()").strip()
        if re.fullmatch(r"(0[xX][0-9a-fA-F]+|0|[1-9]\d*)[uUlL]*", value):
            return int(value.rstrip("uUlL"), 0)
        name = value
    return None


def evaluate(expression: str, macros: dict[str, str]) -> int | None:
    """The value of an ``#if`` expression, None if it depends on what is not known."""
    if "?" in expression or ":" in expression:
        raise Unreadable("ternary")
    tokens, at = [], 0
    text = expression.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise Unreadable("expression_syntax")
        tokens.append(found)
        at = found.end()
    names = [t[3] for t in tokens]
    if any(n and n != "defined" and i + 1 < len(tokens) and tokens[i + 1][4] == "(" for i, n in enumerate(names)):
        raise Unreadable("function_like_macro")
    place = 0

    def peek() -> str | None:
        return tokens[place][4] if place < len(tokens) else None

    def take() -> re.Match:
        nonlocal place
        if place >= len(tokens):
            raise Unreadable("expression_syntax")
        place += 1
        return tokens[place - 1]

    def unary() -> int | None:
        token = take()
        if token[4] in ("!", "-", "+", "~"):
            v = unary()
            return None if v is None else {"!": int(not v), "-": -v, "+": v, "~": ~v}[token[4]]
        if token[4] == "(":
            v = level(0)
            if take()[4] != ")":
                raise Unreadable("expression_syntax")
            return v
        if token[1]:
            if re.fullmatch(r"0\d+", token[1]):
                raise Unreadable("expression_syntax")
            return int(token[1], 0)
        if token[3] == "defined":
            name = take()
            if name[4] == "(":
                name = take()
                if take()[4] != ")":
                    raise Unreadable("expression_syntax")
            if not name[3]:
                raise Unreadable("expression_syntax")
            return 1 if name[3] in macros else None
        if token[3]:
            return _value(token[3], macros)
        raise Unreadable("expression_syntax")

    def level(depth: int) -> int | None:
        if depth == len(_LEVELS):
            return unary()
        left = level(depth + 1)
        while peek() in _LEVELS[depth]:
            op = take()[4]
            left = _apply(op, left, level(depth + 1))
            if depth == 5:
                break  # one comparison only: a < b < c is not read
        return left

    value = level(0)
    if place < len(tokens):
        raise Unreadable("expression_syntax")
    return value


def guard_status(directive: str, expression: str, macros: dict[str, str]) -> tuple[str, str]:
    """active, inactive or conditional, and why. A macro that is not known is conditional, not false."""
    try:
        if directive in ("ifdef", "ifndef"):
            known = expression.strip() in macros
            return ("active" if directive == "ifdef" else "inactive", "macro_known") if known else ("conditional", "macro_unknown")
        value = evaluate(expression, macros)
    except Unreadable as why:
        return "conditional", str(why)
    if value is None:
        return "conditional", "evaluation_unknown"
    return ("active" if value else "inactive"), "evaluated"


@lru_cache(maxsize=1024)
def _settings(told: str) -> dict[str, str]:
    return {e["key"]: e.get("value") for e in json.loads(told)}


@lru_cache(maxsize=8192)
def _known(directive: str, expression: str, told: str) -> tuple[str, str]:
    """``guard_status`` under settings told as JSON; files repeat the same conditions."""
    return guard_status(directive, expression, _settings(told))


@lru_cache(maxsize=1)
def _guard_udf():
    kind = pa.struct([("status", pa.string()), ("reason", pa.string())])

    @F.arrow_udf("struct<status:string,reason:string>")
    def run(directive: pa.Array, expression: pa.Array, macros: pa.Array) -> pa.Array:
        rows = zip(directive.to_pylist(), expression.to_pylist(), macros.to_pylist(), strict=True)
        return pa.array([_known(d or "if", e or "", m or "[]") for d, e, m in rows], kind)

    return run


def eval_guard(directive: Column, expression: Column, macros: Column) -> Column:
    """struct(status, reason) of a directive under a map of macros. Null inputs: ``if``, empty, no macros."""
    return _guard_udf()(directive, expression, F.to_json(F.map_entries(macros)))


#: Build statuses from weakest to strongest claim on a line.
STATUS_RANK = {"active": 0, "conditional": 1, "inactive": 2}


def combine(*statuses: Column) -> Column:
    """Status of a line under nested guards: inactive beats conditional beats active."""
    ranks = [F.when(s == "inactive", 2).when(s == "conditional", 1).otherwise(0) for s in statuses]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.when(top == 2, "inactive").when(top == 1, "conditional").otherwise("active")
