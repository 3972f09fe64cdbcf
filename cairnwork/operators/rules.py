"""Rule tables: what an API's name says, wording that a policy forbids, claims that prose makes."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import short_name

#: Absolute and speculative wording (ASCII word borders, so that engines agree).
ABSOLUTE = r"(?i)(?:^|[^A-Za-z0-9_])(always|never|definitely|certainly|guaranteed|all|none)(?:$|[^A-Za-z0-9_])"
SPECULATIVE = r"(?i)(?:^|[^A-Za-z0-9_])(i (?:think|guess|assume))(?:$|[^A-Za-z0-9_])"

_NAME, _PATH = r"`?(?P<{}>[A-Za-z_~][\w:~]*+)(?:\(\))?+`?", r"`?(?P<{}>[\w./+-]*\w\.\w++)`?"
_S, _O, _SP, _OP = _NAME.format("s"), _NAME.format("o"), _PATH.format("s"), _PATH.format("o")
_NOT = r"(?:does not|doesn't|cannot|can't|never)"
_ONE = r"`?[A-Za-z_~][\w:~]*+(?:\(\))?+`?(?! (?:calls|reaches|includes|is|does|derives|has)\b)"
_MORE = rf"(?P<more>(?:,? and {_ONE}|, {_ONE}(?=,| and ))*)"

#: Patterns of claims (type, whether the claim holds or is denied, pattern), tried in this order; what one has taken no
#: later one takes. Groups s and o are subject and object, more are further objects.
CLAIM_PATTERNS = [
    ("calls", "negative", rf"{_S} {_NOT} calls? {_O}"),
    ("calls", "positive", rf"{_S} calls {_O}{_MORE}"),
    ("calls", "positive", rf"{_O} is called (?:by|from) {_S}"),
    ("reaches", "negative", rf"{_S} {_NOT} reach(?:es)? {_O}"),
    ("reaches", "positive", rf"{_S} (?:reaches|can reach|leads to) {_O}{_MORE}"),
    ("includes", "negative", rf"{_SP} {_NOT} includes? {_OP}"),
    ("includes", "positive", rf"{_SP} includes {_OP}"),
    ("inherits", "negative", rf"{_S} {_NOT} (?:derive|inherit)s? from {_O}"),
    ("inherits", "positive", rf"{_S} (?:derives|inherits) from {_O}"),
    ("inherits", "positive", rf"{_S} is a subclass of {_O}"),
    ("build_active", "negative", rf"{_S} is (?:not active|inactive) in the (?:target )?build"),
    ("build_active", "positive", rf"{_S} is active in the (?:target )?build"),
    ("definition_exists", "negative", rf"{_S} (?:is (?:not|never) defined|has no definition)"),
    ("definition_exists", "positive", rf"{_S} (?:is defined|has a definition)"),
]

#: A pack of API rules: name, predicate, operation, relation.
FILE_RULES = [
    ("fopen", "opens_file", "open", "file_io"), ("fread", "reads_file", "read", "file_io"), ("fwrite", "writes_file", "write", "file_io"), ("fclose", "closes_file", "close", "file_io"),
    ("malloc", "allocates_heap_memory", "allocate", "heap"), ("free", "frees_heap_memory", "free", "heap"), ("taskENTER_CRITICAL", "enters_critical_section", "enter", "scheduler"), ("taskEXIT_CRITICAL", "exits_critical_section", "exit", "scheduler"),
]


def apply_rules(calls: DataFrame, rules: DataFrame, callee: str, api: str = "api") -> DataFrame:
    """Calls with the rule of their short callee name; calls without a rule fall away."""
    return calls.withColumn("__short", short_name(F.col(callee))).join(rules, F.col("__short") == F.col(api)).drop("__short")


def wording(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, absolute, speculative: how often each wording occurs."""
    return texts.select(*keys, F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(ABSOLUTE)).cast("long").alias("absolute"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SPECULATIVE)).cast("long").alias("speculative"))


def claims_in(text: str) -> list[tuple[str, str, str, str, int, int]]:
    """(type, polarity, subject, object, begin, end) of the claims in a text, by their places."""
    taken, out = bytearray(len(text)), []
    for kind, polarity, pattern in _compiled():
        for found in pattern.finditer(text):
            begin, end = found.span()
            if any(taken[begin:end]):
                continue
            taken[begin:end] = b"\1" * (end - begin)
            groups = found.groupdict()
            objects = [groups.get("o") or "", *re.findall(r"[A-Za-z_~][\w:~]*", re.sub(r"(?:^|,)\s*and\b|,", " ", re.sub(r"\band\b", " ", groups.get("more") or "")))]
            out += [(kind, polarity, groups["s"], o, begin, end) for o in objects]
    return sorted(out, key=lambda c: c[4:6])


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[str, str, re.Pattern]]:
    return [(kind, polarity, re.compile(pattern)) for kind, polarity, pattern in CLAIM_PATTERNS]


@lru_cache(maxsize=1)
def _claims_udf():
    @F.pandas_udf("array<struct<claim_type:string,polarity:string,subject:string,object:string,span_start:int,span_end:int>>")
    def run(text: pd.Series) -> pd.Series:
        names = ("claim_type", "polarity", "subject", "object", "span_start", "span_end")
        return text.map(lambda t: [dict(zip(names, c, strict=True)) for c in claims_in(t or "")])

    return run


def claims_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, claim_type, polarity, subject, object, span_start, span_end, place (their order) of the claims that prose makes.

    ``A calls B, C and D`` is three claims. A null text makes none.
    """
    return texts.select(key, F.posexplode(_claims_udf()(F.col(text))).alias("place", "c")).select(key, "c.*", "place")
