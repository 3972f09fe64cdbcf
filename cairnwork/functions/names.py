"""Name and path matching as column expressions. The relations differ on purpose; none replaces another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments that tell a file's role, in order of precedence.
ROLE_SEGMENTS = {
    "vendor": ["vendor", "vendors", "third_party", "third-party", "external", "extern", "deps", "dependencies"],
    "generated": ["generated", "gen", "autogen", "auto_generated", "build", "out"],
    "test": ["test", "tests", "unittest", "unit_test", "gtest", "spec", "specs"],
}


def head(name: Column) -> Column:
    """What stands before the first ``(``."""
    return F.split_part(name, F.lit("("), F.lit(1))


def short_name(name: Column, sep: str = "::") -> Column:
    return F.element_at(F.split(name, F.regexp_replace(F.lit(sep), r"([.])", r"\\$1")), -1)


def _ends(name: Column, query: Column, sep: str) -> Column:
    return F.endswith(name, F.concat(F.lit(sep), query))


def matches_name(name: Column, query: Column, sep: str = "::") -> Column:
    """One direction: the name, or its head before ``(``, is the query or ends with separator and query.

    An empty or null query matches nothing; a null name does not match.
    """
    found = (name == query) | _ends(name, query, sep) | (name.contains("(") & ((head(name) == query) | _ends(head(name), query, sep)))
    return F.coalesce(found & (query != ""), F.lit(False))


def matches_either(name: Column, query: Column, sep: str = "::") -> Column:
    """Both directions, or equal last segments, so that ``a::f`` matches ``b::f``."""
    a, b = head(name), head(query)
    return F.coalesce((a == b) | _ends(a, b, sep) | _ends(b, a, sep) | (short_name(a, sep) == short_name(b, sep)), F.lit(False))


def matches_any(values: list[Column], query: Column, sep: str = "::") -> Column:
    """``matches_name`` over several columns of a row."""
    out = F.lit(False)
    for value in values:
        out = out | matches_name(value, query, sep)
    return out


def normal_path(path: Column) -> Column:
    """Forward slashes, and no ``./`` in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def matches_path(path: Column, wanted: Column) -> Column:
    """Equal paths, or one ends with the other at a slash."""
    a, b = normal_path(path), normal_path(wanted)
    return F.coalesce((a == b) | _ends(a, b, "/") | _ends(b, a, "/"), F.lit(False))


def suffixes(name: Column, sep: str = "::") -> Column:
    """All suffixes of a name that begin at a separator, the whole name first: keys of an equi-join.

    Joining on them replaces a join on ``endswith``, which would compare every pair.
    """
    parts = F.split(name, sep.replace(".", r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), sep))


def path_role(path: Column, segments: dict[str, list[str]] = ROLE_SEGMENTS) -> Column:
    """vendor, generated, test or project by the path's segments; the first role that has one wins."""
    parts = F.split(F.lower(path), "/")
    out = F.lit("project")
    for role, names in reversed(segments.items()):
        out = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, names))), F.lit(role)).otherwise(out)
    return out


def symbol_id(identity: Column) -> Column:
    return F.concat(F.lit("sym_"), F.substring(F.sha1(identity), 1, 16))


def slug(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore stay; runs of others become one underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def clean_endpoint(text: Column) -> Column:
    """A name as prose writes it: without quotes, closing punctuation and a trailing ``()``."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^[`'\"]+|[`'\".,;:!?、。]+$", ""), r"\(\)$", "")
