"""Names in scopes: a type's name means what the innermost scope around its use has by that name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import bare_type
from ..functions.names import short_name, suffixes
from . import graph
from .tables import stored


def outer(name: Column) -> Column:
    """The scope that a qualified name is in, empty for the global one."""
    return F.regexp_replace(name, r"(^|::)~?[^:]*$", "")


def enclosing(scope: Column) -> Column:
    """The scope and those around it, the innermost first, the global one (empty) last; null is global."""
    parts = F.split(F.coalesce(scope, F.lit("")), "::")
    return F.array_distinct(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "::")))


def full_names(uses: DataFrame, known: DataFrame) -> DataFrame:
    """scope, name, full of the distinct ``uses`` (scope, name) of names, among the ``known`` ones (full).

    The innermost scope around the use that has the name decides; if none has, the only known name that ends with it;
    else the name stays as it is. Two equi-joins: on the names that the scopes around would give, and on suffixes.
    """
    asked = uses.select(F.coalesce("scope", F.lit("")).alias("scope"), "name").filter("name is not null").distinct()
    known = known.select("full").filter("full <> ''").distinct()
    tried = asked.select("scope", "name", F.posexplode(enclosing(F.col("scope"))).alias("far", "around"))
    tried = tried.withColumn("full", F.concat_ws("::", F.nullif("around", F.lit("")), "name"))
    inner = tried.join(known, "full").groupBy("scope", "name").agg(F.min_by("full", "far").alias("inner"))
    ends = known.select("full", F.explode(suffixes(F.col("full"), "::")).alias("name")).groupBy("name").agg(F.min("full").alias("only"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return asked.join(inner, ["scope", "name"], "left").join(ends, "name", "left").select("scope", "name", F.coalesce("inner", "only", "name").alias("full"))


def type_names(facts: DataFrame) -> DataFrame:
    """full: classes and aliases, and what methods and fields belong to, if no class goes by that short name."""
    named = facts.filter("fact_type in ('type', 'alias')").select(F.col("subject").alias("full"))
    owners = facts.filter("fact_type = 'field'").select(F.col("subject").alias("full")).unionByName(facts.filter("fact_type = 'symbol'").select(outer(F.col("subject")).alias("full"))).filter("full <> ''").distinct()
    short = named.select(short_name(F.col("full")).alias("short")).distinct()
    return named.unionByName(owners.join(short, short_name(F.col("full")) == F.col("short"), "left_anti")).distinct()


def types_meant(uses: DataFrame, facts: DataFrame) -> DataFrame:
    """scope, name, full of the type names in ``uses`` (scope, name) and of what aliases stand for, with aliases followed to their ends.

    An alias whose chain runs in a circle stays as it is. All names are looked up together, once.
    """
    aliases = facts.filter("fact_type = 'alias'").select("subject", outer(F.col("subject")).alias("scope"), bare_type(F.col("object")).alias("name")).distinct()
    asked = uses.select("scope", "name").unionByName(aliases.select("scope", "name"))
    meant = stored(full_names(asked, stored(type_names(facts))))
    ends = graph.alias_closure(aliases.join(meant.withColumnRenamed("full", "target"), ["scope", "name"]).filter("subject <> target"), "subject", "target").filter("final is not null").select(F.col("name").alias("alias"), "final")
    return meant.join(ends, F.col("full") == F.col("alias"), "left").select("scope", "name", F.coalesce("final", "full").alias("full"))


def derivations(facts: DataFrame) -> DataFrame:
    """src, scope, name: each class with the names of its bases, and the scope that these are meant in."""
    return facts.filter("fact_type = 'inherits'").select(F.col("subject").alias("src"), outer(F.col("subject")).alias("scope"), bare_type(F.col("object")).alias("name")).distinct()


def bases(facts: DataFrame, meant: DataFrame | None = None) -> DataFrame:
    """of, base, hops: each class with itself (0 hops) and all that it derives from, by the fewest steps.

    meant: ``types_meant`` of uses that hold the ``derivations``, if known.
    """
    said = derivations(facts)
    edges = said.join(types_meant(said, facts) if meant is None else meant, ["scope", "name"]).select("src", F.col("full").alias("dst"))
    return graph.reach(edges, edges.select(F.col("src").alias("start"))).select(F.col("start").alias("of"), F.col("node").alias("base"), "hops")


def inherited(own: DataFrame, above: DataFrame, value: str) -> DataFrame:
    """of, member, value: members (of, member, value) of each class and those it gets from the nearest base that has them.

    A member with several values at that distance has none.
    """
    mine = own.select("of", "member", value, F.lit(0).alias("hops"))
    got = above.filter("hops > 0").join(own.withColumnRenamed("of", "base"), "base").select("of", "member", value, "hops")
    each = mine.unionByName(got).groupBy("of", "member", "hops").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return each.groupBy("of", "member").agg(F.min_by(F.struct("lo", "hi"), "hops").alias("v")).filter("v.lo = v.hi").select("of", "member", F.col("v.lo").alias(value))
