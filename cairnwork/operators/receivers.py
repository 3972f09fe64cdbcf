"""What type a member call's receiver has: joins for each step of its chain, over the calls that have such a step.

A step finds the type of a name: of the first, among the bindings of the function in its file, then the fields of the
classes around it; of the others, among the members of the type so far, own or inherited. Types are compared by their
full names, found from the scope of each use (``scopes``); a name with several types is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import bare_type
from ..functions.names import short_name
from . import graph, scopes
from .tables import cut

#: Fixed value: calls whose receivers have types.
ON_RECEIVER = "receiver is not null and kind in ('member', 'chained')"


def _unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, type of the names that have one type only."""
    return rows.groupBy(*keys).agg(F.min("type").alias("type"), F.max("type").alias("__x")).filter("type = __x").drop("__x")


def receiver_types(facts: DataFrame) -> DataFrame:
    """path, line, subject, receiver, object, argc, type (short name, null if unknown), full, holder of every call on a receiver.

    full: the type's full name. holder: the class that has the method, the type itself or the nearest base; null if
    none is known to have it.
    """
    calls = facts.filter(f"fact_type = 'call' and {ON_RECEIVER}").select("path", "line", "subject", "receiver", "object", "argc", "detail").distinct()
    return typed(calls, facts).select("path", "line", "subject", "receiver", "object", "argc", "type", "full", "holder")


def typed(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """``calls`` on receivers (path, subject, receiver, object, detail and any others) with type, full and holder as in ``receiver_types``."""
    # Every type name and owner that occurs, with the scope it occurs in, is looked up once.
    around = scopes.outer(F.col("subject"))
    fields = facts.filter("fact_type = 'field'").select("subject", F.col("subject").alias("owner"), F.col("object").alias("member"), F.col("subject").alias("scope"), bare_type(F.col("type")).alias("name"))
    methods = facts.filter("fact_type = 'symbol'").select("subject", around.alias("owner"), F.concat(short_name(F.col("subject")), F.lit("()")).alias("member"), around.alias("scope"), bare_type(F.col("type")).alias("name"))
    bound = facts.filter("fact_type = 'binding'").select("path", F.col("subject").alias("fn"), F.col("object").alias("var"), around.alias("scope"), bare_type(F.col("type")).alias("name"))
    # A method's class: what its qualified name says, or the scope around its definition.
    asked = calls.select("path", "subject", "receiver", "detail").distinct().withColumns({"steps": F.split("receiver", r"\."), "owner": F.coalesce(F.nullif(around, F.lit("")), "detail")})
    said = fields.unionByName(methods)
    uses = said.select("scope", "name").unionByName(bound.select("scope", "name"))
    uses = uses.unionByName(scopes.derivations(facts).select("scope", "name"))
    for owned in (said, asked):
        uses = uses.unionByName(owned.select(F.lit("").alias("scope"), F.col("owner").alias("name")))
    meant = cut(scopes.types_meant(uses, facts))
    types = meant.withColumnRenamed("full", "type")
    owners = meant.filter("scope = ''").select(F.col("name").alias("owner"), F.col("full").alias("of"))

    every = said.join(owners, "owner", "left").withColumn("of", F.coalesce("of", "owner"))
    above = cut(scopes.bases(facts, meant))
    known = cut(scopes.inherited(_unique(every.filter("name is not null").join(types, ["scope", "name"]), ["of", "member"]), above, "type"))
    has = every.filter(F.endswith("member", F.lit("()"))).select("of", "member", F.col("of").alias("holder")).filter("of <> ''").distinct()
    has = scopes.inherited(has, above, "holder").withColumnRenamed("of", "full")
    bound = _unique(bound.join(types, ["scope", "name"]), ["path", "fn", "var"]).withColumnsRenamed({"path": "in", "type": "bound"})

    first = F.element_at("steps", 1)
    at = asked.join(owners, "owner", "left").withColumn("owner", F.coalesce("of", "owner")).drop("of")
    at = at.join(bound, (F.col("path") == F.col("in")) & (F.col("subject") == F.col("fn")) & (first == F.col("var")), "left").drop("in", "fn", "var")
    at = at.join(known.withColumnRenamed("type", "held"), (F.col("owner") == F.col("of")) & (first == F.col("member")), "left").drop("of", "member")
    free = known.filter("of = ''").select(F.col("member").alias("free_name"), F.col("type").alias("returned"))
    at = at.join(free, first == F.col("free_name"), "left")
    live = cut(at.withColumn("type", F.when(first == "this", F.col("owner")).otherwise(F.coalesce("bound", "held", "returned"))).drop("bound", "held", "free_name", "returned"))
    done, steps = None, 1
    while True:
        more = (F.size("steps") > steps) & F.col("type").isNotNull()
        ended = live.filter(~more)
        done = ended if done is None else done.unionByName(ended)
        live = live.filter(more)
        if live.isEmpty():
            break
        own = known.select("of", "member", F.col("type").alias("next"))
        live = live.join(own, (F.col("type") == F.col("of")) & (F.get("steps", F.lit(steps)) == F.col("member")), "left")
        live, steps = cut(live.withColumn("type", F.col("next")).drop("of", "member", "next")), steps + 1
    keys = ("path", "subject", "receiver", "detail")
    ends = done.select(*(F.col(c).alias(f"__{c}") for c in keys), F.col("type").alias("full"), short_name(F.col("type")).alias("type"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = calls.join(ends, same, "left").withColumn("member", F.concat("object", F.lit("()")))
    return out.join(has, ["full", "member"], "left").select(*calls.columns, "type", "full", "holder")


def overriders(facts: DataFrame) -> DataFrame:
    """base, method, candidate: methods of that name in classes below ``base``: what a virtual call may reach."""
    below = facts.filter("fact_type = 'inherits'").select(short_name(F.col("object")).alias("src"), short_name(F.col("subject")).alias("dst")).distinct()
    under = graph.reach(below, below.select(F.col("src").alias("start")).distinct()).filter("hops > 0").select(F.col("start").alias("base"), F.col("node").alias("derived"))
    owner = F.regexp_extract("subject", r"([A-Za-z_]\w*)::~?[A-Za-z_]\w*$", 1)
    methods = facts.filter("fact_type = 'symbol'").select(owner.alias("class"), short_name(F.col("subject")).alias("method"), F.col("subject").alias("candidate")).filter("class <> ''").distinct()
    here = methods.select(F.col("class").alias("base"), "method").distinct()
    return under.join(methods, F.col("derived") == F.col("class")).join(here, ["base", "method"], "left_semi").select("base", "method", "candidate")
