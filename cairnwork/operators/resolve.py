"""Repo-wide resolution as joins: candidates by name, narrowing, bindings, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import suffixes


def narrow(candidates: DataFrame, keys: list[str], steps: list[Column]) -> DataFrame:
    """Keep, step by step, the candidates of a key that meet a condition, unless none does."""
    out = candidates
    for step in steps:
        flag = F.coalesce(step, F.lit(False)).cast("int")
        out = out.withColumn("__f", flag).withColumn("__any", F.max("__f").over(Window.partitionBy(*keys))).filter("__f = __any").drop("__f", "__any")
    return out


def resolution(candidates: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, resolved (the only candidate, else null), candidates (sorted, joined), status."""
    held = candidates.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("__c"))
    return held.select(*keys, F.when(F.size("__c") == 1, F.element_at("__c", 1)).alias("resolved"), F.array_join("__c", ",").alias("candidates"), F.when(F.size("__c") == 1, "resolved").when(F.size("__c") > 1, "ambiguous").otherwise("unresolved").alias("status"))


def by_suffix(queries: DataFrame, query: str, names: DataFrame, name: str, sep: str = "::") -> DataFrame:
    """Pairs of queries and names that equal them or end with separator and query: an equi-join on suffixes."""
    keyed = names.withColumn("__suffix", F.explode(suffixes(F.col(name), sep)))
    return queries.join(keyed, F.col(query) == F.col("__suffix")).drop("__suffix")


def bind_to_definition(symbols: DataFrame, keys: list[str], path: str, order: str) -> DataFrame:
    """Each symbol with the last definition of its key, unless that is itself: never all pairs of a key."""
    last = symbols.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max_by(F.struct(F.col(path).alias("p"), F.col(order).alias("o")), order).alias("__d"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return symbols.join(last, same).filter(F.col("__d.p") != F.col(path)).select(*symbols.columns, F.col("__d.p").alias("definition"))


def strong_for(symbols: DataFrame, name: str, weak: str, site: str) -> DataFrame:
    """Weak defaults (``weak`` true) with the first strong definition of their name at another site, in ``strong``."""
    firm = symbols.filter(~F.col(weak)).groupBy(F.col(name).alias("__name")).agg(F.min(site).alias("strong"))
    return symbols.filter(F.col(weak)).join(firm, F.col(name) == F.col("__name")).filter(F.col(site) != F.col("strong")).drop("__name")


def unique_aliases(aliases: DataFrame, name: str, target: str) -> DataFrame:
    """Aliases that stand for one target only."""
    return aliases.groupBy(name).agg(F.min(target).alias(target), F.max(target).alias("__x")).filter(F.col(target) == F.col("__x")).drop("__x")


def last_wins(values: DataFrame, key: str, value: str, priority: str) -> DataFrame:
    """key, value, origins: of several sources' settings, that of the highest priority."""
    return values.groupBy(key).agg(F.max_by(value, priority).alias(value), F.array_join(F.array_sort(F.collect_set(F.col(priority).cast("string"))), ",").alias("origins"))


def call_resolution(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolve calls (caller_ns, callee, argc) against symbols (qualified_name, argc, is_definition).

    Exact qualified names go first, then equal short names of the caller's namespace, then names that end with the
    callee; arity and definitions narrow what is left. One row per call: resolved, candidates, status. Calls that ask
    the same are resolved once, so that a common name costs no call times symbol pairs.
    """
    asked = ["caller_ns", "callee", "argc"]
    kinds = calls.select(*asked).distinct()
    named = symbols.select("qualified_name", F.col("argc").alias("s_argc"), "is_definition", F.regexp_replace("qualified_name", "(::)?[^:]*$", "").alias("ns"))
    found = by_suffix(kinds, "callee", named, "qualified_name")
    inside = F.startswith(F.concat("caller_ns", F.lit("::")), F.concat("ns", F.lit("::")))
    rank = F.when(F.col("qualified_name") == F.col("callee"), 0).when(F.col("ns") == F.col("caller_ns"), 1).when((F.col("ns") != "") & inside, 2).otherwise(3)
    best = found.withColumn("rank", rank).withColumn("best", F.min("rank").over(Window.partitionBy(*asked))).filter("rank = best")
    kept = narrow(best, asked, [F.col("s_argc") == F.col("argc"), F.col("is_definition")])
    met = resolution(kept, asked, "qualified_name").withColumnsRenamed({c: f"__{c}" for c in asked})
    same = F.lit(True)
    for c in asked:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return calls.join(met, same, "left").drop(*(f"__{c}" for c in asked)).withColumn("status", F.coalesce("status", F.lit("unresolved")))
