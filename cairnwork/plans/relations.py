"""Relations that rule packs read off calls, and verdicts on claims about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import short_name
from ..operators import resolve


def relations(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """pack, subject, predicate, object, context (isr or task), settled, build_status, path, line of every call of a known API."""
    calls = facts.filter("fact_type = 'call'").select("path", "line", "subject", F.col("object").alias("callee"), "build_status")
    short = short_name(F.col("callee"))
    keyed = calls.withColumn("isr", F.endswith(short, F.lit("FromISR"))).withColumn("api_name", F.regexp_replace(short, "FromISR$", ""))
    met = keyed.join(rules, F.col("api_name") == F.col("api"))
    return met.select("pack", "subject", "predicate", "object", F.when(F.col("isr") | F.endswith("api", F.lit("_FROM_ISR")), "isr").otherwise("task").alias("context"), "settled", "build_status", "path", "line")


def verify(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Claims (claim_id, pack, subject, predicate, object; a null or empty object means any) with verdict.

    Supported if settled, active evidence says so; conditional if only other evidence does; contradicted if the
    subject has settled, active evidence of the pack that says something else and nothing open; else unknown.
    """
    live = found.filter("build_status <> 'inactive'").withColumn("firm", F.col("settled") & (F.col("build_status") == "active")).withColumnsRenamed({"pack": "p", "subject": "name", "predicate": "did", "object": "what"})
    met = resolve.by_suffix(claims.filter("subject <> ''"), "subject", live, "name").filter("pack = p")
    hit = (F.col("did") == F.col("predicate")) & (F.coalesce(F.nullif("object", F.lit("")), F.col("what")) == F.col("what"))
    counted = met.withColumn("hit", hit).groupBy(F.col("claim_id").alias("__id")).agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & F.col("firm")).alias("firm_hits"), F.count_if(~F.col("firm")).alias("open"))
    verdict = F.when(F.col("firm_hits") > 0, "supported").when(F.col("hits") > 0, "conditional").when(F.col("open") == 0, "contradicted").otherwise("unknown")
    return claims.join(counted, F.col("claim_id") == F.col("__id"), "left").select(*claims.columns, verdict.alias("verdict"))
