"""Verdicts on claims: supported, conditional, unknown, contradicted. Absence alone never contradicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which verdict of several prevails, and which support level is worst.
PREVAILS = ["contradicted", "unknown", "conditional", "supported"]
WORST_FIRST = ["unknown", "weak", "medium", "strong"]
#: What keeps evidence from being firm.
UNSETTLED = ["unresolved", "candidate_set", "ambiguous"]
SAFETY = {"contradicted": "unsafe", "unknown": "needs_more_evidence", "conditional": "must_qualify", "supported": "safe"}


def by_rank(values: Column, order: list[str]) -> Column:
    """The first of ``order`` that the group has, as an aggregate; of none, the first."""
    rank = F.coalesce(*(F.when(values == v, i) for i, v in enumerate(order)))
    return F.element_at(F.array(*map(F.lit, order)), F.coalesce(F.min(rank), F.lit(0)) + 1)


def judge(claims: DataFrame, evidence: DataFrame, on: list[str], target: str, object_col: str, unsettled: Column) -> DataFrame:
    """A verdict for each claim (all its columns) from evidence rows that share ``on``.

    Rows whose ``target`` equals the claim's ``object_col`` support it: conditional if any of them is
    ``unsettled``. Without such rows, settled evidence for other targets contradicts, unsettled or no evidence
    leaves it unknown. Evidence is summed up before it meets the claims, once by (on, target) and once by on.
    """
    flagged = evidence.withColumn("__u", F.coalesce(unsettled, F.lit(False)).cast("int"))
    exact = flagged.groupBy(*on, target).agg(F.max("__u").alias("__hit_unsettled"), F.count(F.lit(1)).alias("__hits")).withColumnRenamed(target, "__target")
    other = flagged.groupBy(*on).agg(F.max("__u").alias("__any_unsettled"))
    joined = claims.join(exact.select(*(F.col(c).alias(f"__{c}") for c in on), "__target", "__hits", "__hit_unsettled"), _equal(claims, on) & (claims[object_col] == F.col("__target")), "left").drop(*(f"__{c}" for c in on))
    joined = joined.join(other.select(*(F.col(c).alias(f"__{c}") for c in on), "__any_unsettled"), _equal(claims, on), "left").drop(*(f"__{c}" for c in on))
    verdict = (
        F.when((F.col("__hits") > 0) & (F.col("__hit_unsettled") == 0), "supported").when(F.col("__hits") > 0, "conditional")
        .when(F.col("__any_unsettled") == 0, "contradicted").otherwise("unknown")
    )
    reason = (
        F.when((F.col("__hits") > 0) & (F.col("__hit_unsettled") == 0), "edge_supported").when(F.col("__hits") > 0, "edge_conditional_or_candidate")
        .when(F.col("__any_unsettled") == 0, "settled_evidence_does_not_include_target").when(F.col("__any_unsettled") == 1, "unsettled_evidence").otherwise("no_evidence")
    )
    return joined.select(*claims.columns, verdict.alias("verdict"), reason.alias("reason"))


def _equal(claims: DataFrame, on: list[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & (claims[c] == F.col(f"__{c}"))
    return out


def negate(verdict: Column) -> Column:
    """The verdict on the opposite claim: support and contradiction change places."""
    return F.when(verdict == "supported", "contradicted").when(verdict == "contradicted", "supported").otherwise(verdict)


def stale(verdict: Column, fresh: Column) -> Column:
    """On an index that isn't fresh, contradicted becomes unknown and supported conditional."""
    return F.when(fresh, verdict).when(verdict == "contradicted", "unknown").when(verdict == "supported", "conditional").otherwise(verdict)


def gate(verdict: Column, support_level: Column, firm: Column) -> Column:
    """Weak support only qualifies; a contradiction needs firm source, semantic and build evidence."""
    return F.when((verdict == "supported") & (support_level == "weak"), "conditional").when((verdict == "contradicted") & ~firm, "unknown").otherwise(verdict)


def overall(verdict: Column) -> Column:
    """Aggregate: contradicted, then unknown, then conditional, then supported; of none, unknown."""
    return F.when(F.count(verdict) == 0, "unknown").otherwise(by_rank(verdict, PREVAILS))


def worst_support(level: Column) -> Column:
    return by_rank(level, WORST_FIRST)


def support_level(n_facts: Column, build: Column, semantic: Column, source: Column) -> Column:
    """strong, medium, weak or unknown (no facts) from the rolled-up build, semantic and source statuses."""
    weak = build.isin("inactive", "conditional", "mixed", "build_unknown") | semantic.isin("unresolved", "candidate_or_ambiguous", "dynamic_candidate", "unsupported", "mixed_with_unresolved") | source.isin("partially_supported", "upstream_missing", "compact_only", "unknown")
    return F.when(n_facts == 0, "unknown").when(weak, "weak").when((source == "not_tracked") | (semantic == "not_tracked"), "medium").otherwise("strong")


def safety(verdict: Column) -> Column:
    out = F.lit("needs_more_evidence")
    for v, level in SAFETY.items():
        out = F.when(verdict == v, level).otherwise(out)
    return out


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, values: distinct non-null values by first appearance, joined by ``, ``; firsts are found before collecting."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__at"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda s: s[value]), ", ").alias("values"))
