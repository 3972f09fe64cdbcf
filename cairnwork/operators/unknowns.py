"""What evidence leaves open: unknowns by type with what they affect, and what an answer must then say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that a report lists for an unknown; the count tells how many there are.
LISTED = 20
#: What has to be said about each type.
CONSTRAINTS = {
    "conditional_build": "Qualify this by the build configuration.",
    "inactive_build": "Do not present inactive code as part of the build.",
    "unresolved_include": "Included text may be missing from the evidence.",
    "ambiguous_call": "Name the possible targets, not one of them.",
    "unresolved_call": "The call's target is not known.",
    "unsupported_expression": "A condition could not be read.",
}


def label(*columns: Column) -> Column:
    """The first of the columns that says something."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def unknowns(rows: DataFrame, rules: list[tuple[str, Column]], affected: Column, order: Column, keys: list[str] | None = None) -> DataFrame:
    """keys, unknown_type, n, affects (first ``LISTED`` distinct labels in order, joined), constraint.

    rules: (type, condition); a row may count for several. First places are found before labels are collected,
    so a type that a third of all rows have brings a row per label.
    """
    keys = keys or []
    types = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules)))
    each = rows.select(*keys, F.explode(types).alias("unknown_type"), affected.alias("label"), order.alias("at"))
    counted = each.groupBy(*keys, "unknown_type", "label").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    rolled = counted.groupBy(*keys, "unknown_type").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("at", "label")))).alias("x"))
    constraint = F.element_at(F.create_map(*(F.lit(v) for kv in CONSTRAINTS.items() for v in kv)), F.col("unknown_type"))
    return rolled.select(*keys, "unknown_type", "n", F.array_join(F.transform(F.slice("x", 1, LISTED), lambda s: s["label"]), ", ").alias("affects"), constraint.alias("constraint"))


def rollup(status: Column, mixed: str = "mixed") -> Column:
    """Aggregate: the one status that all rows have, ``mixed`` if they differ, not_tracked if none has one."""
    return F.when(F.count(status) == 0, "not_tracked").when(F.min(status) == F.max(status), F.min(status)).otherwise(mixed)
