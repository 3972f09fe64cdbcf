"""Lines and spans: as-of and interval joins, running depth, runs of equal values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """``probes`` with ``out``: the value of the last mark at or before each (of equal places, the largest value).

    One sort of the union; no pair of rows is made.
    """
    a = probes.withColumn("__probe", F.lit(1)).withColumn("__value", F.lit(None).cast(marks.schema[value].dataType))
    b = marks.select(*keys, at, F.col(value).alias("__value"), F.lit(0).alias("__probe"))
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("__probe"), F.col("__value")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(out, F.last("__value", ignorenulls=True).over(w)).filter("__probe = 1").drop("__probe", "__value")


def overlapping(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str, how: str = "inner") -> DataFrame:
    """Points with the spans that hold them, within equal keys."""
    same = None
    p = points.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in points.columns))
    for k in keys:
        same = (F.col(k) == F.col(f"__{k}")) if same is None else same & (F.col(k) == F.col(f"__{k}"))
    joined = spans.join(p, same & (F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end)), how)
    return joined.drop(*(f"__{k}" for k in keys))


def depth(tokens: DataFrame, keys: list[str], order: str, delta: str) -> DataFrame:
    """``tokens`` with the running sum of ``delta``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("depth", F.sum(delta).over(w))


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of neighbours with one value: keys, value, first and last place (numbered from 1), length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = Window.partitionBy(*keys, value).orderBy(*order)
    marked = rows.withColumn("__i", F.row_number().over(w)).withColumn("__g", F.col("__i") - F.row_number().over(v))
    return marked.groupBy(*keys, value, "__g").agg(F.min("__i").cast("long").alias("first"), F.max("__i").cast("long").alias("last"), F.count(F.lit(1)).alias("length")).drop("__g")
