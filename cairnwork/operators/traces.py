"""Traces from step lists, and expectations on facts: joins on narrow keys, first matches by aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step_trace(steps: DataFrame, relations: DataFrame) -> DataFrame:
    """trace, subject, route, steps: the first relation that fits each step, in step order.

    steps: trace, subject, step, predicate, operation (null: any). relations: subject, predicate, operation, object,
    seq. The route begins with the subject and takes each object once; steps without a relation are left out, and
    so are traces without any.
    """
    r = relations.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("operation").alias("o"), "object", "seq")
    met = steps.join(r, (F.col("subject") == F.col("s")) & (F.col("predicate") == F.col("p")) & (F.col("operation").isNull() | (F.col("operation") == F.col("o"))))
    first = met.groupBy("trace", "subject", "step").agg(F.min_by("object", "seq").alias("object"), F.min_by("predicate", "seq").alias("did"))
    listed = first.groupBy("trace", "subject").agg(F.array_sort(F.collect_list(F.struct("step", "object", "did"))).alias("x"))
    objects = F.filter(F.transform("x", lambda s: s["object"]), lambda o: o.isNotNull())
    return listed.select("trace", "subject", F.array_join(F.array_distinct(F.concat(F.array("subject"), objects)), " > ").alias("route"), F.array_join(F.transform("x", lambda s: s["did"]), ",").alias("steps"))


def long_form(facts: DataFrame, key: str) -> DataFrame:
    """key, field, value: a row for every non-null column but the key."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in facts.columns if c != key))
    return facts.select(key, F.inline(pairs)).filter("value is not null")


def expectations(patterns: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """case_id, pattern_id, must (true: some fact has all of the pattern, false: none), passed.

    patterns: case_id, pattern_id, must, field, value, a row per condition. Facts meet conditions on (field, value);
    a fact has the pattern if it meets as many as there are.
    """
    wanted = patterns.groupBy("case_id", "pattern_id", "must").agg(F.count(F.lit(1)).alias("conditions"))
    met = patterns.join(long_form(facts, key), ["field", "value"]).groupBy("case_id", "pattern_id", key).agg(F.count(F.lit(1)).alias("met"))
    best = met.groupBy("case_id", "pattern_id").agg(F.max("met").alias("met"))
    hit = F.coalesce("met", F.lit(0)) == F.col("conditions")
    return wanted.join(best, ["case_id", "pattern_id"], "left").select("case_id", "pattern_id", "must", (hit == F.col("must")).alias("passed"))
