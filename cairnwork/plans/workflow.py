"""Reports on an index and on answers: diagnostics, preflight, contracts, a session log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import path_role
from ..operators import rules, verdicts

LARGE_FACTS = 10_000


def diagnostics(facts: DataFrame, index: DataFrame) -> DataFrame:
    """kind, name, n: facts by type, files by role, totals; one row each."""
    by_type = facts.groupBy(F.col("fact_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("fact_type").alias("kind"), "name", "n")
    by_role = index.groupBy(path_role(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("file_role").alias("kind"), "name", "n")
    totals = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n") for name, df in (("facts", facts), ("files", index))]
    return by_type.unionByName(by_role).unionByName(totals[0]).unionByName(totals[1])


def warnings(report: DataFrame, states: DataFrame) -> DataFrame:
    """warning: what a reader of the index should know; none for a fresh, small index of project files."""
    dirty = states.agg(F.count_if(F.col("state") != "clean").alias("n")).filter("n > 0").select(F.lit("index_is_not_fresh").alias("warning"))
    noisy = report.filter("kind = 'file_role' and name <> 'project' and n > 0").select(F.concat(F.lit("non_project_files:"), "name").alias("warning"))
    large = report.filter((F.col("kind") == "total") & (F.col("name") == "facts") & (F.col("n") > LARGE_FACTS)).select(F.lit("large_fact_table").alias("warning"))
    return dirty.unionByName(noisy).unionByName(large)


def preflight(found: DataFrame) -> DataFrame:
    """level, actions: degraded if the index is not fresh, caution on other warnings, else ready."""
    dirty = F.max(F.col("warning") == "index_is_not_fresh")
    row = found.agg(F.coalesce(dirty, F.lit(False)).alias("dirty"), F.count(F.lit(1)).alias("n"))
    return row.select(F.when(F.col("dirty"), "degraded").when(F.col("n") > 0, "caution").otherwise("ready").alias("level"), F.when(F.col("dirty"), "refresh_index").otherwise("").alias("actions"))


def contracts(judged: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, safety, can_answer, must_not_send, and how many claims are allowed, qualified, unknown, prohibited.

    Absolute wording in a text whose claims are not settled is a violation; in an unsafe one it must not be sent.
    """
    each = judged.groupBy(F.col(key).alias("__k")).agg(verdicts.overall(F.col("verdict")).alias("overall"), *(F.count_if(F.col("verdict") == v).alias(n) for v, n in (("supported", "allowed"), ("conditional", "qualified"), ("unknown", "open"), ("contradicted", "prohibited"))))
    words = rules.wording(texts, [key], text)
    joined = words.join(each, F.col(key) == F.col("__k"), "left").withColumn("safety", F.coalesce(verdicts.safety(F.col("overall")), F.lit("needs_more_evidence")))
    violations = F.when(F.col("safety") != "safe", F.col("absolute")).otherwise(0) + F.when(F.coalesce("overall", F.lit("unknown")) == "unknown", F.col("speculative")).otherwise(0)
    return joined.select(key, "safety", F.coalesce(F.col("safety").isin("safe", "must_qualify") & F.col("overall").isNotNull(), F.lit(False)).alias("can_answer"), (F.col("safety") == "unsafe").alias("must_not_send"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("allowed", "qualified", "open", "prohibited")), violations.alias("violations"))


def log_sessions(sessions: DataFrame, path: str) -> None:
    """Append sessions as JSON lines, with an id from their content."""
    sessions.withColumn("session_id", F.sha2(F.to_json(F.struct(*sorted(sessions.columns))), 256)).write.mode("append").json(path)


def read_sessions(spark: SparkSession, path: str, order: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the log, newest first."""
    return spark.read.json(path).orderBy(F.desc(order), "session_id").offset(offset).limit(limit)


def over_budget(measured: DataFrame, budgets: DataFrame) -> DataFrame:
    """case_id, metric, measured, budget of what took more than it may; metrics without a budget are free."""
    return measured.join(budgets, ["case_id", "metric"]).filter("measured > budget")
