"""Full-text ranking by BM25, anchors, neighbours by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token: lower-cased runs of ASCII letters and digits."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score of the documents that have any of the terms.

    Term counts come from one scan without a row per word: a term's count is the number of its matches.
    """
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.regexp_extract_all(body, F.lit("[a-z0-9]+"), F.lit(0))
    wanted = F.array(*map(F.lit, terms))
    counted = docs.select(key, words.alias("w")).select(key, F.size("w").alias("n"), F.filter("w", lambda x: F.array_contains(wanted, x)).alias("hits"))
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg"))
    tf = counted.filter("size(hits) > 0").select(key, "n", F.explode("hits").alias("term")).groupBy(key, "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # df has a row per term at most, stats one row.
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats), F.lit(True))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avg")))
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def top_tokens(docs: DataFrame, key: str, text: str, most: int = 40) -> DataFrame:
    """token, score, docs: by score (documents times length) down, then token; ``most`` of them (the report's size)."""
    each = tokens(docs, key, text).filter("length(token) >= 4").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return each.select("token", (F.col("n") * F.length("token")).cast("long").alias("score")).orderBy(F.desc("score"), "token").limit(most)


def neighbours(edges: DataFrame, node: str, order: list, most: int) -> DataFrame:
    """The first ``most`` edges of each node in order."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(node).orderBy(*order))).filter(F.col("rank") <= most)
