"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one space.
The bytes are compared by grouping on (hash, text): copies meet already in the map tasks, so a group
of copies, however large, sends one row from each task. What goes on from there is (hash, id, count).
Only where one hash stands for two texts do rows look their group up by the text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_heavy

#: The white space that counts, as a character class.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: content_hash, keep_id, group_size, text (null unless its hash collides).

    Null texts count as empty. ids may repeat; a null id never is keep_id while another exists.
    """
    hashed = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    groups = (
        hashed.groupBy(F.md5(F.col("text")).alias("content_hash"), "text")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    narrow = cut(groups.select("content_hash", "keep_id", "group_size"))
    shared = narrow.groupBy("content_hash").count().filter("count > 1").select("content_hash")
    plain = narrow.withColumn("text", F.lit(None).cast("string"))
    if shared.isEmpty():
        return plain
    shared = cut(shared)
    return plain.join(shared, "content_hash", "left_anti").unionByName(groups.join(shared, "content_hash", "left_semi"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    An empty table gives no rows. Of rows that repeat id and text one is kept. Further columns of ``docs`` are
    neither read nor returned, so their names can't clash.
    """
    groups = copy_groups(docs, id_col, text_col)
    text = normalised(F.col(text_col))
    each = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("content_hash"), F.sha2(text, 256).alias("text_sha256"), text.alias("body"))
    # Rows that repeat are one, with their number.
    rows = each.groupBy("id", "content_hash", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    alone = groups.filter("text is null").select("content_hash", "keep_id", "group_size")
    found = join_heavy(rows, alone, ["content_hash"], "group_size").select("id", "text_sha256", "n", "keep_id", "group_size")
    collided = groups.filter("text is not null")
    if not collided.isEmpty():
        apart = each.join(collided.withColumnRenamed("content_hash", "h"), (F.col("content_hash") == F.col("h")) & (F.col("body") == F.col("text")))
        found = found.unionByName(apart.groupBy("id", "text_sha256", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n")).select(*found.columns))
    # The first of them stays, if that id does.
    copies = found.select("id", "text_sha256", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return copies.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text.

    Rows are matched by id and content, so ids may repeat. Rows whose ids are null stay only if their text has no
    row with an id.
    """
    text = normalised(F.col(text_col))
    groups = copy_groups(docs, id_col, text_col)
    # As a column, so that each text is hashed once.
    keyed = docs.withColumn("__key", F.md5(text))
    # Rows of the id that stays, by text: more than one if rows repeat.
    first = keyed.select(F.col(id_col).alias("id"), F.col("__key").alias("content_hash")).groupBy("id", "content_hash").agg(F.count(F.lit(1)).alias("__n"))
    kept = cut(groups.filter("text is null").join(first, (groups["content_hash"] == first["content_hash"]) & groups["keep_id"].eqNullSafe(first["id"])).select(first["content_hash"].alias("__hash"), F.col("keep_id").alias("__id"), "__n"))
    same = (F.col("__key") == F.col("__hash")) & keyed[id_col].eqNullSafe(F.col("__id"))
    out = keyed.join(kept.filter("__n = 1").select("__hash", "__id"), same, "left_semi").drop("__key")
    if not kept.filter("__n > 1").isEmpty():
        repeated = keyed.join(kept.filter("__n > 1").select("__hash", "__id"), same, "left_semi")
        out = out.unionByName(repeated.dropDuplicates([id_col, "__key"]).drop("__key"))
    collided = groups.filter("text is not null")
    if not collided.isEmpty():
        apart = collided.select(F.col("text").alias("__text"), F.col("keep_id").alias("__id"))
        met = docs.withColumn("__body", text).join(apart, (F.col("__body") == F.col("__text")) & docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
        out = out.unionByName(met.dropDuplicates([id_col, "__body"]).drop("__body"))
    return out
