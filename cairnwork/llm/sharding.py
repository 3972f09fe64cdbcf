"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; ordered by the fractional rank
(rank + 1/2) / (rows of the source), the sources interleave in proportion, so that any run of that
order has the corpus' mixture. The order is cut into shards whose row counts are at most one apart.

No window spans a source or the corpus: ranks are counted within hash buckets (fractional-rank
buckets for the order over all rows) and shifted by what the buckets before them hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that a window partition holds on average, and the least and most buckets that there are.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 250_000, 512, 65_536


def _offsets(rows: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """For each bucket, the rows of the buckets before it within ``by``, and the rows of all."""
    counted = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("__n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counted.select(
        *by, bucket,
        (F.sum("__n").over(part.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"),
        F.sum("__n").over(part).alias("__all"),
    )


def interleave(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size (UTF-8 bytes plus 1), text_crc32, shard, slot.

    ``slot`` is the row's place in its shard, from 0 without gaps. A null source is a source of its
    own; a null text has no bytes; a null id is shuffled as the word ``null``. Repeated rows get
    slots of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = cut(rows.withColumn("draw", F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null"))))))
    total = rows.count()
    buckets = min(MOST_BUCKETS, LEAST_BUCKETS + total // BUCKET_ROWS)

    drawn = rows.withColumn("cell", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.lit(1 << 32)))
    drawn = drawn.withColumn("cell", F.floor(F.col("cell") * buckets / F.lit(float(1 << 32))).cast("int"))
    drawn = drawn.withColumn("stratum", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    within = Window.partitionBy("stratum", "cell").orderBy("draw", "id", "text_crc32", "size")
    ranked = (
        drawn.withColumn("__r", F.row_number().over(within) - 1)
        .join(_offsets(drawn, ["stratum"], "cell"), ["stratum", "cell"])
        .withColumn("fraction", (2 * (F.col("__before") + F.col("__r")) + 1) / (2 * F.col("__all")))
        .drop("__r", "__before", "__all", "cell")
        .withColumn("cell", F.least(F.floor(F.col("fraction") * buckets).cast("int"), F.lit(buckets - 1)))
    )
    ranked = cut(ranked)
    order = Window.partitionBy("cell").orderBy("fraction", "stratum", "draw", "id", "text_crc32")
    # The offsets have a row per bucket, MOST_BUCKETS at most.
    placed = ranked.withColumn("__r", F.row_number().over(order) - 1).join(F.broadcast(_offsets(ranked, [], "cell")), "cell").withColumn("place", F.col("__before") + F.col("__r"))
    # Row i of n goes to shard floor(i * shards / n), which begins at row ceil(shard * n / shards).
    shard = F.expr(f"place * {shards} div __all")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "text_crc32", "shard",
        (F.col("place") - F.expr(f"(shard * __all + {shards - 1}) div {shards}")).cast("long").alias("slot"),
    )
