"""Keyed tables: upsert, delete, freshness, pages, first-wins dedupe."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MOST_LIMIT = 100, 500


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder that ``spark.checkpoint.dir`` names, and cut its lineage.

    Where the session names none and all tasks run on this machine (tests), a temporary folder is made; on a cluster
    that is an error, as executors would not see it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, cut by its column ``by``: later reads take only what they name.

    For large tables that many reads follow; one that is stored already comes back as it is.
    """
    if getattr(df, "_stored", False):
        return df
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    written = df.write.partitionBy(by) if by else df.write
    written.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place).select(*df.columns)
    out._stored = True
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, which driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnwork-"))
    return context.getCheckpointDir()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """``new`` rows replace ``old`` rows of equal keys (null keys are equal), or those of the keys in ``gone``."""
    fresh = (new if gone is None else gone).select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = None
    for k in keys:
        same = old[k].eqNullSafe(F.col(f"__{k}")) if same is None else same & old[k].eqNullSafe(F.col(f"__{k}"))
    return old.join(fresh, same, "left_anti").unionByName(new)


def freshness(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, state: stale (digest differs), missing (only in ``old``), new (only in ``new``) or clean."""
    a = old.select(F.col(key).alias("k"), F.col(digest).alias("was"), F.lit(True).alias("there"))
    b = new.select(F.col(key).alias("l"), F.col(digest).alias("now"), F.lit(True).alias("here"))
    state = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "new").when(~F.col("was").eqNullSafe(F.col("now")), "stale").otherwise("clean")
    return a.join(b, F.col("k") == F.col("l"), "full_outer").select(F.coalesce("k", "l").alias(key), state.alias("state"))


def unchanged(facts: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Facts of files that need no new extraction: those of clean files."""
    return facts.join(states.filter("state = 'clean'").select(key), key, "left_semi")


def active(rows: DataFrame, status: str, inactive: str = "inactive") -> DataFrame:
    """Rows whose status is not inactive; without a status, they are active."""
    return rows.filter(F.coalesce(status, F.lit("active")) != inactive)


def page_bounds(limit: int | None = None, offset: int = 0) -> tuple[int, int]:
    """Validated limit (default 100, 500 at most) and offset."""
    limit = DEFAULT_LIMIT if limit is None else limit
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return min(limit, MOST_LIMIT), offset


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """The page's rows with position (from 0), total and next_offset (null on the last page, or if limit is 0).

    Rows are numbered by offset and limit of a sorted scan (top-k in each task), the total by a count.
    """
    limit, offset = page_bounds(limit, offset)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    numbered = cut.withColumn("position", (F.row_number().over(Window.orderBy(*order)) - 1 + offset).cast("long"))
    after = F.when((F.col("total") > offset + limit) & F.lit(limit > 0), F.lit(offset + limit).cast("long"))
    return numbered.join(F.broadcast(total), F.lit(True)).withColumn("next_offset", after)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order: an aggregate, so that a common key is no hot window."""
    names = [f"__o{i}" for i in range(len(order))]
    held = rows.select(F.struct(*(c.alias(n) for c, n in zip(order, names, strict=True)), F.struct(*rows.columns).alias("row")).alias("x"), *keys)
    return held.groupBy(*keys).agg(F.min("x").alias("x")).select("x.row.*")


def manifest(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, sha256, size_bytes, line_count of every file."""
    body = F.coalesce(F.col(text), F.lit(""))
    return files.select(F.col(path), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("size_bytes"), F.size(F.split(body, "\n")).cast("long").alias("line_count"))


def lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, line_no (from 1), line."""
    return files.select(path, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("__n", "line")).select(path, (F.col("__n") + 1).cast("long").alias("line_no"), "line")
