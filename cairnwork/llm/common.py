"""Small helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and all tasks run in this process' machine (tests) a temporary folder is
    made, and it is then the session's folder from there on. On a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="cairnwork-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that an operator writes."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read again: for what is read more than once."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ``fresh_path`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """An Arrow string column as bytes; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``most`` bytes (a longer row is a run of its own)."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is visible, else the next one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def groups_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Split batches that are sorted by ``key`` into one table per run of equal keys."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        begin = 0
        for end in range(1, n + 1):
            if end < n and keys[end] == keys[begin]:
                continue
            if held and held_key != keys[begin]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            held_key = keys[begin]
            begin = end
    if held:
        yield pa.Table.from_batches(held)


#: Keys that ``join_heavy`` broadcasts at most, and rows that a key has at least for that.
MOST_HEAVY, HEAVY_ROWS = 20_000, 1_000


def join_heavy(rows: DataFrame, keyed: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and in ``n`` how many rows have it.

    A key may hold a third of all rows: keys with over a ``MOST_HEAVY``-th of them (so at most that many keys)
    are broadcast, the others are shuffled, none of which is large.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    least = max(HEAVY_ROWS, total // MOST_HEAVY)
    heavy = cut(keyed.filter(F.col(n) > least))
    if heavy.isEmpty():
        return rows.join(keyed, on)
    heavy = F.broadcast(heavy)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(keyed.filter(F.col(n) <= least), on))
