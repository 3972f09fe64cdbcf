"""Reading source trees and compile databases through Spark's file sources."""

from __future__ import annotations

import shlex
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as source, header and resource.
SOURCES = [".c", ".cc", ".cpp", ".cxx"]
HEADERS = [".h", ".hh", ".hpp", ".hxx", ".inl"]
RESOURCES = [".rc", ".rc2", ".rh"]


def source_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(SOURCES), "source").when(ext.isin(HEADERS), "header").when(ext.isin(RESOURCES), "resource")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``*`` crosses slashes, ``dir/**`` is all below, a bare name is any segment."""
    if not any(c in pattern for c in "*?[/"):
        return f"(^|/){_quoted(pattern)}(/|$)"
    if pattern.endswith("/**"):
        return f"^{glob_regex_body(pattern[:-3])}/"
    return f"^{glob_regex_body(pattern)}$"


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/-" else f"\\{c}" for c in text)


def glob_regex_body(pattern: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else _quoted(c) for c in pattern)


def scan_tree(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """path (relative to ``root``), text, kind, size_bytes, modified of the C and C++ files below ``root``.

    Bytes that are not UTF-8 are replaced. Files matching an ``exclude`` glob fall away before they are read.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").split("://")[-1] + "/")
    path = F.element_at(F.split(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.concat(F.lit(r"\Q"), base, F.lit(r"\E"))), -1)
    rows = read.select(path.alias("path"), source_kind(F.col("path")).alias("kind"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content").filter("kind is not null")
    for pattern in exclude or []:
        rows = rows.filter(~F.col("path").rlike(glob_regex(pattern)))
    return rows.select("path", F.expr("coalesce(try_validate_utf8(cast(content as string)), make_valid_utf8(cast(content as string)))").alias("text"), "kind", "size_bytes", "modified")


@lru_cache(maxsize=1)
def _split():
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(command: pd.Series) -> pd.Series:
        return pd.Series([shlex.split(c) if c else [] for c in command], dtype=object)

    return split


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """directory, file, tokens of each entry of a compile database."""
    schema = "directory string, command string, arguments array<string>, file string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("directory", "file", F.coalesce("arguments", _split()(F.col("command"))).alias("tokens"))


def options(entries: DataFrame, flag: str) -> DataFrame:
    """file, place, value of an option, joined (``-DX``) or apart (``-D X``)."""
    rows = entries.select("file", "tokens", F.posexplode("tokens").alias("place", "token"))
    after = F.get("tokens", F.col("place") + 1)
    value = F.when(F.col("token") == flag, after).when(F.startswith("token", F.lit(flag)), F.substring("token", len(flag) + 1, 1 << 20))
    return rows.select("file", "place", value.alias("value")).filter("value is not null")


def macros(entries: DataFrame) -> DataFrame:
    """file, macros (name to value; of repeated names the last wins, without a value it is empty)."""
    rows = options(entries, "-D").select("file", "place", F.split_part("value", F.lit("="), F.lit(1)).alias("name"), F.when(F.col("value").contains("="), F.regexp_replace("value", "^[^=]*=", "")).otherwise("").alias("v"))
    last = rows.groupBy("file", "name").agg(F.max_by("v", "place").alias("v"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("macros"))
