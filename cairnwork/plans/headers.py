"""Includes to files, macros of headers, and headers as each unit that includes them sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import resolve, tables
from . import ingest

HEADER = r"(?i)\.(h|hh|hpp|hxx|inl)$"


def resolve_includes(files: DataFrame, include_dirs: list[str]) -> DataFrame:
    """path, target, header (the file meant, null if none), resolution of every include line.

    The file's own folder goes first, then the include folders in order; only header files count.
    """
    return resolve_lines(include_lines(files), files, include_dirs)


def include_lines(files: DataFrame) -> DataFrame:
    """path, target, local (in quotes) of every include line."""
    lines = tables.lines(files, "path", "text")
    return lines.select("path", F.regexp_extract("line", r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]", 1).alias("target"), F.col("line").contains('"').alias("local")).filter("target <> ''").distinct()


def resolve_lines(found: DataFrame, files: DataFrame, include_dirs: list[str]) -> DataFrame:
    """``resolve_includes`` of include lines that are known already, against the paths of ``files``."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    places = F.array(folder, *(F.lit(d.strip("/") + "/" if d.strip("/") else "") for d in include_dirs))
    tried = found.select("path", "target", "local", F.posexplode(places).alias("rank", "place")).withColumn("name", F.regexp_replace(F.concat("place", "target"), r"(^|/)(\./)+", "$1"))
    known = files.select(F.col("path").alias("name")).filter(F.col("name").rlike(HEADER))
    best = tried.join(known.withColumn("there", F.lit(True)), "name", "left").groupBy("path", "target", "local").agg(F.min_by("name", F.when(F.col("there"), F.col("rank"))).alias("header"))
    return best.withColumn("resolution", F.when(F.col("header").isNull(), "unresolved").otherwise("resolved"))


def header_macros(files: DataFrame, macros) -> DataFrame:
    """path, name, value of the object-like ``#define`` lines of headers that are not inactive; include guards are skipped."""
    raw = tables.lines(files.filter(F.col("path").rlike(HEADER)), "path", "text")
    status = ingest.line_status(raw, ingest.branches(raw, macros)).filter("build_status <> 'inactive'")
    name, value = F.regexp_extract("line", r"^\s*#\s*define\s+([A-Za-z_]\w*)(?:\s|$)", 1), F.trim(F.regexp_extract("line", r"^\s*#\s*define\s+[A-Za-z_]\w*\s+(.*?)\s*(?://.*|/\*.*)?$", 1))
    guard = F.regexp_extract(F.lag("line").over(Window.partitionBy("path").orderBy("line_no")), r"^\s*#\s*ifndef\s+([A-Za-z_]\w*)\s*$", 1)
    rows = status.withColumn("guard", guard).select("path", "line_no", name.alias("name"), value.alias("value"), "guard").filter("name <> ''")
    kept = rows.filter(F.col("guard").isNull() | (F.col("guard") != F.col("name")))
    return kept.groupBy("path", "name").agg(F.max_by("value", "line_no").alias("value"))


def local_headers(resolved: DataFrame) -> DataFrame:
    """unit, header of the local includes that were resolved."""
    return resolved.filter("local and header is not null").select(F.col("path").alias("unit"), "header").distinct()


def unit_macros(files: DataFrame, include_dirs: list[str], command: DataFrame, configured: dict[str, str], local: DataFrame | None = None) -> DataFrame:
    """unit, name, value, origins: settings of each source, of its direct local headers, its command, the profile.

    Later origins win. command: file, macros (map). Headers of headers are not followed. local: ``local_headers``, if known.
    """
    headers = header_macros(files, ingest.macro_map(configured)).withColumnRenamed("path", "header")
    local = local_headers(resolve_includes(files, include_dirs)) if local is None else local
    from_headers = local.join(headers, "header").select("unit", "name", "value", F.lit("1_header").alias("origin"))
    from_command = command.select(F.col("file").alias("unit"), F.explode("macros").alias("name", "value")).withColumn("origin", F.lit("2_command"))
    units = files.filter(~F.col("path").rlike(HEADER)).select(F.col("path").alias("unit"))
    from_profile = units.select("unit", F.explode(ingest.macro_map(configured)).alias("name", "value")).filter("name <> ''").withColumn("origin", F.lit("3_profile"))
    rows = from_headers.unionByName(from_command).unionByName(from_profile)
    keyed = rows.withColumn("key", F.struct("unit", "name"))
    return resolve.last_wins(keyed, "key", "value", "origin").select("key.unit", "key.name", "value", "origins")


def _maps(macros_of: DataFrame) -> DataFrame:
    return macros_of.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("macros"))


def unit_facts(files: DataFrame, units: DataFrame, local: DataFrame, command: DataFrame, configured: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Facts of the ``units`` (column path), each under its own macros, and of headers as these units see them (with unit).

    files: texts of the units and of the headers that they include; local: their ``local_headers``. Headers that are
    units themselves are read under the configured macros.
    """
    local = local.filter(~F.col("unit").rlike(HEADER)).join(units.select(F.col("path").alias("unit")), "unit", "left_semi")
    macros_of = tables.cut(unit_macros(files, [], command, configured, local))
    own = files.join(units.select("path"), "path", "left_semi").join(_maps(macros_of).withColumnRenamed("unit", "path"), "path", "left")
    own = own.select("path", "text", F.coalesce("macros", ingest.macro_map(configured)).alias("macros"))
    seen = projected_facts(files, [], macros_of, local)
    return ingest.facts(own, None), seen.withColumn("unit", F.split_part("path", F.lit(" > "), F.lit(1)))


def projected_facts(files: DataFrame, include_dirs: list[str], macros_of: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Facts of each header once per unit that includes it, under that unit's macros; path is ``unit > header``.

    macros_of: unit, name, value. local: ``local_headers``, if known.
    """
    seen = local_headers(resolve_includes(files, include_dirs)) if local is None else local
    rows = seen.join(_maps(macros_of), "unit", "left").withColumn("macros", F.coalesce("macros", ingest.macro_map({})))
    # A header says the same to all units with the same macros: each such variant is read once, whatever the units.
    told = F.to_json(F.array_sort(F.map_entries("macros")))
    rows = tables.stored(rows.select("unit", "header", "macros", F.sha1(F.concat_ws("\0", "header", told)).alias("variant")))
    variants = rows.groupBy("variant").agg(F.first("header").alias("header"), F.first("macros").alias("macros"))
    texts = variants.join(files.select(F.col("path").alias("header"), "text"), "header").select(F.col("variant").alias("path"), "text", "macros")
    found = tables.stored(ingest.facts(texts, None))
    path = F.concat_ws(" > ", "unit", "header")
    each = found.join(rows.select(F.col("variant").alias("path"), "unit", "header"), "path").withColumns({"path": path, "subject": F.when(F.col("fact_type") == "include", path).otherwise(F.col("subject"))})
    return each.select(*found.columns)
