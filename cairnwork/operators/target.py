"""Which files a target profile builds: ordered rules as one expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import SOURCES


@dataclass(frozen=True)
class Profile:
    """Settings of a build target; empty ones rule nothing out."""

    active_prefixes: list[str] = field(default_factory=list)
    inactive_prefixes: list[str] = field(default_factory=list)
    port_root: str = ""
    active_port: str = ""
    heap_root: str = ""
    heap: str = ""


def _below(path: Column, prefix: str) -> Column:
    p = prefix.strip("/")
    return (path == p) | path.startswith(p + "/")


def _any(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | _below(path, p)
    return out


def decide(files: DataFrame, profile: Profile, built: DataFrame | None = None, path: str = "path") -> DataFrame:
    """``files`` with status (active, inactive) and reason. ``built`` (path): the sources of the compile database.

    The first rule that excludes a file decides: inactive prefixes, missing from the active prefixes, another port,
    another heap, a source that isn't built.
    """
    p = F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    if built is None:
        rows, known, any_built = files, F.lit(False), F.lit(False)
    else:
        names = built.select(F.col("path").alias("__built")).distinct()
        rows = files.join(names, F.col(path) == F.col("__built"), "left")
        known, any_built = F.col("__built").isNotNull(), F.lit(not names.isEmpty())
    is_source = F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1)).isin(SOURCES)
    reason = F.when(_any(p, profile.inactive_prefixes), "inactive_path_prefix")
    if profile.active_prefixes:
        reason = reason.when(~_any(p, profile.active_prefixes), "not_in_active_path_prefixes")
    if profile.active_port:
        reason = reason.when(_below(p, profile.port_root) & ~_below(p, profile.active_port), "non_selected_port")
    if profile.heap:
        reason = reason.when(_below(p, profile.heap_root) & ~_below(p, profile.heap), "non_selected_heap")
    reason = reason.when(any_built & is_source & ~known, "not_in_compile_commands")
    kept = F.when(_any(p, profile.active_prefixes), "active_path_prefix").when(known, "compile_commands_entry").otherwise("default_active")
    out = rows.withColumn("__r", reason)
    return out.select(*files.columns, F.when(F.col("__r").isNull(), "active").otherwise("inactive").alias("status"), F.coalesce("__r", kept).alias("reason"))


#: Macros that switch a way of allocation.
ALLOCATION = {"dynamic_allocation": "configSUPPORT_DYNAMIC_ALLOCATION", "static_allocation": "configSUPPORT_STATIC_ALLOCATION"}


def settings(spark: SparkSession, name: str, profile: Profile, macros: dict[str, str], include_dirs: list[str] | None = None, **more: str) -> DataFrame:
    """subject, predicate, object of all that a target sets, a row for each value; empty values are left out."""
    rows = [("name", "selected_profile", name or "default")]
    rows += [("include_dir", "target_artifact", d) for d in include_dirs or []]
    rows += [("active_path_prefix", "target_file_selection", p) for p in profile.active_prefixes] + [("inactive_path_prefix", "target_file_selection", p) for p in profile.inactive_prefixes]
    rows += [(k, "target_attribute", v) for k, v in {"active_port": profile.active_port, "heap": profile.heap, **more}.items()]
    rows += [(way, "allocation_setting", {"0": "disabled", "1": "enabled"}.get(macros.get(macro, "").strip(), "")) for way, macro in ALLOCATION.items()]
    rows += [(k, "macro_value", v or "1") for k, v in sorted(macros.items())]
    return spark.createDataFrame([r for r in rows if r[2]], "subject string, predicate string, object string")
