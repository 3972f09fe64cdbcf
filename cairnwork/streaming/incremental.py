"""Incremental indexing: new, changed and removed files come in, what depends on them is read anew, the rest stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph, tables
from ..plans import headers
from ..sources import corpus
from ..sources.store import FactStore, build_signature

SCHEMA = "path string, text string"


def needs_full(states: DataFrame, kinds: DataFrame) -> DataFrame:
    """path, reason of the changes that touch more than their own file: headers, and files of no known kind."""
    changed = states.filter("state <> 'clean'").join(kinds.select(F.col("path").alias("p"), "kind"), F.col("path") == F.col("p"), "left")
    reason = F.when(F.col("kind") == "header", "header_changed").when(F.col("kind").isNull() & (F.col("state") != "missing"), "unknown_kind")
    return changed.select("path", reason.alias("reason")).filter("reason is not null")


def _held(store: FactStore, table: str, schema: str, parts: list[int] | None = None) -> DataFrame:
    rows = store.read(table, parts=parts)
    return store.spark.createDataFrame([], schema) if rows is None else rows


def dependents(resolved: DataFrame, changed: DataFrame) -> DataFrame:
    """path of every source that includes one of the ``changed`` headers (column path), over any number of headers."""
    edges = headers.local_headers(resolved).select(F.col("header").alias("src"), F.col("unit").alias("dst"))
    starts = changed.filter(F.col("path").rlike(headers.HEADER)).select(F.col("path").alias("node"))
    return graph.closure(edges, starts).filter(~F.col("node").rlike(headers.HEADER)).select(F.col("node").alias("path"))


def refresh(store: FactStore, changed: DataFrame, macros: dict[str, str], include_dirs: Sequence[str] = (), whole: bool = False, command: DataFrame | None = None) -> dict:
    """What the store knows of the ``changed`` files (path, text; a null text: the file is gone) is replaced.

    whole: ``changed`` is the whole tree, so indexed files that it lacks are gone. Of a path given twice, a text wins over
    none, the smaller digest over the greater. command: file, macros of a compile database.

    Files of equal digest are left alone. Sources that include a changed, new or removed header, as includes resolved
    before or resolve now, are read anew with it, so that the outcome is that of a full rebuild. Only parts of the
    store that hold such files are written. Tables: files (with texts), includes, facts, projected (headers as units
    see them).

    Returns status, version, and how many files were new, stale, missing and read. status ``clean``: nothing to do.
    ``full_reingest_required``: nothing was done, since the settings are not those of the store, or files of no known
    kind came (reason tells); a new store takes both.
    """
    spark, dirs = store.spark, list(include_dirs)
    before = store.manifest()["version"]
    command = spark.createDataFrame([], "file string, macros map<string,string>") if command is None else command
    settings = spark.createDataFrame([*macros.items(), ("include_dirs", "\0".join(dirs))], "name string, value string")
    given = command.select(F.col("file").alias("name"), F.to_json(F.array_sort(F.map_entries("macros"))).alias("value"))
    signature = build_signature(settings.unionByName(given))
    report = {"status": "full_reingest_required", "version": before, "reason": "settings_changed", "new": 0, "stale": 0, "missing": 0, "read": 0}
    if before and store.manifest()["build"].get("settings") != signature:
        return report

    told = changed.select("path", "text", F.sha2("text", 256).alias("sha256")).filter("path is not null")
    now = told.groupBy("path").agg(F.min("sha256").alias("sha256"))
    known = _held(store, "files", "path string, sha256 string").select("path", "sha256")
    asked = known if whole else known.join(now, "path", "left_semi")
    states = tables.freshness(asked, now.filter("sha256 is not null"), "path", "sha256").filter("state <> 'clean'")
    states = tables.cut(states.join(now, "path", "left"))
    counts = {r.state: r.n for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    report |= counts
    if before and not counts:
        return report | {"status": "clean", "reason": ""}
    odd = needs_full(states, states.select("path", corpus.source_kind(F.col("path")).alias("kind"))).filter("reason = 'unknown_kind'")
    if before and not odd.isEmpty():
        return report | {"reason": "unknown_kind"}

    touched = states.select("path")
    body = tables.cut(told.join(states.filter("state <> 'missing'"), ["path", "sha256"], "left_semi").dropDuplicates(["path"]).select("path", "text"))
    said = _held(store, "includes", "path string, target string, local boolean")
    fresh = tables.cut(headers.include_lines(body))
    lines = said.join(touched, "path", "left_anti").unionByName(fresh)
    paths = known.select("path").join(touched, "path", "left_anti").unionByName(body.select("path"))
    resolved = tables.cut(headers.resolve_lines(lines, paths, dirs))
    either = headers.resolve_lines(said, known, dirs).unionByName(resolved)
    units = tables.cut(touched.unionByName(dependents(either, touched)).distinct())

    local = headers.local_headers(resolved)
    need = tables.cut(units.unionByName(local.join(units.select(F.col("path").alias("unit")), "unit", "left_semi").select(F.col("header").alias("path"))).distinct())
    held = _held(store, "files", SCHEMA, store.parts_of(need)).select("path", "text")
    texts = tables.cut(held.join(need, "path", "left_semi").join(touched, "path", "left_anti").unionByName(body))
    facts, projected = headers.unit_facts(texts, units, local, command, macros)
    index = tables.manifest(body, "path", "text").join(body, "path")
    version = store.merge(
        {"files": (touched, index), "includes": (touched, fresh), "facts": (units, facts), "projected": (units.toDF("unit"), projected)},
        build={"settings": signature, "mode": "incremental" if before else "full"},
    )
    return report | {"status": "indexed", "version": version, "reason": "", "read": texts.join(units, "path", "left_semi").count()}


def follow(spark: SparkSession, source: str, store: FactStore, macros: dict[str, str], checkpoint: str, include_dirs: Sequence[str] = ()) -> StreamingQuery:
    """Index Parquet files of (path, text) as they arrive in ``source``; each batch is one refresh of the store.

    A batch that came before a crash and comes again changes nothing. One that needs a full ingest stops the stream.
    """

    def take(batch: DataFrame, _: int) -> None:
        report = refresh(store, batch, macros, include_dirs)
        if report["status"] == "full_reingest_required":
            raise RuntimeError(f"full ingest required: {report['reason']}")

    rows = spark.readStream.schema(SCHEMA).parquet(source)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
