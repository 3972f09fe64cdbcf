"""A fact store: tables cut into parts by a hash of the path; one manifest names the folders of all parts of all tables."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tables

#: Parts of a table of a new store. At most as many numbers come to the driver for a change.
PARTS = 64


class FactStore:
    """Tables of rows about files, and metadata, under ``root``; each change is one manifest over all of them.

    A change writes only the parts that hold keys it touches, to new folders; then its manifest appears by one rename,
    so readers see all of it or nothing, and a job that was lost leaves but folders that no manifest names. One writer
    at a time; a second one finds its version taken and fails. Folders of earlier versions stay readable.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root = spark, root.rstrip("/")
        held = self.manifest()
        self.parts = held["parts"] if held["version"] else parts

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs()
        place = path(f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n.split(".")[0]) for n in names if re.fullmatch(r"\d+\.json", n))

    def manifest(self, version: int | None = None) -> dict:
        """version, parts, metadata, build, and of each table its key, schema and the folder of each part that has rows."""
        known = self.versions()
        if not known:
            return {"version": 0, "parts": 0, "metadata": {}, "build": {}, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/commits/{known[-1] if version is None else version}.json", wholetext=True).head()[0])

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def parts_of(self, keys: DataFrame) -> list[int]:
        """The parts that hold the keys (first column of ``keys``)."""
        return sorted(r[0] for r in keys.select(self.part(F.col(keys.columns[0]))).distinct().collect())

    def read(self, table: str, version: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """Rows of a table, or of some of its parts; None if there is no such table."""
        held = self.manifest(version)
        if table == "metadata":
            return self.spark.createDataFrame(sorted(held["metadata"].items()), "key string, value string") if held["metadata"] else None
        return self._rows(held, table, parts)

    def _rows(self, held: dict, table: str, parts: list[int] | None) -> DataFrame | None:
        if table not in held["tables"]:
            return None
        known = held["tables"][table]
        schema = T.StructType.fromJson(known["schema"])
        wanted = None if parts is None else set(map(str, parts))
        places = [f"{self.root}/{table}/{folder}/part={k}" for k, folder in sorted(known["folders"].items()) if wanted is None or k in wanted]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _written(self, table: str, rows: DataFrame, version: int, key: str, order: list[str]) -> dict[str, str]:
        path, fs = self._fs()
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        cut = rows.withColumn("part", self.part(F.col(key))).hint("rebalance", "part").sortWithinPartitions("part", *order)
        cut.write.partitionBy("part").parquet(f"{self.root}/{table}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/{table}/{folder}"))]
        return {n.split("=")[1]: folder for n in names if n.startswith("part=")}

    def merge(self, changes: dict[str, tuple[DataFrame, DataFrame]], metadata: dict[str, str] | None = None, build: dict[str, str] | None = None) -> int:
        """The new version, in which the rows of each table in ``changes`` replace those of the keys that go.

        changes: table to (keys, rows). ``keys`` holds every key that ``rows`` has, and those of rows that only go; the
        first of its columns decides the part. Parts without such keys are neither read nor written. build: what the
        rows were made with, kept apart from the metadata of users.
        """
        held = self.manifest()
        version = held["version"] + 1
        out = {"version": version, "parts": self.parts, "metadata": held["metadata"] | (metadata or {}), "build": held["build"] | (build or {}), "tables": dict(held["tables"])}
        for table, (keys, rows) in changes.items():
            touched = self.parts_of(keys)
            old = self._rows(held, table, touched)
            merged = rows if old is None else tables.upsert(old.select(*rows.columns), rows, keys.columns, keys)
            order = [c for c in ("fact_type", keys.columns[0]) if c in rows.columns]
            folders = self._written(table, merged, version, keys.columns[0], order) if touched else {}
            kept = {k: f for k, f in held["tables"].get(table, {"folders": {}})["folders"].items() if int(k) not in touched}
            out["tables"][table] = {"key": keys.columns[0], "schema": json.loads(rows.schema.json()), "folders": kept | folders}
        self._commit(version, out)
        return version

    def _commit(self, version: int, manifest: dict) -> None:
        path, fs = self._fs()
        draft, final = path(f"{self.root}/commits/.{uuid.uuid4().hex}"), path(f"{self.root}/commits/{version}.json")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.root} was taken by another writer")

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        return self.merge({table: (rows.select(*keys).distinct(), rows)})

    def delete_paths(self, paths: DataFrame) -> int:
        """What is known of the named paths (column path) is left out of the next version."""
        held = self.manifest()
        gone = tables.cut(paths.select("path").distinct())
        return self.merge({t: (gone.toDF(k["key"]), self.spark.createDataFrame([], T.StructType.fromJson(k["schema"]))) for t, k in held["tables"].items()})

    def set_metadata(self, values: dict[str, str]) -> int:
        return self.merge({}, values)

    def status(self, tree: DataFrame) -> DataFrame:
        """path, state of the files of ``tree`` (path, text) against the file index."""
        return tables.freshness(self.read("files"), tables.manifest(tree, "path", "text"), "path", "sha256")


def build_signature(settings: DataFrame) -> str:
    """One hash over all settings, whatever their order."""
    digests = settings.select(F.sha2(F.to_json(F.struct(*sorted(settings.columns))), 256).alias("d"))
    return digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("d")), ","), 256)).first()[0]
