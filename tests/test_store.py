"""The fact store by parts, and refreshes held against full rebuilds."""

import pytest

from cairnwork.operators import graph
from cairnwork.sources.store import FactStore
from cairnwork.streaming import incremental

FILES = "path string, text string"
UNIT = '#include "{h}"\n#if LEVEL\nvoid f{i}(int a) {{\n    go{i}(a);\n}}\n#endif\n'
TREE = {
    "src/deep.h": "#define LEVEL 1\nint deep(int a);\n",
    "src/top.h": '#include "deep.h"\nint top(int a);\n',
    "inc/far.h": "#define LEVEL 0\nint far(int a);\n",
    **{f"src/u{i}.c": UNIT.format(i=i, h=("deep.h", "top.h", "far.h", "none.h")[i % 4]) for i in range(12)},
}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def folders(store, table, version):
    return store.manifest(version)["tables"][table]["folders"]


def test_refresh_equals_rebuild(spark, tmp_path):
    frame = lambda tree: spark.createDataFrame(sorted(tree.items()), FILES)
    own = FactStore(spark, str(tmp_path / "own"), parts=16)
    assert incremental.refresh(own, frame(TREE), {"A": ""}, ["inc"], whole=True)["new"] == len(TREE)
    state = {r.path: r.build_status for r in own.read("facts").filter("fact_type = 'call'").collect()}
    assert state["src/u0.c"] == "active" and state["src/u2.c"] == "inactive" and state["src/u3.c"] == "conditional"
    assert {r.unit for r in own.read("projected").collect()} == {f"src/u{i}.c" for i in range(12) if i % 4 < 3}

    # One source: its part alone is written, in each table.
    one = incremental.refresh(own, frame({"src/u0.c": TREE["src/u0.c"].replace("go0", "went")}), {"A": ""}, ["inc"])
    assert (one["status"], one["stale"], one["read"]) == ("indexed", 1, 1)
    for table in ("files", "includes", "facts", "projected"):
        before, after = folders(own, table, one["version"] - 1), folders(own, table, one["version"])
        assert {int(k) for k in after if after[k] != before.get(k)} == set(own.parts_of(spark.createDataFrame([("src/u0.c",)], "path string")))
    assert {r.object for r in own.read("facts", one["version"] - 1).filter("path = 'src/u0.c' and fact_type = 'call'").collect()} == {"go0"}

    # A header that others include, one that hides another, one that comes; files that go, without and with users.
    later = TREE | {"src/deep.h": "#define LEVEL 0\n", "src/far.h": "#define LEVEL 1\nint near(int a);\n", "src/u0.c": "void gone(void);\n", "src/none.h": "#define LEVEL 2\n"}
    del later["src/u4.c"], later["src/top.h"]
    report = incremental.refresh(own, frame(later), {"A": ""}, ["inc"], whole=True)
    assert {k: report[k] for k in ("new", "stale", "missing")} == {"new": 2, "stale": 2, "missing": 2}
    assert report["read"] == 4 + 10  # touched files that there are; and all other sources but the one that is gone
    full = FactStore(spark, str(tmp_path / "full"), parts=3)
    incremental.refresh(full, frame(later), {"A": ""}, ["inc"], whole=True)
    for table in ("files", "includes", "facts", "projected"):
        assert rows(own.read(table)) == rows(full.read(table)) != []

    # Nothing to do, or not to be done.
    version = own.versions()[-1]
    assert incremental.refresh(own, frame(later), {"A": ""}, ["inc"], whole=True)["status"] == "clean"
    assert incremental.refresh(own, frame({}), {"A": ""}, ["inc"])["status"] == "clean"
    assert incremental.refresh(own, spark.createDataFrame([("never", None), (None, "x")], FILES), {"A": ""}, ["inc"])["status"] == "clean"
    odd = incremental.refresh(own, frame({"notes.txt": "x"}), {"A": ""}, ["inc"])
    assert (odd["status"], odd["reason"]) == ("full_reingest_required", "unknown_kind")
    other = incremental.refresh(own, frame(later), {"A": "1"}, ["inc"], whole=True)
    assert (other["status"], other["reason"]) == ("full_reingest_required", "settings_changed")
    assert own.versions()[-1] == version


def test_store_commits(spark, tmp_path):
    own = FactStore(spark, str(tmp_path / "s"), parts=4)
    frame = lambda *r: spark.createDataFrame(r, "path string, n int")
    assert own.versions() == [] and own.read("t") is None and own.read("metadata") is None
    own.upsert("t", frame(("a", 1), ("b", 2), (None, 3)), ["path"])
    own.upsert("t", frame(("a", 4), (None, 5)), ["path"])
    assert rows(own.read("t")) == rows(frame(("a", 4), ("b", 2), (None, 5)))
    assert rows(own.read("t", 1)) == rows(frame(("a", 1), ("b", 2), (None, 3)))
    assert FactStore(spark, str(tmp_path / "s"), parts=9).parts == 4
    # Folders of a job that was lost are no part of any version; a version is taken once.
    frame(("x", 9)).write.parquet(str(tmp_path / "s/t/v3-lost/part=0"))
    assert rows(own.read("t")) == rows(frame(("a", 4), ("b", 2), (None, 5)))
    with pytest.raises(RuntimeError):
        own._commit(2, own.manifest())
    own.delete_paths(spark.createDataFrame([("a",), ("b",), (None,)], "path string"))
    assert own.read("t").count() == 0 and own.read("t").columns == ["path", "n"]
    own.upsert("t", frame(("c", 1)), ["path"])
    assert rows(own.read("t")) == rows(frame(("c", 1)))


def test_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z"), ("d", None)], "src string, dst string")
    found = lambda *starts: sorted(r.node for r in graph.closure(edges, spark.createDataFrame([(s,) for s in starts], "node string")).collect())
    assert found("a") == ["a", "b", "c"] and found("x", "c", None) == ["a", "b", "c", "x", "y"] and found() == []
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)], "src string, dst string")
    assert graph.closure(chain, spark.createDataFrame([("0",)], "node string")).count() == 21
