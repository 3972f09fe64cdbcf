"""Every catalogued kernel against its SQL on the smallest tables, and the functions on odd values."""

import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnwork.functions import guards, names
from cairnwork.operators import graph, intervals, resolve, rules, search, tables, verdicts
from cairnwork.plans import catalogue

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    return repr(float(value)) if type(value).__name__ == "Decimal" else repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, str(DATA))
    cursor = duck.execute(catalogue.SQL[name])
    columns = sorted(found.columns)
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    ours = sorted(tuple(_plain(r[c]) for c in columns) for r in found.collect())
    assert ours == sorted(tuple(_plain(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall())


def test_name_matching(spark):
    rows = [("a::f", "f", True, True), ("f", "a::f", False, True), ("a::f", "b::f", False, True), ("f(int)", "f", True, True), ("a::f(int)", "f", True, True), ("af", "f", False, False), (None, "f", False, False), ("f", "", False, False), ("f", None, False, False)]
    got = spark.createDataFrame([r[:2] for r in rows], "n string, q string").select(names.matches_name(F.col("n"), F.col("q")).alias("a"), names.matches_either(F.col("n"), F.col("q")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [r[2:] for r in rows]
    paths = [("src/a.c", "a.c", True), ("./src/a.c", "x/src/a.c", True), ("src\\a.c", "src/a.c", True), ("ba.c", "a.c", False)]
    got = spark.createDataFrame([p[:2] for p in paths], "a string, b string").select(names.matches_path(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in got] == [p[2] for p in paths]
    row = spark.createDataFrame([("a::b::c", "src/Third_Party/x.c", " `run()`. ")], "n string, p string, t string").select(names.suffixes(F.col("n")).alias("s"), names.path_role(F.col("p")).alias("r"), names.clean_endpoint(F.col("t")).alias("t"), names.slug(F.lit("a b/c")).alias("g"), names.symbol_id(F.lit("x")).alias("i")).first()
    assert row.s == ["a::b::c", "b::c", "c"] and row.r == "vendor" and row.t == "run" and row.g == "a_b_c" and len(row.i) == 20


def test_guards_combine(spark):
    rows = [("active", "inactive", "inactive"), ("active", "conditional", "conditional"), ("active", "active", "active"), ("conditional", "inactive", "inactive")]
    got = spark.createDataFrame(rows, "a string, b string, c string").select(guards.combine(F.col("a"), F.col("b")).alias("x"), "c").collect()
    assert all(r.x == r.c for r in got)
    assert guards.guard_status("if", "", {})[0] == "conditional"


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "N"), (3, "c")], "k int, v string")
    assert sorted(tables.upsert(old, new, ["k"]).collect(), key=str) == sorted([(1, "a"), (2, "B"), (None, "N"), (3, "c")], key=str)
    states = {r.k: r.state for r in tables.freshness(old.filter("k is not null"), new.filter("k is not null"), "k", "v").collect()}
    assert states == {1: "missing", 2: "stale", 3: "new"}
    numbers = spark.range(7).toDF("x")
    assert [(r.x, r.position, r.total, r.next_offset) for r in tables.page(numbers, [F.col("x")], 3, 3).orderBy("x").collect()] == [(3, 3, 7, 6), (4, 4, 7, 6), (5, 5, 7, 6)]
    assert [r.next_offset for r in tables.page(numbers, [F.col("x")], 3, 6).collect()] == [None]
    assert tables.page(numbers, [F.col("x")], 0, 0).count() == 0
    with pytest.raises(ValueError):
        tables.page_bounds(-1)
    assert tables.page_bounds(10_000) == (500, 0)


def test_intervals(spark):
    marks = spark.createDataFrame([("k", 1, 10), ("k", 5, 50), ("k", 5, 51)], "k string, at int, v int")
    probes = spark.createDataFrame([("k", 0), ("k", 1), ("k", 4), ("k", 5), ("z", 9)], "k string, at int")
    got = {(r.k, r.at): r.v2 for r in intervals.as_of(probes, marks, ["k"], "at", "v", "v2").collect()}
    assert got == {("k", 0): None, ("k", 1): 10, ("k", 4): 10, ("k", 5): 51, ("z", 9): None}


def test_alias_chain_of_any_length(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(700)] + [("a", "b"), ("b", "c"), ("c", "b")]
    out = {r.name: r.final for r in graph.alias_closure(spark.createDataFrame(pairs, "name string, target string"), "name", "target").collect()}
    assert out == {f"n{i}": "n700" for i in range(700)} | {"a": None, "b": None, "c": None}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "x"), ("b", "d")], "src string, dst string")
    got = {r.node: (r.hops, r.via) for r in graph.reach(edges, spark.createDataFrame([("a",), (None,)], "start string")).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (2, "b"), "d": (2, "b")}
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(30)], "src string, dst string")
    assert graph.reach(chain, spark.createDataFrame([("n000",)], "start string")).agg(F.max("hops")).first()[0] == 30


def test_call_resolution(spark):
    calls = spark.createDataFrame([(1, "n", "f", 1), (2, "n", "a::f", 1), (3, "n", "g", 0), (4, "m", "f", 2), (5, "m", "zzz", 0)], "call_id int, caller_ns string, callee string, argc int")
    symbols = spark.createDataFrame([("n::f", 1, True), ("a::f", 1, True), ("m::f", 1, False), ("x::g", 0, True), ("y::g", 0, True)], "qualified_name string, argc int, is_definition boolean")
    got = {r.call_id: (r.resolved, r.status) for r in resolve.call_resolution(calls, symbols).collect()}
    assert got == {1: ("n::f", "resolved"), 2: ("a::f", "resolved"), 3: (None, "ambiguous"), 4: ("m::f", "resolved"), 5: (None, "unresolved")}


def test_verdict_rules(spark):
    rows = spark.createDataFrame([(None,)], "v string").agg(verdicts.overall(F.col("v")).alias("o"), verdicts.worst_support(F.col("v")).alias("w")).first()
    assert tuple(rows) == ("unknown", "unknown")
    level = spark.createDataFrame([(0, "active", "resolved", "verified"), (1, "mixed", "resolved", "verified"), (1, "active", "not_tracked", "verified"), (2, "active", "resolved", "verified")], "n int, b string, s string, c string")
    assert [r[0] for r in level.select(verdicts.support_level(F.col("n"), F.col("b"), F.col("s"), F.col("c"))).collect()] == ["unknown", "weak", "medium", "strong"]


def test_rules_and_search(spark):
    calls = spark.createDataFrame([("std::fopen",), ("fclose",), ("other",)], "callee string")
    pack = spark.createDataFrame(rules.FILE_RULES, "api string, predicate string, operation string, relation string")
    assert {r.predicate for r in rules.apply_rules(calls, pack, "callee").collect()} == {"opens_file", "closes_file"}
    docs = spark.createDataFrame([(1, "one two two"), (2, None), (3, "three")], "d int, t string")
    assert [r.d for r in search.bm25(docs, "d", "t", ["two", "nowhere"]).collect()] == [1]


def test_lexical(spark):
    from cairnwork.functions import lexical

    one = spark.range(1)
    types = {"const char *": "char", "static  const Foo&": "Foo", "std::vector< int >": "int", "struct node **": "node"}
    got = one.select(*(lexical.bare_type(F.lit(t)).alias(str(i)) for i, t in enumerate(types))).first()
    assert list(got) == list(types.values())
    hints = {'"x"': "string", "L'c'": "char", "true": "bool", "NULL": "nullptr", "0x1Fu": "int", "1.5f": "float", "x + 1": None}
    assert list(one.select(*(lexical.literal_hint(F.lit(t)).alias(str(i)) for i, t in enumerate(hints))).first()) == list(hints.values())
    fits = [("int", "const char*", False), ("string", "const char*", True), ("nullptr", "void *", True), ("int", "uint8_t", True), (None, "Foo", True)]
    assert list(one.select(*(lexical.fits_hint(F.lit(h).cast("string"), F.lit(p)).alias(str(i)) for i, (h, p, _) in enumerate(fits))).first()) == [f[2] for f in fits]
    assert list(one.select(lexical.context_of(F.lit("xQueueSendFromISR")).alias("a"), lexical.context_of(F.lit("vIdleTask")).alias("b"), lexical.context_of(F.lit("main")).alias("c"), lexical.qualifiers(F.lit("static inline int")).alias("d")).first()) == ["isr", "task", None, ["inline", "static"]]


def test_dataflow(spark):
    from cairnwork.operators import dataflow

    registered = spark.createDataFrame([("a.c", 3, "lib::on_event", "handler"), ("a.c", 9, "on_event", "handler"), ("b.c", 1, "on_event", "other")], "path string, line int, api string, callback string")
    stored = spark.createDataFrame([("a.c", 20, "on_event", "cb")], "path string, line int, function string, field string")
    invoked = spark.createDataFrame([("a.c", 30, "loop", "cb"), ("a.c", 31, "loop", "cb"), ("a.c", 40, "tick", "cb")], "path string, line int, function string, field string")
    assert sorted(map(tuple, dataflow.dataflow(registered, stored, invoked).collect())) == [("a.c", "handler", "cb", "loop", 3, 20, 30), ("a.c", "handler", "cb", "tick", 3, 20, 40)]
    names_ = spark.createDataFrame([("send",), ("sendFromISR",), ("recvFromISR",)], "n string")
    assert [tuple(r) for r in dataflow.paired(names_, "n").collect()] == [("send", "sendFromISR")]
