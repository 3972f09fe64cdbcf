"""Facts of the sample corpus, sources, store and the incremental refresh."""

import json
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnwork.plans import corpus_queries, evidence, ingest
from cairnwork.sources import corpus, sample, store
from cairnwork.streaming import incremental


@pytest.mark.parametrize("name", sorted(corpus_queries.SQL))
def test_corpus_query(spark, name):
    found = corpus_queries.QUERIES[name](spark, "")
    cursor = duckdb.sql(corpus_queries.SQL[name])
    columns = sorted(found.columns)
    assert sorted(cursor.columns) == columns
    theirs = sorted(tuple(repr(r[cursor.columns.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(repr(r[c]) for c in columns) for r in found.collect()) == theirs


NESTED = """#ifdef KNOWN
a
#if 0
b
#else
c
#endif
#elif 1
d
#endif
#if UNKNOWN
e
#elif 0
f
#elif 1
g
#else
h
#endif
#endif
i
#if 1
j
"""


def test_line_status(spark):
    files = spark.createDataFrame([("n.c", NESTED), ("empty.c", ""), ("null.c", None)], "path string, text string")
    from cairnwork.operators import tables

    raw = tables.lines(files, "path", "text")
    status = ingest.line_status(raw, ingest.branches(raw, ingest.macro_map({"KNOWN": ""})))
    got = {r.line: r.build_status for r in status.collect() if len(r.line) == 1}
    assert got == {"a": "active", "b": "inactive", "c": "active", "d": "inactive", "e": "conditional", "f": "inactive", "g": "conditional", "h": "conditional", "i": "active", "j": "active"}


def test_facts_of_nothing(spark):
    empty = spark.createDataFrame([], "path string, text string")
    assert ingest.facts(empty, ingest.macro_map({})).count() == 0
    assert ingest.facts(spark.createDataFrame([("a.c", None), ("b.c", "/* unclosed f(")], "path string, text string"), ingest.macro_map({})).count() == 0


def test_blank_keeps_columns():
    text = 'a("x//y") /* b\nc */ d // e\n\'"\' f'
    assert ingest.blank(text) == "a(      )     \n     d     \n    f"


def test_scan_tree(spark, tmp_path):
    (tmp_path / "src" / "gen").mkdir(parents=True)
    (tmp_path / "src" / "a.c").write_text("int a;")
    (tmp_path / "src" / "b.HPP").write_bytes(b"\xff\xfe bad")
    (tmp_path / "src" / "gen" / "c.c").write_text("int c;")
    (tmp_path / "notes.txt").write_text("no")
    rows = {r.path: r for r in corpus.scan_tree(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["src/a.c", "src/b.HPP", "src/gen/c.c"]
    assert rows["src/a.c"].text == "int a;" and rows["src/b.HPP"].kind == "header" and "bad" in rows["src/b.HPP"].text
    assert sorted(r.path for r in corpus.scan_tree(spark, str(tmp_path), ["src/gen/**"]).collect()) == ["src/a.c", "src/b.HPP"]
    assert sorted(r.path for r in corpus.scan_tree(spark, str(tmp_path), ["gen", "*.HPP"]).collect()) == ["src/a.c"]


def test_compile_commands(spark, tmp_path):
    entries = [{"directory": "/d", "command": "cc -DA=1 -D B -DA=2 -I inc -Iother 'a b.c'", "file": "a b.c"}, {"directory": "/d", "arguments": ["cc", "-DC=x=y", "c.c"], "file": "c.c"}]
    (tmp_path / "compile_commands.json").write_text(json.dumps(entries))
    rows = corpus.compile_commands(spark, str(tmp_path / "compile_commands.json"))
    assert {r.file: r.macros for r in corpus.macros(rows).collect()} == {"a b.c": {"A": "2", "B": ""}, "c.c": {"C": "x=y"}}
    assert sorted(r.value for r in corpus.options(rows, "-I").collect()) == ["inc", "other"]


def test_store_and_refresh(spark, tmp_path):
    own = store.FactStore(spark, str(tmp_path / "store"))
    assert own.read("facts") is None
    incremental.refresh(own, sample.files(spark), sample.MACROS)
    first = own.read("facts").count()
    assert first == ingest.facts(sample.files(spark), ingest.macro_map(sample.MACROS)).count()
    assert {r.state for r in own.status(sample.files(spark)).collect()} == {"clean"}
    changed = spark.createDataFrame([("src/main.c", "int main(void) {\n    other();\n}\n")], "path string, text string")
    states = {r.path: r.state for r in own.status(sample.files(spark).filter("path <> 'src/pool.cpp' and path <> 'src/main.c'").unionByName(changed)).collect()}
    assert states["src/main.c"] == "stale" and states["src/pool.cpp"] == "missing"
    (tmp_path / "in").mkdir()
    changed.write.mode("append").parquet(str(tmp_path / "in"))
    incremental.follow(spark, str(tmp_path / "in"), own, sample.MACROS, str(tmp_path / "check")).awaitTermination()
    calls = {r.object for r in own.read("facts").filter("path = 'src/main.c' and fact_type = 'call'").collect()}
    assert calls == {"other"}
    assert own.read("facts").filter("path <> 'src/main.c'").count() == first - ingest.facts(sample.files(spark).filter("path = 'src/main.c'"), ingest.macro_map(sample.MACROS)).count()
    own.delete_paths(spark.createDataFrame([("src/main.c",)], "path string"))
    assert own.read("facts").filter("path = 'src/main.c'").count() == 0
    own.set_metadata({"a": "1", "b": "2"})
    own.set_metadata({"b": "3"})
    assert {r.key: r.value for r in own.read("metadata").collect()} == {"a": "1", "b": "3"}
    kinds = spark.createDataFrame([("h.h", "header"), ("s.c", "source")], "path string, kind string")
    moved = spark.createDataFrame([("h.h", "stale"), ("s.c", "stale"), ("x", "new"), ("y", "missing")], "path string, state string")
    assert {r.path: r.reason for r in incremental.needs_full(moved, kinds).collect()} == {"h.h": "header_changed", "x": "unknown_kind"}
    settings = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string")
    assert store.build_signature(settings) == store.build_signature(settings.orderBy(F.desc("name"))) != store.build_signature(settings.limit(1))


def test_questions():
    assert evidence.question_mode("Who calls `start`?") == ("callers", ["start"])
    assert evidence.question_mode("Where is pool::alloc defined?")[0] == "definition"
    found = defaultdict(int)
    for c in corpus_queries.CLAIMS:
        found[c[4]] += 1
    assert set(found) == {"supported", "conditional", "unknown", "contradicted"}


def test_headers(spark):
    from cairnwork.plans import headers

    files = sample.files(spark)
    got = {(r.path, r.target): (r.header, r.local) for r in headers.resolve_includes(files, ["include", "third_party"]).collect()}
    assert got == {("src/main.c", "engine.h"): ("include/engine.h", True), ("src/main.c", "stdio.h"): (None, False), ("src/engine.c", "engine.h"): ("include/engine.h", True), ("src/pool.cpp", "pool/pool.hpp"): ("third_party/pool/pool.hpp", True)}
    assert [(r.path, r.name, r.value) for r in headers.header_macros(files, ingest.macro_map({})).collect()] == [("include/engine.h", "LEVEL", "1")]
    command = spark.createDataFrame([("src/main.c", {"LEVEL": "2", "X": ""})], "file string, macros map<string,string>")
    units = {(r.unit, r.name): (r.value, r.origins) for r in headers.unit_macros(files, ["include", "third_party"], command, {"NDEBUG": ""}).collect()}
    assert units[("src/main.c", "LEVEL")] == ("2", "1_header,2_command") and units[("src/engine.c", "LEVEL")] == ("1", "1_header") and units[("src/pool.cpp", "NDEBUG")] == ("", "3_profile")
    macros_of = spark.createDataFrame([("src/main.c", "ENGINE_H", "")], "unit string, name string, value string")
    rows = headers.projected_facts(files, ["include", "third_party"], macros_of).filter("fact_type = 'symbol'").collect()
    assert {(r.path, r.subject): r.build_status for r in rows} == {("src/main.c > include/engine.h", "start"): "inactive", ("src/main.c > include/engine.h", "helper"): "inactive", ("src/engine.c > include/engine.h", "start"): "conditional", ("src/engine.c > include/engine.h", "helper"): "conditional", ("src/pool.cpp > third_party/pool/pool.hpp", "pool::alloc"): "active"}


def test_targets(spark):
    from cairnwork.operators.target import Profile, decide

    files = spark.createDataFrame([("src/a.c",), ("src/b.c",), ("port/x/p.c",), ("port/y/p.c",), ("heap/h1.c",), ("heap/h2.c",), ("old/z.c",), ("inc/a.h",)], "path string")
    built = spark.createDataFrame([("src/a.c",), ("port/x/p.c",), ("heap/h1.c",)], "path string")
    profile = Profile(inactive_prefixes=["old"], port_root="port", active_port="port/x", heap_root="heap", heap="heap/h1.c")
    got = {r.path: (r.status, r.reason) for r in decide(files, profile, built).collect()}
    assert got["src/b.c"] == ("inactive", "not_in_compile_commands") and got["port/y/p.c"] == ("inactive", "non_selected_port") and got["heap/h2.c"] == ("inactive", "non_selected_heap") and got["old/z.c"] == ("inactive", "inactive_path_prefix")
    assert got["src/a.c"] == ("active", "compile_commands_entry") and got["inc/a.h"] == ("active", "default_active")


def test_workflow(spark, tmp_path):
    from cairnwork.operators import tables
    from cairnwork.plans import workflow

    facts = ingest.facts(sample.files(spark), ingest.macro_map(sample.MACROS))
    report = workflow.diagnostics(facts, tables.manifest(sample.files(spark), "path", "text"))
    assert {(r.kind, r.name): r.n for r in report.collect()}[("file_role", "vendor")] == 1
    clean = spark.createDataFrame([("a", "clean")], "path string, state string")
    assert workflow.preflight(workflow.warnings(report, clean)).first().level == "caution"
    assert workflow.preflight(workflow.warnings(report, clean.selectExpr("path", "'stale' as state"))).first().level == "degraded"
    texts = spark.createDataFrame([(1, "It always works."), (2, "fine"), (3, "I think so")], "k int, t string")
    judged = spark.createDataFrame([(1, "contradicted"), (2, "supported"), (2, "supported")], "k int, verdict string")
    got = {r.k: (r.safety, r.can_answer, r.must_not_send, r.allowed, r.violations) for r in workflow.contracts(judged, texts, "k", "t").collect()}
    assert got == {1: ("unsafe", False, True, 0, 1), 2: ("safe", True, False, 2, 0), 3: ("needs_more_evidence", False, False, 0, 1)}
    workflow.log_sessions(spark.createDataFrame([(1, "a"), (2, "b")], "at int, q string"), str(tmp_path / "log"))
    workflow.log_sessions(spark.createDataFrame([(3, "c")], "at int, q string"), str(tmp_path / "log"))
    assert [r.at for r in workflow.read_sessions(spark, str(tmp_path / "log"), "at", 2).collect()] == [3, 2]
    measured = spark.createDataFrame([("c", "ms", 10), ("c", "facts", 5)], "case_id string, metric string, measured int")
    budgets = spark.createDataFrame([("c", "ms", 9)], "case_id string, metric string, budget int")
    assert [r.metric for r in workflow.over_budget(measured, budgets).collect()] == ["ms"]


def test_relations(spark):
    from cairnwork.operators import packs
    from cairnwork.plans import relations

    text = """
void worker(void) {
    taskENTER_CRITICAL();
    taskEXIT_CRITICAL();
}
void handler(void) {
    xSemaphoreGiveFromISR(s, &w);
#if 0
    vTaskSuspendAll();
#endif
}
void plain(void) { other(); }
"""
    facts = ingest.facts(spark.createDataFrame([("k.c", text)], "path string, text string"), ingest.macro_map({}))
    found = relations.relations(facts, packs.rules(spark))
    assert {(r.subject, r.predicate, r.context, r.build_status) for r in found.collect()} == {("worker", "enters_critical_section", "task", "active"), ("worker", "exits_critical_section", "task", "active"), ("handler", "gives_semaphore", "isr", "active"), ("handler", "suspends_scheduler", "task", "inactive")}
    claims = [(1, "scheduler", "worker", "enters_critical_section", "", "supported"), (2, "scheduler", "worker", "suspends_scheduler", "", "contradicted"), (3, "kernel_object", "handler", "gives_semaphore", "semaphore", "conditional"), (4, "kernel_object", "handler", "takes_semaphore", None, "unknown"), (5, "scheduler", "handler", "suspends_scheduler", "", "unknown"), (6, "heap", "nobody", "frees_heap_memory", "", "unknown")]
    got = {r.claim_id: r.verdict for r in relations.verify(spark.createDataFrame([c[:5] for c in claims], "claim_id int, pack string, subject string, predicate string, object string"), found).collect()}
    assert got == {c[0]: c[5] for c in claims}


def test_statements_are_read_in_linear_time():
    import time

    from cairnwork.functions import statements

    for text in ("f(1)," * 20_000, "a" + ".b(1)" * 4_000, "x" * 50_000, "a::" * 20_000, "a<b>::" * 10_000, "a<b," * 20_000, "(" * 20_000):
        began = time.perf_counter()
        statements.calls_of(text + ";")
        assert time.perf_counter() - began < 5, text[:10]
    assert len(statements.calls_of("f(1)," * 20_000 + ";")) == 20_000


@pytest.mark.parametrize(
    ("text", "calls"),
    [
        ("g({1}, b);", [("free", None, "g", 2)]),
        ("h([&](int x) { k(x); }, 2);", [("free", None, "h", 2), ("free", None, "k", 1)]),
        ("a::b<int>::c(4);", [("qualified", None, "a::b::c", 1)]),
        ("f(a < b, c);", [("free", None, "f", 2)]),
        ("f(a < b && q, c > d);", [("free", None, "f", 2)]),
        ("f(pair<int, b>(1), c);", [("free", None, "f", 2), ("free", None, "pair", 1)]),
        ("p->m[3].go(1, 2).on();", [("member", "p.m", "go", 2), ("chained", "p.m.go()", "on", 0)]),
        ("(*p->hook)(b);", [("function_pointer", None, "p.hook", 1)]),
        ("case 1:f(2);", [("free", None, "f", 1)]),
    ],
)
def test_calls_of_a_statement(text, calls):
    from cairnwork.functions import statements

    assert [(kind, receiver, name, len(args)) for _, kind, receiver, name, args in statements.calls_of(text)] == calls


def test_pieces_end_outside_of_round_brackets():
    from cairnwork.functions import statements

    assert [p.strip() for p in statements.pieces("void f() { h([&] { k(); }, 2); for (a; b; c) { d(); } if (x && if (y) { z(); } } int w;")] == [
        "void f() {", "h([&] { k(); }, 2);", "for (a; b; c) {", "d();", "}", "if (x && if (y) {", "z();", "}", "}", "int w;", "",
    ]


def test_facts_of_heads_with_attributes_specialisations_and_initialisers(spark):
    from cairnwork.plans import ingest

    text = """template<> void spec<int>(int a) { s1(a); }
__attribute__((noinline)) void before(void) { s2(); }
void after(void) __attribute__((noreturn)) { s3(); }
struct Y { Y(int q) : base(init(q)), z(make()) { s4(); } };
void user() {
    each([&](int x) { Y *local; inner(x); }, {1, 2});
}
"""
    found = ingest.facts(spark.createDataFrame([("a.cpp", text)], "path string, text string"), ingest.macro_map({}))
    got = {(r.subject, r.object, r.line, r.argc) for r in found.filter("fact_type = 'call'").collect()}
    assert got == {("spec", "s1", 1, 1), ("before", "s2", 2, 0), ("after", "s3", 3, 0), ("Y::Y", "init", 4, 1), ("Y::Y", "make", 4, 0), ("Y::Y", "s4", 4, 0), ("user", "each", 6, 2), ("user", "inner", 6, 1)}
    assert ("user", "local") in {(r.subject, r.object) for r in found.filter("fact_type = 'binding'").collect()}


def test_a_path_is_as_sure_as_its_least_sure_hop(spark):
    from cairnwork.plans import ingest, questions

    text = "void r(void) { }\nvoid q(void) { r(); }\nvoid p(void) {\n#ifdef X\n    q();\n#endif\n}\nvoid s(void) { q(); }\n"
    facts = ingest.facts(spark.createDataFrame([("a.c", text)], "path string, text string"), ingest.macro_map({"KNOWN": "1"}))
    asked = spark.createDataFrame([(1, "p から r への path"), (2, "s から r への path")], "id int, q string")
    answered = questions.answers(asked, "id", "q", facts).cache()
    assert {(r.id, r.path, r.build_status) for r in answered.filter("kind = 'call_path'").collect()} == {(1, "p > q > r", "conditional"), (2, "s > q > r", "active")}
    assert {(r.id, r.answerability) for r in questions.assess(asked, "id", "q", answered).collect()} == {(1, "partial"), (2, "answerable")}
