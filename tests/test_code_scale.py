"""What keeps extraction and questions from growing faster than their tables."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from cairnwork.functions import statements
from cairnwork.operators import receivers, scopes, tables
from cairnwork.plans import code_queries, evidence, headers, ingest, questions

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

TREE = [
    ("a.c", "#if 0\nvoid gone() { x(); }\n#endif\nnamespace n {\nclass A : public B {\n  void m(int q);\n};\nvoid A::m(int q) { int v = 2; f(q);\n#ifdef U\n  g(v);\n#endif\n}\n}\nops t[] = { on, off };\n"),
    ("b.c", "void run() { common(); }\nvoid walk() { common(); }\n"),
    ("none.c", None),
]


def _facts(spark):
    return ingest.facts(spark.createDataFrame(TREE, "path string, text string"), ingest.macro_map({}))


def test_statements_are_neither_shuffled_nor_sorted(spark):
    facts = _facts(spark)
    plan = facts.filter("fact_type = 'call'")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "calls" in {r.predicate for r in facts.collect()}
    found = {(r.subject, r.object, r.line, r.build_status) for r in facts.collect() if r.fact_type == "call"}
    assert found == {("gone", "x", 2, "inactive"), ("n::A::m", "f", 8, "active"), ("n::A::m", "g", 10, "conditional"), ("run", "common", 1, "active"), ("walk", "common", 2, "active")}


def test_declarations_hold_their_blocks():
    found = statements.declarations("namespace a {\nvoid f() {\n g();\n}\n}\nint t[] = { x };", [(3, 3, 2)])
    assert [(d[0].strip(), d[2], [(s[0].strip(), s[2], s[3], s[6]) for s in d[3]]) for d in found][:2] == [
        ("namespace a {", "", [("namespace a {", False, 1, "")]),
        ("void f() {", "a", [("void f() {", False, 1, ""), ("g();", True, 2, "02"), ("}", True, 3, "20")]),
    ]
    assert [s[5].strip() for s in found[3][3]] == ["", "int t[] = {"]


def test_stored_tables_are_written_once(spark):
    rows = tables.stored(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k")
    assert tables.stored(rows, "k") is rows and rows.columns == ["k", "v"] and sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2)]
    empty = tables.stored(rows.filter("v > 5"), "k")
    assert empty.columns == ["k", "v"] and empty.isEmpty()


def test_questions_that_ask_the_same_are_answered_once(spark, monkeypatch):
    asked = spark.createDataFrame([(str(i), f"common caller {i}") for i in range(20)] + [("x", None), ("y", "path run"), (None, "run の定義")], "id string, q string")
    facts = tables.stored(_facts(spark), "fact_type")
    expected = questions.assess(asked, "id", "q", questions.answers(asked, "id", "q", facts))
    sizes, answers = [], questions._answers

    def counted(want, key, facts):
        out = answers(want, key, facts)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(questions, "_answers", counted)
    found = questions.assess_facts(asked, "id", "q", facts)
    assert found.columns == expected.columns and sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect())) and sizes == [3]


def test_every_question_gets_its_answers(spark, monkeypatch):
    monkeypatch.setattr(questions, "PER_BUCKET", 3)
    asked = spark.createDataFrame([(str(i), "common caller") for i in range(10)] + [(None, "run callee")], "id string, q string")
    found = questions.answers(asked, "id", "q", _facts(spark))
    assert found.columns == ["id", "mode", "kind", "path", "line", "subject", "object", "build_status"]
    expected = [(str(i), s) for i in range(10) for s in ("run", "walk")]
    rows = found.collect()
    assert sorted((r.id, r.subject) for r in rows if r.id) == expected and [(r.subject, r.object) for r in rows if not r.id] == [("run", "common")]


def test_common_questions_are_not_left_out(spark):
    found = code_queries.code_answered(spark, str(DATA))
    n = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert found.filter("object = 'bus_registerHandler'").count() == n * n


def test_prose_is_read_once(spark):
    texts = spark.createDataFrame([(1, "run calls common."), (2, "walk does not call common."), (3, None)], "id int, body string")
    found = evidence.verify_text(texts, "id", "body", _facts(spark))
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.overall, r.claims) for r in found.collect()) == [(1, "conditional", 1), (2, "conditional", 1), (3, "unknown", 0)]


def test_type_names_are_looked_up_once(spark, monkeypatch):
    looked, full_names = [], scopes.full_names
    monkeypatch.setattr(scopes, "full_names", lambda uses, known: looked.append(1) or full_names(uses, known))
    text = "class B { public: void go(); };\nclass A : public B { };\nusing C = A;\nvoid f(C* c) { c->go(); }\n"
    facts = tables.stored(ingest.facts(spark.createDataFrame([("x.cpp", text)], "path string, text string"), ingest.macro_map({})), "fact_type")
    assert [(r.full, r.holder) for r in receivers.receiver_types(facts).collect()] == [("A", "B")] and len(looked) == 1


def test_only_calls_on_receivers_are_typed(spark, monkeypatch):
    rows, typed = [], receivers.typed

    def counted(calls, facts):
        rows.append(calls.count())
        return typed(calls, facts)

    monkeypatch.setattr(receivers, "typed", counted)
    text = "struct B { void go(int a); };\nvoid f(B* b) { b->go(1); g(); h(2); B c(3); }\n"
    found = evidence.edges(ingest.facts(spark.createDataFrame([("x.cpp", text)], "path string, text string"), ingest.macro_map({}))).collect()
    assert sorted((r.callee, r.resolved) for r in found if r.resolved) == [("go", "B::go")] and len(found) == 4 and rows == [1]


def test_kinds_without_claims_cost_nothing(spark, monkeypatch):
    def never(*_):
        raise AssertionError("no claim asks for this")

    monkeypatch.setattr(evidence, "edges", never)
    monkeypatch.setattr(evidence.graph, "reach", never)
    claims = spark.createDataFrame([(1, "definition_exists", "A::m", ""), (2, "definition_exists", "gone", ""), (3, None, "x", "y"), (4, "other", "x", "y")], "claim_id int, claim_type string, subject string, object string")
    found = evidence.verify(claims, _facts(spark))
    assert sorted((r.claim_id, r.verdict) for r in found.collect()) == [(1, "supported"), (2, "contradicted"), (3, "unknown"), (4, "unknown")]


def test_headers_are_read_once_for_equal_macros(spark, monkeypatch):
    read, facts = [], ingest.facts

    def counted(files, macros):
        read.append(files.count())
        return facts(files, macros)

    monkeypatch.setattr(ingest, "facts", counted)
    files = spark.createDataFrame([("h.h", '#include "deep.h"\n#ifdef A\nint top(int a);\n#endif\n'), *((f"u{i}.c", '#include "h.h"\n') for i in range(6))], "path string, text string")
    macros = spark.createDataFrame([("u0.c", "A", "1"), ("u1.c", "A", "1")], "unit string, name string, value string")
    found = headers.projected_facts(files, [], macros).collect()
    assert read == [2]
    assert {(r.path, r.build_status) for r in found if r.subject == "top"} == {(f"u{i}.c > h.h", "active" if i < 2 else "conditional") for i in range(6)}
    assert {r.path for r in found if r.fact_type == "include"} == {r.subject for r in found if r.fact_type == "include"} == {f"u{i}.c > h.h" for i in range(6)}


def test_files_that_come_from_a_join_are_read_by_all_tasks(spark):
    names = spark.range(64).select(F.concat(F.lit("u"), "id", F.lit(".c")).alias("path"), F.format_string("void f%d() { g(); }\n", "id").alias("text"))
    files = names.join(names.select("path").hint("merge"), "path")
    calls = ingest.facts(files, ingest.macro_map({})).filter("fact_type = 'call'").select("subject", F.spark_partition_id().alias("p")).collect()
    assert len(calls) == 64 and len({r.p for r in calls}) == 4
