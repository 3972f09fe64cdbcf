"""Queries over code written from tables against SQL over the tables, and the reading of single statements."""

import os
from pathlib import Path

import duckdb
import pytest

from cairnwork.functions import statements
from cairnwork.plans import code_queries, ingest

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", sorted(code_queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found, cursor = code_queries.QUERIES[name](spark, str(DATA)), con.execute(code_queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    ours, theirs = sorted(map(repr, map(tuple, found.select(*columns).collect()))), sorted(map(repr, cursor.fetchall()))
    assert len(ours) == len(theirs) and [x for x, y in zip(ours, theirs, strict=True) if x != y][:3] == [y for x, y in zip(ours, theirs, strict=True) if x != y][:3]


def test_calls_of_a_statement():
    found = [(k, r, n, len(a)) for _, k, r, n, a in statements.calls_of("x = a.b()->c(x, f(1, 2)) + ns::g() + new ns::Bar(1) + (*fp)(y) + p[3].q(z);")]
    assert found == [("member", "a", "b", 0), ("chained", "a.b()", "c", 2), ("free", None, "f", 2), ("qualified", None, "ns::g", 0), ("constructor", None, "ns::Bar", 1), ("function_pointer", None, "fp", 1), ("member", "p", "q", 1)]
    assert statements.calls_of("if (sizeof(x)) return; while (next()) {")[0][3] == "next" and statements.calls_of("") == []


def test_heads():
    head = lambda t, owner=None: statements.head_of(t, owner)
    assert head("void A::m(int x,\n  const Foo& y) const {") == ("function", "A::m", "definition", "void", [("int", "x"), ("const Foo&", "y")])
    assert head("explicit A(int x) : y(x), z{x} {", "A")[1:3] == ("A", "definition") and head("virtual ~A() = default;", "A")[1:3] == ("~A", "declaration")
    assert head("template <class T, class U> std::map<T, U> f(T a = g(1));")[1:4] == ("f", "declaration", "std::map<T, U>")
    assert head("class API_X Y final : public virtual B, private ns::C<int, long> {") == ("type", "Y", "class", "B,ns::C<int, long>", [])
    assert head("using T = Foo*;")[:4] == ("alias", "T", "using", "Foo*") and head("typedef unsigned long u32;")[:4] == ("alias", "u32", "typedef", "unsigned long")
    assert head("static const Foo* table[3] = {")[:4] == ("variable", "table", "variable", "Foo*") and head("namespace a::b {")[:2] == ("scope", "a::b")
    assert [head(t) for t in ("return f(x);", "x = f(1);", "delete p;", "}", ";", "", "goto out;", "f(1);", "if (x) {")] == [None] * 9
    assert statements.split_top("a, f(b, c), m<d, e>, {1, 2}") == ["a", "f(b, c)", "m<d, e>", "{1, 2}"] and statements.split_top(" ") == []
    assert statements.closing("f(a[1)", 1) == -1 and statements.parameter("unsigned int") == ("unsigned int", None)


def test_scopes_are_a_stack(spark):
    text = 'namespace a { namespace b { void g(){h();} } void f(){h2();} extern "C" { void e(int x); } }\nstruct S { struct I { void m() { k(); } }; void n(); int v = 3; };\nnamespace { void hidden() { auto l = [](int q) { inner(q); }; outer(); } }\nvoid last() {}\nint table[] = { call_like(1) };\nconst char* s = R"(void fake() { no(); })";\n'
    facts = ingest.facts(spark.createDataFrame([("t.cpp", text)], "path string, text string"), ingest.macro_map({})).collect()
    assert sorted(r.subject for r in facts if r.fact_type == "symbol") == ["S::I::m", "S::n", "a::b::g", "a::e", "a::f", "hidden", "last"]
    assert {(r.subject, r.object) for r in facts if r.fact_type == "call"} == {("a::b::g", "h"), ("a::f", "h2"), ("S::I::m", "k"), ("hidden", "inner"), ("hidden", "outer")}
    assert {(r.subject, r.object, r.type) for r in facts if r.fact_type == "field"} == {("S", "v", "int")}


def test_claims_in_prose():
    from cairnwork.operators import rules

    found = [c[:4] for c in rules.claims_in("`a()` calls b, c and d::e. f does not call g, and h reaches i. x is called by y. A derives from B; src/a.c does not include b.h. k is not defined, l is defined.")]
    assert found == [("calls", "positive", "a", "b"), ("calls", "positive", "a", "c"), ("calls", "positive", "a", "d::e"), ("calls", "negative", "f", "g"), ("reaches", "positive", "h", "i"), ("calls", "positive", "y", "x"), ("inherits", "positive", "A", "B"), ("includes", "negative", "src/a.c", "b.h"), ("definition_exists", "negative", "k", ""), ("definition_exists", "positive", "l", "")]
    assert rules.claims_in("") == [] and [c[4:] for c in rules.claims_in("so a calls b")] == [(3, 12)]
