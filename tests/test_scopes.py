"""Names in scopes, members of bases, receivers in files that use the same names."""

from cairnwork.operators import receivers, scopes
from cairnwork.plans import ingest


def test_full_names(spark):
    known = spark.createDataFrame([("a::Node",), ("b::Node",), ("Node",), ("a::c::Leaf",), ("a::c::Node::Inner",), ("",)], "full string")
    uses = [
        ("a", "Node", "a::Node"), ("a::c", "Node", "a::Node"), ("b::x", "Node", "b::Node"), ("", "Node", "Node"), (None, "Node", "Node"), ("z", "Node", "Node"),
        ("z", "Leaf", "a::c::Leaf"), ("a", "c::Leaf", "a::c::Leaf"), ("a::c::Node", "Inner", "a::c::Node::Inner"), ("z", "int", "int"), ("a", "b::Node", "b::Node"),
    ]
    rows = spark.createDataFrame([u[:2] for u in uses] + [("a", None)], "scope string, name string")
    found = {(r.scope, r.name): r.full for r in scopes.full_names(rows, known).collect()}
    assert found == {(s or "", n): f for s, n, f in uses}
    two = spark.createDataFrame([("a::Node",), ("b::Node",)], "full string")
    assert [r.full for r in scopes.full_names(spark.createDataFrame([("", "Node")], "scope string, name string"), two).collect()] == ["Node"]
    assert scopes.full_names(rows.limit(0), known).count() == 0


def test_inherited(spark):
    own = spark.createDataFrame([("A", "f()", "x"), ("B", "f()", "y"), ("C", "g()", "z"), ("E", "h()", "1"), ("F", "h()", "2")], "of string, member string, v string")
    above = spark.createDataFrame([("C", "C", 0), ("C", "B", 1), ("C", "A", 2), ("D", "E", 1), ("D", "F", 1), ("D", "A", 2)], "of string, base string, hops int")
    found = {(r.of, r.member): r.v for r in scopes.inherited(own, above, "v").collect()}
    assert found == {("A", "f()"): "x", ("B", "f()"): "y", ("C", "g()"): "z", ("C", "f()"): "y", ("D", "f()"): "x", ("E", "h()"): "1", ("F", "h()"): "2"}


CODE = {
    "a.cpp": """namespace a { class Base { public: void go(); Base* next(); }; class Node : public Base { public: Node* up; }; void f(Node* n) { n->go(); n->next()->go(); n->up->up->up->go(); n->lost->go(); } }
static void help(a::Node* x) { x->go(); }
""",
    "b.cpp": """namespace b { class Node { public: void go(); void note(); void all() { note(); this->go(); } }; using Alias = Node; void f(Alias* n) { n->go(); } }
static void help(b::Node* x) { x->go(); }
typedef Loop Knot; typedef Knot Loop;
void g(Loop* q) { q->go(); }
""",
}


def test_receivers_in_scopes(spark):
    facts = ingest.facts(spark.createDataFrame(sorted(CODE.items()), "path string, text string"), ingest.macro_map({})).checkpoint()
    found = {(r.path, r.subject, r.receiver): (r.full, r.holder) for r in receivers.receiver_types(facts).collect()}
    assert found[("a.cpp", "a::f", "n")] == ("a::Node", "a::Base")
    assert found[("a.cpp", "a::f", "n.next()")] == ("a::Base", "a::Base")
    assert found[("a.cpp", "a::f", "n.up.up.up")] == ("a::Node", "a::Base")
    assert found[("a.cpp", "a::f", "n.lost")] == (None, None)
    assert found[("a.cpp", "help", "x")] == ("a::Node", "a::Base")
    assert found[("b.cpp", "help", "x")] == ("b::Node", "b::Node")
    assert found[("b.cpp", "b::f", "n")] == ("b::Node", "b::Node")
    assert found[("b.cpp", "b::Node::all", "this")] == ("b::Node", "b::Node")
    assert found[("b.cpp", "g", "q")][1] is None
