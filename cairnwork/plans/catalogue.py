"""Every relational kernel as a query over whole tables, with the SQL that says the same.

The tables stand for facts: orders are edges from customers, documents are files, pages carry paths and names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, names
from ..operators import dataflow, graph, intervals, resolve, rules, search, tables, verdicts
from . import evidence

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, text: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")


# --- filters and lookups -------------------------------------------------------------------------


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE coalesce(json_extract_string(props, '$.k'), 'active') <> '13'")
def active_facts(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return tables.active(load(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k")), "k", inactive="13")


_HOSTS = "('example.com'), ('example.net'), ('tionsh.example.net'), ('org'), ('ample.org')"


@query(f"SELECT q, page_id FROM (VALUES {_HOSTS}) v(q), (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) p WHERE host = q OR ends_with(host, '.' || q)")
def name_match_suffix(spark, sf_dir):
    """Names that equal a query or end with it, by an equi-join on suffixes."""
    hosts = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return resolve.by_suffix(_values(spark, _HOSTS, "q"), "q", hosts, "host", sep=".").select("q", "page_id")


@query(f"SELECT q, count(*) AS n FROM (VALUES {_HOSTS}) v(q), (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) p WHERE host = q OR ends_with(host, '.' || q) OR ends_with(q, '.' || host) OR split_part(host, '.', -1) = split_part(q, '.', -1) GROUP BY q")
def name_match_bidir(spark, sf_dir):
    """Names that match in either direction or by last segment; names are grouped before they meet the queries."""
    hosts = load(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("c"))
    # The queries are five literals.
    return hosts.join(F.broadcast(_values(spark, _HOSTS, "q")), names.matches_either(F.col("host"), F.col("q"), ".")).groupBy("q").agg(F.sum("c").alias("n"))


_SEGMENTS = {"vendor": ["fr"], "generated": ["de"], "test": ["es", "tests"]}


@query("SELECT page_id, CASE WHEN list_has_any(s, ['fr']) THEN 'vendor' WHEN list_has_any(s, ['de']) THEN 'generated' WHEN list_has_any(s, ['es', 'tests']) THEN 'test' ELSE 'project' END AS role FROM (SELECT page_id, string_split(lower(url), '/') AS s FROM pages)")
def path_role(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", names.path_role(F.col("url"), _SEGMENTS).alias("role"))


@query("SELECT p_partkey, p_name, p_brand, CAST(row_number() OVER w - 1 AS BIGINT) AS position, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 60 THEN CAST(60 AS BIGINT) END AS next_offset FROM part WINDOW w AS (ORDER BY p_name, p_partkey) QUALIFY position BETWEEN 20 AND 59")
def find_defs_page(spark, sf_dir):
    """A page of 40 rows from offset 20."""
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return tables.page(rows, [F.col("p_name"), F.col("p_partkey")], limit=40, offset=20)


_EDGES = "(SELECT o_orderkey, 'shop::' || c_name AS caller, c_mktsegment || '::' || o_orderpriority AS callee, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)"


def _edges(spark, sf_dir) -> DataFrame:
    orders, customers = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat(F.lit("shop::"), "c_name").alias("caller"), F.concat("c_mktsegment", F.lit("::"), "o_orderpriority").alias("callee"), F.col("o_orderstatus").alias("status"))


@query(f"SELECT caller, count(*) AS n FROM {_EDGES} WHERE callee = '1-URGENT' OR ends_with(callee, '::1-URGENT') GROUP BY caller")
def find_callers(spark, sf_dir):
    return _edges(spark, sf_dir).filter(names.matches_name(F.col("callee"), F.lit("1-URGENT"))).groupBy("caller").agg(F.count(F.lit(1)).alias("n"))


_ASKED = "(SELECT o_orderkey, 'shop::c' || o_custkey AS caller, c_mktsegment || '::p' || o_orderpriority[1] AS callee FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F')"


def _call_facts(spark, sf_dir) -> DataFrame:
    """Orders as call facts: customers call priorities of their segment; finished ones are inactive."""
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.lit("call").alias("fact_type"), "o_orderkey", F.concat(F.lit("shop::c"), "o_custkey").alias("subject"), F.lit("calls").alias("predicate"),
        F.concat("c_mktsegment", F.lit("::p"), F.substring("o_orderpriority", 1, 1)).alias("object"), F.when(F.col("o_orderstatus") == "F", "inactive").otherwise("active").alias("build_status"),
    )


@query(f"SELECT o_orderkey, callee FROM {_ASKED} WHERE caller IN ('shop::c7', 'shop::c8')")
def find_callees(spark, sf_dir):
    """What two callers call, one of them named by its short name."""
    return evidence.collect(_call_facts(spark, sf_dir), "What does `shop::c7` call, and `c8`?").select("o_orderkey", F.col("object").alias("callee"))


@query(f"SELECT o_orderkey, caller, callee FROM {_ASKED} WHERE callee = 'BUILDING::p1' OR caller = 'shop::c11'")
def find_references(spark, sf_dir):
    """Active facts that name a symbol on either side."""
    return evidence.collect(_call_facts(spark, sf_dir), "Tell me about `BUILDING::p1` and `shop::c11`").select("o_orderkey", F.col("subject").alias("caller"), F.col("object").alias("callee"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'a') OR starts_with(p_name, 'part a') OR starts_with(p_name, 'b')")
def prefix_lookup(spark, sf_dir):
    name = F.col("p_name")
    return load(spark, sf_dir, "part").filter(name.startswith("a") | name.startswith("part a") | name.startswith("b")).select("p_partkey", "p_name")


# --- aggregates, reports -------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def diagnostics_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("all"))
    return rows.join(F.broadcast(total), F.lit(True)).select("event_type", "n", (F.col("n") / F.col("all")).alias("share"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def largest_files_top10(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count FROM documents")
def file_manifest(spark, sf_dir):
    return tables.manifest(load(spark, sf_dir, "documents"), "doc_id", "text")


_OLD = "SELECT doc_id, sha256(text) AS sha FROM documents WHERE lang <> 'de'"
_NEW = "SELECT doc_id, sha256(regexp_replace(text, ' {2,}|!!', ' ', 'g')) AS sha FROM documents WHERE lang <> 'es'"
_STATES = f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN o.doc_id IS NULL THEN 'new' WHEN o.sha IS DISTINCT FROM n.sha THEN 'stale' ELSE 'clean' END AS state FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.doc_id = n.doc_id"


def _states(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    old = docs.filter("lang <> 'de'").select("doc_id", F.sha2("text", 256).alias("sha"))
    new = docs.filter("lang <> 'es'").select("doc_id", F.sha2(F.regexp_replace("text", " {2,}|!!", " "), 256).alias("sha"))
    return tables.freshness(old, new, "doc_id", "sha")


@query(_STATES)
def freshness_diff(spark, sf_dir):
    """An index without German files against a tree without Spanish ones, in which shouting was toned down."""
    return _states(spark, sf_dir)


@query(f"SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM ({_STATES}) WHERE state = 'clean')")
def incremental_keep(spark, sf_dir):
    return tables.unchanged(load(spark, sf_dir, "labels").select("doc_id", "quality"), _states(spark, sf_dir), "doc_id")


@query("SELECT doc_id, CAST(i AS BIGINT) AS line_no, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def explode_lines(spark, sf_dir):
    return tables.lines(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT page_id, unnest(h) AS target, CAST(generate_subscripts(h, 1) AS BIGINT) AS place FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)")
def include_edges(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return load(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("n", "target")).select("page_id", "target", (F.col("n") + 1).cast("long").alias("place"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def include_resolution(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"))
    return docs.join(labels, F.col("doc_id") == F.col("l"), "left").select("doc_id", F.when(F.col("l").isNull(), "unresolved").otherwise("resolved").alias("resolution"))


@query("SELECT r_name || '/' || n_name AS tu, r_regionkey, n_nationkey, CASE WHEN r_name LIKE 'A%' THEN 'active' ELSE 'inactive' END AS build_status FROM nation JOIN region ON n_regionkey = r_regionkey")
def header_projection(spark, sf_dir):
    """Each header once for every unit that includes it."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("tu"), "r_regionkey", "n_nationkey", F.when(F.startswith("r_name", F.lit("A")), "active").otherwise("inactive").alias("build_status"))


@query("""
WITH v AS (SELECT c_nationkey AS k, 1 AS priority, max(c_acctbal) AS value FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 2, max(s_acctbal) FROM supplier GROUP BY 1)
SELECT k, arg_max(value, priority) AS value, string_agg(CAST(priority AS VARCHAR), ',' ORDER BY priority) AS origins FROM v GROUP BY k""")
def macro_precedence(spark, sf_dir):
    a = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("value")).withColumn("priority", F.lit(1))
    b = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("value")).withColumn("priority", F.lit(2))
    return resolve.last_wins(a.unionByName(b), "k", "value", "priority")


# --- three-valued logic and guards ---------------------------------------------------------------

_GUARDS = [
    ("ifdef", "A", "active", "macro_known"), ("ifdef", "NOPE", "conditional", "macro_unknown"), ("ifndef", "A", "inactive", "macro_known"), ("ifndef", "NOPE", "conditional", "macro_unknown"),
    ("if", "1", "active", "evaluated"), ("if", "0", "inactive", "evaluated"), ("if", "A == 1", "active", "evaluated"), ("if", "N > 2 && N < 8", "active", "evaluated"),
    ("if", "defined(A) && !defined(B)", "conditional", "evaluation_unknown"), ("if", "0 && NOPE", "inactive", "evaluated"), ("if", "1 || NOPE", "active", "evaluated"), ("if", "NOPE", "conditional", "evaluation_unknown"),
    ("if", "-7 / 2 == -3", "active", "evaluated"), ("if", "-7 % 3 == -1", "active", "evaluated"), ("if", "(N << 2) | 1", "active", "evaluated"), ("if", "N ^ 5", "inactive", "evaluated"),
    ("if", "1 / 0", "conditional", "division_by_zero"), ("if", "1 << -1", "conditional", "negative_shift"), ("if", "LOOP", "conditional", "macro_alias_cycle"), ("if", "ALIAS == 5", "active", "evaluated"),
    ("if", "f(1)", "conditional", "function_like_macro"), ("if", "A ? 1 : 0", "conditional", "ternary"), ("if", "1 < 2 < 3", "conditional", "expression_syntax"), ("if", "010", "conditional", "expression_syntax"),
    ("if", "0x1Fu == 31", "active", "evaluated"), ("if", "~0 == -1", "active", "evaluated"), ("if", "EMPTY", "active", "evaluated"), ("if", "(", "conditional", "expression_syntax"),
]
_GUARD_ROWS = ", ".join(f"('{d}', '{e}', '{s}', '{r}')" for d, e, s, r in _GUARDS)


@query(f"SELECT directive, expression, status, reason FROM (VALUES {_GUARD_ROWS}) t(directive, expression, status, reason)")
def guard_truth_table(spark, sf_dir):
    rows = _values(spark, ", ".join(f"('{d}', '{e}')" for d, e, _, _ in _GUARDS), "directive, expression")
    macros = F.expr("map('A', '1', 'N', '5', 'ALIAS', 'N', 'EMPTY', '', 'LOOP', 'POOL', 'POOL', 'LOOP')")
    return rows.select("directive", "expression", guards.eval_guard(F.col("directive"), F.col("expression"), macros).alias("g")).select("directive", "expression", "g.status", "g.reason")


_TRI = "(CAST(true AS BOOLEAN)), (false), (NULL)"


@query(f"SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS neither FROM (VALUES {_TRI}) x(a), (VALUES {_TRI}) y(b)")
def kleene_tables(spark, sf_dir):
    a, b = _values(spark, _TRI, "a"), _values(spark, _TRI, "b")
    return a.join(b, F.lit(True)).select("a", "b", (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (~F.col("a")).alias("neither"))


@query("SELECT a, b, CASE WHEN b = 0 THEN NULL ELSE CAST(trunc(a / b) AS BIGINT) END AS q, CASE WHEN b = 0 THEN NULL ELSE CAST(a % b AS BIGINT) END AS r, CAST(a & b AS BIGINT) AS band, CAST(a | b AS BIGINT) AS bor, CAST(xor(a, b) AS BIGINT) AS bxor FROM (SELECT l_linenumber - 4 AS a, CAST(l_quantity AS INT) - 25 AS b FROM (SELECT DISTINCT l_linenumber, l_quantity FROM lineitem))")
def guard_arithmetic(spark, sf_dir):
    """C's truncating division and the bit operators; a zero divisor is unknown."""
    pairs = load(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity").distinct().select((F.col("l_linenumber") - 4).alias("a"), (F.col("l_quantity").cast("int") - 25).alias("b"))
    a, b = F.col("a"), F.col("b")
    safe = F.when(b != 0, b)
    return pairs.select("a", "b", F.expr("a div nullif(b, 0)").cast("long").alias("q"), (a % safe).cast("long").alias("r"), a.bitwiseAND(b).cast("long").alias("band"), a.bitwiseOR(b).cast("long").alias("bor"), a.bitwiseXOR(b).cast("long").alias("bxor"))


_RANKED = "CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END"


@query(f"SELECT user_id, CASE max({_RANKED}) WHEN 2 THEN 'inactive' WHEN 1 THEN 'conditional' ELSE 'active' END AS status FROM events GROUP BY user_id")
def target_status(spark, sf_dir):
    """Status of a target from all its facts."""
    rank = F.max(F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 1).otherwise(0))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(rank.alias("r")).select("user_id", F.when(F.col("r") == 2, "inactive").when(F.col("r") == 1, "conditional").otherwise("active").alias("status"))


# --- lines, spans, windows -----------------------------------------------------------------------


@query("""
WITH t AS (SELECT page_id, unnest(m) AS tag, generate_subscripts(m, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '</?(?:ul|li|p|div|article)[ >]') AS m FROM pages)),
d AS (SELECT page_id, i, sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t)
SELECT page_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(arg_max(depth, i) AS BIGINT) AS unclosed, count(*) AS tags FROM d GROUP BY page_id""")
def brace_depth(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit("</?(?:ul|li|p|div|article)[ >]"), F.lit(0))
    tags = load(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("i", "tag")).withColumn("delta", F.when(F.startswith("tag", F.lit("</")), -1).otherwise(1))
    return intervals.depth(tags, ["page_id"], "i", "delta").groupBy("page_id").agg(F.max("depth").cast("long").alias("deepest"), F.max_by("depth", "i").cast("long").alias("unclosed"), F.count(F.lit(1)).alias("tags"))


@query("""
WITH m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j FROM events)
SELECT user_id, event_type, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last, count(*) AS length FROM m GROUP BY user_id, event_type, i - j""")
def inactive_regions(spark, sf_dir):
    """Runs of neighbouring events of one type."""
    return intervals.runs(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(f"""
SELECT o_orderkey, count(event_id) AS facts, CASE max({_RANKED}) FILTER (event_id IS NOT NULL) WHEN 2 THEN 'inactive' WHEN 1 THEN 'conditional' ELSE 'active' END AS status
FROM orders LEFT JOIN events ON o_custkey = user_id AND ts BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey""")
def span_status(spark, sf_dir):
    """Status of a span from the facts in it."""
    spans = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("begin"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("end"))
    met = intervals.overlapping(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), spans, ["user_id"], "ts", "begin", "end", "left")
    rank = F.max(F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 1).when(F.col("event_id").isNotNull(), 0))
    return met.groupBy("o_orderkey").agg(F.count("event_id").alias("facts"), rank.alias("r")).select("o_orderkey", "facts", F.when(F.col("r") == 2, "inactive").when(F.col("r") == 1, "conditional").otherwise("active").alias("status"))


@query("""
WITH p AS (SELECT o_custkey, l_shipdate, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
m AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT p.o_custkey, p.l_shipdate, p.n, m.o_orderkey AS enclosing FROM p ASOF LEFT JOIN m ON p.o_custkey = m.o_custkey AND p.l_shipdate >= m.o_orderdate""")
def enclosing_symbol(spark, sf_dir):
    """The last start at or before each line."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("at")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "at").agg(F.count(F.lit(1)).alias("n"))
    marks = orders.select("o_custkey", F.col("o_orderdate").alias("at"), "o_orderkey")
    return intervals.as_of(lines, marks, ["o_custkey"], "at", "o_orderkey", "enclosing").select("o_custkey", F.col("at").alias("l_shipdate"), "n", "enclosing")


@query("SELECT doc_id, source, min(doc_id) OVER (PARTITION BY sha256(text)) = doc_id AS kept FROM documents QUALIFY kept")
def ordered_dedupe(spark, sf_dir):
    """The first row of equal texts."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return tables.first_of(docs, ["sha"], [F.col("doc_id")]).select("doc_id", "source", F.lit(True).alias("kept"))


@query("SELECT conv_id, turn, role, lag(turn) OVER w AS before, lead(turn) OVER w AS after, lag(role) OVER w AS role_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def adjacent_chunks(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("turn").over(w).alias("before"), F.lead("turn").over(w).alias("after"), F.lag("role").over(w).alias("role_before"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER w - 1 AS BIGINT) AS position, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 100 THEN CAST(100 AS BIGINT) END AS next_offset FROM conversations WINDOW w AS (ORDER BY conv_id DESC, turn DESC) QUALIFY position < 100")
def history_page(spark, sf_dir):
    """The newest entries first, one page."""
    return tables.page(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), [F.desc("conv_id"), F.desc("turn")])


# --- resolution ----------------------------------------------------------------------------------


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), m AS (SELECT sha, max(doc_id) AS definition FROM h GROUP BY sha)
SELECT doc_id, definition FROM h JOIN m USING (sha) WHERE definition <> doc_id""")
def decl_def_binding(spark, sf_dir):
    """Each declaration with the last definition of equal text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return resolve.bind_to_definition(docs, ["sha"], "doc_id", "doc_id").select("doc_id", "definition")


@query("""
WITH x AS (SELECT source, quality, doc_id FROM labels JOIN documents USING (doc_id)), s AS (SELECT source, min(doc_id) AS strong FROM x WHERE quality = 1 GROUP BY 1)
SELECT x.source, x.doc_id AS weak, s.strong FROM x JOIN s ON x.source = s.source WHERE quality = 0 AND x.doc_id <> s.strong""")
def weak_strong_override(spark, sf_dir):
    """Weak defaults with the implementation that overrides them."""
    rows = load(spark, sf_dir, "labels").select("doc_id", "quality").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return resolve.strong_for(rows.withColumn("weak", F.col("quality") == 0), "source", "weak", "doc_id").select("source", F.col("doc_id").alias("weak"), "strong")


@query("""
WITH a AS (SELECT *, p_size >= 25 AS f FROM part), b AS (SELECT *, max(f) OVER (PARTITION BY p_brand) AS any_f FROM a), c AS (SELECT * FROM b WHERE f = any_f),
d AS (SELECT *, p_retailprice > 1500 AS g FROM c), e AS (SELECT *, max(g) OVER (PARTITION BY p_brand) AS any_g FROM d), k AS (SELECT * FROM e WHERE g = any_g)
SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS resolved, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS candidates, CASE WHEN count(DISTINCT p_type) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM k GROUP BY p_brand""")
def overload_narrowing(spark, sf_dir):
    """Candidates narrowed step by step, each step only where it leaves some."""
    rows = load(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_retailprice")
    return resolve.resolution(resolve.narrow(rows, ["p_brand"], [F.col("p_size") >= 25, F.col("p_retailprice") > 1500]), ["p_brand"], "p_type")


@query("SELECT p_brand || '/' || p_size AS name, min(p_type) AS p_type FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1")
def unique_alias(spark, sf_dir):
    named = load(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("name"), "p_type")
    return resolve.unique_aliases(named, "name", "p_type").select("name", "p_type")


_ALIASES = "('a', 'b'), ('b', 'c'), ('c', 'int'), ('d', 'e'), ('e', 'd'), ('f', 'd'), ('g', 'long'), ('self', 'self')"


@query("SELECT * FROM (VALUES ('a', 'int'), ('b', 'int'), ('c', 'int'), ('d', NULL), ('e', NULL), ('f', NULL), ('g', 'long'), ('self', NULL)) t(name, final)")
def alias_chain(spark, sf_dir):
    return graph.alias_closure(_values(spark, _ALIASES, "name, target"), "name", "target")


@query("""
WITH r AS (SELECT o_orderpriority AS path, o_orderstatus AS fn, c_mktsegment AS callback, min(o_orderkey) AS register_line FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT o_orderpriority AS path, o_orderstatus AS fn, l_returnflag AS field, min(l_orderkey) AS store_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 7 GROUP BY ALL),
i AS (SELECT o_orderpriority AS path, l_returnflag AS field, l_linestatus AS invoker, min(l_orderkey) AS invoke_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT path, callback, field, invoker, register_line, store_line, invoke_line FROM r JOIN s USING (path, fn) JOIN i USING (path, field)""")
def callback_dataflow(spark, sf_dir):
    """Callbacks (segments) handed to functions (statuses), stored in fields (flags), invoked; a priority is a file."""
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    registered = orders.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("line"), F.concat(F.lit("lib::"), "o_orderstatus").alias("api"), F.col("c_mktsegment").alias("callback"))
    used = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("path"), F.col("l_orderkey").alias("line"), "o_orderstatus", "l_linestatus", F.col("l_returnflag").alias("field"), "l_linenumber")
    return dataflow.dataflow(registered, used.filter("l_linenumber = 7").withColumn("function", F.col("o_orderstatus")), used.withColumn("function", F.col("l_linestatus")))


@query("SELECT r_name, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def receiver_chain(spark, sf_dir):
    """A chain of steps, each a join; orders are counted by customer before the chain is walked."""
    counted = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"))
    walked = counted.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return walked.groupBy("r_name", "n_name").agg(F.sum("c").alias("n"))


@query("SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN CAST(min(l_suppkey) AS VARCHAR) END AS resolved, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS candidates, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM lineitem GROUP BY l_partkey")
def candidate_set(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("s"))
    return resolve.resolution(rows, ["l_partkey"], "s")


# --- graphs --------------------------------------------------------------------------------------

_CALLS = "('main', 'start'), ('main', 'parse'), ('start', 'init'), ('init', 'alloc'), ('parse', 'alloc'), ('alloc', 'panic'), ('loop', 'poll'), ('poll', 'loop'), ('poll', 'alloc'), ('island', 'island')"
_REACH = f"""
WITH RECURSIVE e(src, dst) AS (VALUES {_CALLS}), s AS (SELECT DISTINCT src AS start FROM e),
r(start, node, hops, path) AS (SELECT start, start, 0, [start] FROM s UNION ALL SELECT r.start, e.dst, r.hops + 1, list_append(r.path, e.dst) FROM r JOIN e ON r.node = e.src WHERE NOT list_contains(r.path, e.dst))
"""


@query(_REACH + "SELECT start, node, min(hops) AS hops FROM r GROUP BY 1, 2")
def reach_closure(spark, sf_dir):
    edges = _values(spark, _CALLS, "src, dst")
    return graph.reach(edges, edges.select(F.col("src").alias("start"))).select("start", "node", "hops")


@query(_REACH + "SELECT start, node AS goal, hops, array_to_string(path, ' > ') AS route FROM r WHERE start IN ('main', 'loop') AND node IN ('panic', 'poll') AND path = (SELECT min(q.path) FROM r q WHERE q.start = r.start AND q.node = r.node AND q.hops = (SELECT min(z.hops) FROM r z WHERE z.start = r.start AND z.node = r.node))")
def shortest_path(spark, sf_dir):
    edges = _values(spark, _CALLS, "src, dst")
    reached = graph.reach(edges, _values(spark, "('main'), ('loop')", "start"))
    goals = spark.sql("SELECT * FROM VALUES ('main', 'panic'), ('loop', 'panic'), ('loop', 'poll'), ('main', 'island') AS t(`from`, goal)")
    return graph.routes(reached, goals)


@query("""
WITH RECURSIVE e AS (SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations),
r(conv_id, node, hops) AS (SELECT conv_id, min(turn), 0 FROM conversations GROUP BY conv_id UNION ALL SELECT r.conv_id, e.dst, r.hops + 1 FROM r JOIN e ON r.conv_id = e.conv_id AND r.node = e.src WHERE e.dst IS NOT NULL)
SELECT conv_id, node AS turn, hops FROM r""")
def turn_reach(spark, sf_dir):
    """Reachability over all conversations at once: nodes are (conversation, turn)."""
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    node = lambda t: F.concat_ws("/", "conv_id", t)
    edges = rows.withColumn("next", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null").select(node("turn").alias("src"), node("next").alias("dst"))
    starts = rows.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(node("turn").alias("start"))
    part = lambda i: F.split_part("node", F.lit("/"), F.lit(i)).cast("long")
    return graph.reach(edges, starts).select(part(1).alias("conv_id"), part(2).alias("turn"), "hops")


@query("""
WITH e AS (SELECT c_nationkey AS src, o_orderpriority AS dst, 1.0 AS w FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT s_nationkey, l_returnflag, 0.7 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS weight FROM e GROUP BY 1, 2)
SELECT src, dst, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY src ORDER BY round(weight, 6) DESC, dst) AS INT) AS rank FROM g QUALIFY rank <= 3""")
def weighted_graph(spark, sf_dir):
    """The three heaviest neighbours of each node; both kinds of edges are summed before they meet."""
    a = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("src"), F.col("o_orderpriority").alias("dst")).agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("n") * F.lit(1.0))
    b = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("src"), F.col("l_returnflag").alias("dst")).agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("n") * F.lit(0.7))
    edges = a.unionByName(b).groupBy("src", "dst").agg(F.round(F.sum("w"), 6).alias("weight"))
    return search.neighbours(edges, "src", [F.desc("weight"), F.col("dst")], 3).select("src", "dst", "weight", "rank")


# --- verdicts ------------------------------------------------------------------------------------

_CLAIMS = """(
WITH c AS (SELECT c_custkey, c_nationkey, s AS wanted FROM customer, (VALUES ('F'), ('O'), ('P')) v(s)),
e AS (SELECT o_custkey, o_orderstatus, CAST(max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS INT) AS u FROM orders GROUP BY 1, 2),
a AS (SELECT o_custkey, max(u) AS u FROM e GROUP BY 1)
SELECT c.c_custkey, c.c_nationkey, c.wanted, CASE WHEN e.u = 0 THEN 'supported' WHEN e.u = 1 THEN 'conditional' WHEN a.u = 0 THEN 'contradicted' ELSE 'unknown' END AS verdict,
CASE WHEN e.u = 0 THEN 'edge_supported' WHEN e.u = 1 THEN 'edge_conditional_or_candidate' WHEN a.u = 0 THEN 'settled_evidence_does_not_include_target' WHEN a.u = 1 THEN 'unsettled_evidence' ELSE 'no_evidence' END AS reason
FROM c LEFT JOIN e ON c.c_custkey = e.o_custkey AND c.wanted = e.o_orderstatus LEFT JOIN a ON c.c_custkey = a.o_custkey)"""


def _judged(spark, sf_dir) -> DataFrame:
    claims = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.explode(F.array(*map(F.lit, "FOP"))).alias("wanted"))
    edges = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    return verdicts.judge(claims, edges, ["c_custkey"], "o_orderstatus", "wanted", F.col("o_orderpriority") == "5-LOW")


@query(f"SELECT * FROM {_CLAIMS}")
def claim_verdicts(spark, sf_dir):
    """Claims that a customer has an order of a status; low-priority orders are unsettled evidence."""
    return _judged(spark, sf_dir)


@query(f"SELECT c_custkey, wanted, CASE verdict WHEN 'supported' THEN 'contradicted' WHEN 'contradicted' THEN 'supported' ELSE verdict END AS verdict FROM {_CLAIMS}")
def claim_negation(spark, sf_dir):
    return _judged(spark, sf_dir).select("c_custkey", "wanted", verdicts.negate(F.col("verdict")).alias("verdict"))


@query(f"SELECT c_custkey, wanted, CASE WHEN c_acctbal >= 0 THEN verdict WHEN verdict = 'contradicted' THEN 'unknown' WHEN verdict = 'supported' THEN 'conditional' ELSE verdict END AS verdict FROM {_CLAIMS} JOIN (SELECT c_custkey, c_acctbal FROM customer) USING (c_custkey)")
def freshness_downgrade(spark, sf_dir):
    balance = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return _judged(spark, sf_dir).join(balance, "c_custkey").select("c_custkey", "wanted", verdicts.stale(F.col("verdict"), F.col("c_acctbal") >= 0).alias("verdict"))


@query(f"SELECT c_custkey, wanted, CASE WHEN verdict = 'supported' AND c_acctbal < 1000 THEN 'conditional' WHEN verdict = 'contradicted' AND c_acctbal < 5000 THEN 'unknown' ELSE verdict END AS verdict FROM {_CLAIMS} JOIN (SELECT c_custkey, c_acctbal FROM customer) USING (c_custkey)")
def quality_gate(spark, sf_dir):
    balance = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    level = F.when(F.col("c_acctbal") < 1000, "weak").otherwise("strong")
    return _judged(spark, sf_dir).join(balance, "c_custkey").select("c_custkey", "wanted", verdicts.gate(F.col("verdict"), level, F.col("c_acctbal") >= 5000).alias("verdict"))


_OVERALL = "CASE min(CASE verdict WHEN 'contradicted' THEN 0 WHEN 'unknown' THEN 1 WHEN 'conditional' THEN 2 ELSE 3 END) WHEN 0 THEN 'contradicted' WHEN 1 THEN 'unknown' WHEN 2 THEN 'conditional' ELSE 'supported' END"
_SAFE = "CASE overall WHEN 'contradicted' THEN 'unsafe' WHEN 'unknown' THEN 'needs_more_evidence' WHEN 'conditional' THEN 'must_qualify' ELSE 'safe' END"


@query(f"SELECT c_custkey, overall, {_SAFE} AS safety FROM (SELECT c_custkey, {_OVERALL} AS overall FROM {_CLAIMS} GROUP BY c_custkey)")
def overall_verdict(spark, sf_dir):
    rolled = _judged(spark, sf_dir).groupBy("c_custkey").agg(verdicts.overall(F.col("verdict")).alias("overall"))
    return rolled.withColumn("safety", verdicts.safety(F.col("overall")))


@query("""
SELECT s_nationkey, CASE min(CASE WHEN s_acctbal < 0 THEN 1 WHEN s_acctbal < 5000 THEN 2 ELSE 3 END) WHEN 1 THEN 'weak' WHEN 2 THEN 'medium' ELSE 'strong' END AS level FROM supplier GROUP BY s_nationkey""")
def worst_support(spark, sf_dir):
    level = F.when(F.col("s_acctbal") < 0, "weak").when(F.col("s_acctbal") < 5000, "medium").otherwise("strong")
    return load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(verdicts.worst_support(level).alias("level"))


@query("""
WITH f AS (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ', ' ORDER BY i) AS values FROM f GROUP BY user_id""".replace("AS values", 'AS "values"'))
def unknown_rollup(spark, sf_dir):
    return verdicts.distinct_in_order(load(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT c_nationkey, string_agg(c_custkey || ':' || wanted, ',' ORDER BY c_custkey, wanted) FILTER (verdict = 'supported') AS allowed, count(*) FILTER (verdict = 'conditional') AS qualified, count(*) FILTER (verdict = 'unknown') AS open, count(*) FILTER (verdict = 'contradicted') AS prohibited FROM " + _CLAIMS + " GROUP BY c_nationkey")
def answer_contract(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    item = F.when(F.col("verdict") == "supported", F.struct("c_custkey", "wanted"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.concat_ws(":", s["c_custkey"], s["wanted"])), ",")
    return rows.groupBy("c_nationkey").agg(F.nullif(listed, F.lit("")).alias("allowed"), *(F.count_if(F.col("verdict") == v).alias(n) for v, n in (("conditional", "qualified"), ("unknown", "open"), ("contradicted", "prohibited"))))


# --- wording, rules, claims ----------------------------------------------------------------------


@query("SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9_])(always|never|definitely|certainly|guaranteed|all|none)(?:$|[^A-Za-z0-9_])')) AS BIGINT) AS absolute, CAST(len(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9_])(i (?:think|guess|assume))(?:$|[^A-Za-z0-9_])')) AS BIGINT) AS speculative FROM conversations")
def policy_terms(spark, sf_dir):
    return rules.wording(load(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


_EVENT_RULES = "('error', 'reports_error', 'high'), ('purchase', 'changes_state', 'medium'), ('signup', 'changes_state', 'low')"


@query(f"SELECT event_id, predicate, severity FROM events JOIN (VALUES {_EVENT_RULES}) r(api, predicate, severity) ON event_type = api")
def rule_pack_join(spark, sf_dir):
    return rules.apply_rules(load(spark, sf_dir, "events"), _values(spark, _EVENT_RULES, "api, predicate, severity"), "event_type").select("event_id", "predicate", "severity")


_PROSE = ["start calls init and alloc.", "We saw that main() calls start, and main reaches panic", "src/a.c includes inc/a.h", "ns::run is defined in b.c", "nothing here", "poll calls loop. poll calls alloc"]


@query("SELECT * FROM (VALUES (0, 'calls', 'start', 'init'), (0, 'calls', 'start', 'alloc'), (1, 'calls', 'main', 'start'), (1, 'reaches', 'main', 'panic'), (2, 'includes', 'src/a.c', 'inc/a.h'), (3, 'definition_exists', 'ns::run', ''), (5, 'calls', 'poll', 'loop'), (5, 'calls', 'poll', 'alloc')) t(text_id, claim_type, subject, object)")
def claim_extract(spark, sf_dir):
    texts = _values(spark, ", ".join(f"({i}, '{t}')" for i, t in enumerate(_PROSE)), "text_id, body")
    return rules.claims_of(texts, "text_id", "body").select("text_id", "claim_type", "subject", "object")


# --- profiles, coverage, evaluation --------------------------------------------------------------


@query("SELECT o_orderstatus AS target, " + ", ".join(f"CAST(count(*) FILTER (o_orderpriority = '{p}') AS BIGINT) AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")) + ", max(o_totalprice) - min(o_totalprice) > 400000 AS changed FROM orders GROUP BY 1")
def profile_matrix(spark, sf_dir):
    """Targets by profile, and whether the profiles differ."""
    rows = load(spark, sf_dir, "orders")
    cells = [F.count_if(F.col("o_orderpriority") == p).alias(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")]
    return rows.groupBy(F.col("o_orderstatus").alias("target")).agg(*cells, (F.max("o_totalprice") - F.min("o_totalprice") > 400000).alias("changed"))


_SIDE = "SELECT c_nationkey AS name, count(*) AS value FROM customer WHERE c_mktsegment = '{}' AND c_acctbal > 2000 GROUP BY 1"


@query(f"SELECT coalesce(a.name, b.name) AS name, a.value AS a_value, b.value AS b_value, a.value IS DISTINCT FROM b.value AS differs FROM ({_SIDE.format('BUILDING')}) a FULL JOIN ({_SIDE.format('MACHINERY')}) b ON a.name = b.name")
def macro_diff(spark, sf_dir):
    """Settings of two profiles side by side; absent is not equal to any value."""
    rows = load(spark, sf_dir, "customer").filter("c_acctbal > 2000").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("v"))
    a = rows.filter("c_mktsegment = 'BUILDING'").select("c_nationkey", F.col("v").alias("a_value"))
    b = rows.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").alias("k"), F.col("v").alias("b_value"))
    return a.join(b, F.col("c_nationkey") == F.col("k"), "full_outer").select(F.coalesce("c_nationkey", "k").alias("name"), "a_value", "b_value", (~F.col("a_value").eqNullSafe(F.col("b_value"))).alias("differs"))


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL AND n_chars < 500 THEN 'not_tracked' WHEN l.doc_id IS NULL THEN 'upstream_missing' WHEN quality = 0 AND toxic = 1 THEN 'unknown'
WHEN quality = 0 THEN 'compact_only' WHEN n_chars < 1000 THEN 'partially_supported' ELSE 'verified' END AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coverage_status(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "n_chars"), load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l")
    status = (
        F.when(F.col("l").isNull() & (F.col("n_chars") < 500), "not_tracked").when(F.col("l").isNull(), "upstream_missing").when((F.col("quality") == 0) & (F.col("toxic") == 1), "unknown")
        .when(F.col("quality") == 0, "compact_only").when(F.col("n_chars") < 1000, "partially_supported").otherwise("verified")
    )
    return docs.join(labels, F.col("doc_id") == F.col("l"), "left").select("doc_id", status.alias("coverage"))


@query("SELECT token, CAST(count(*) * length(token) AS BIGINT) AS score FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) WHERE length(token) >= 4 GROUP BY token ORDER BY score DESC, token LIMIT 40")
def anchor_tokens(spark, sf_dir):
    return search.top_tokens(load(spark, sf_dir, "documents"), "doc_id", "text")


_EXPECTED = "('r1', 'AFRICA', true), ('r2', 'ASIA', true), ('r3', 'ATLANTIS', true), ('r4', 'EUROPE', false), ('r5', 'MU', false)"


@query(f"SELECT id, name, wanted, (name IN (SELECT r_name FROM region)) = wanted AS passed FROM (VALUES {_EXPECTED}) t(id, name, wanted)")
def eval_must_include(spark, sf_dir):
    """Expectations that a fact is there, or is not."""
    facts = load(spark, sf_dir, "region").select("r_name").distinct()
    expected = _values(spark, _EXPECTED, "id, name, wanted")
    return expected.join(facts, F.col("name") == F.col("r_name"), "left").select("id", "name", "wanted", (F.col("r_name").isNotNull() == F.col("wanted")).alias("passed"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), n AS (SELECT doc_id, len(w) AS n, w FROM w), s AS (SELECT count(*) AS docs, avg(n) AS a FROM n),
t AS (SELECT doc_id, n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM n, (VALUES ('worthless'), ('license'), ('public')) v(term)), h AS (SELECT * FROM t WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a))), 6) AS score FROM h JOIN d USING (term), s GROUP BY doc_id""")
def bm25_search(spark, sf_dir):
    return search.bm25(load(spark, sf_dir, "documents"), "doc_id", "text", ["worthless", "license", "public"])


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AND b.k IS NULL AS removed, a.k IS NULL AS added FROM (SELECT DISTINCT c_nationkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k")
def set_difference(spark, sf_dir):
    a, b = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct(), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k2")).distinct()
    return a.join(b, F.col("k") == F.col("k2"), "full_outer").select(F.coalesce("k", "k2").alias("k"), (F.col("k").isNotNull() & F.col("k2").isNull()).alias("removed"), F.col("k").isNull().alias("added"))


@query("SELECT c_nationkey, 'cust' AS origin, sum(c_acctbal) > 0 AS positive, count(*) AS n FROM customer WHERE c_nationkey NOT IN (3, 5) GROUP BY 1 UNION ALL SELECT s_nationkey, 'supp', sum(s_acctbal) > 0, count(*) FROM supplier GROUP BY 1")
def keyed_upsert(spark, sf_dir):
    """A table of which the rows of two keys were deleted, with another's rows added."""
    a = load(spark, sf_dir, "customer").filter(~F.col("c_nationkey").isin(3, 5)).groupBy("c_nationkey").agg((F.sum("c_acctbal") > 0).alias("positive"), F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("cust"))
    b = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg((F.sum("s_acctbal") > 0).alias("positive"), F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("supp"))
    return tables.upsert(a, b, ["c_nationkey", "origin"]).select("c_nationkey", "origin", "positive", "n")


# --- traces, expectations, targets ---------------------------------------------------------------

_STEPS = "('t', 'view', 1), ('t', 'click', 2), ('t', 'purchase', 3), ('u', 'signup', 1), ('u', 'error', 2)"


@query(f"""
WITH s(trace, predicate, step) AS (VALUES {_STEPS}), m AS (SELECT user_id, trace, step, predicate, arg_min(event_id, event_id) AS o FROM s JOIN events ON event_type = predicate GROUP BY ALL)
SELECT trace, CAST(user_id AS VARCHAR) AS subject, CAST(user_id AS VARCHAR) || ' > ' || string_agg('e' || o, ' > ' ORDER BY step) AS route, string_agg(predicate, ',' ORDER BY step) AS steps FROM m GROUP BY trace, user_id""")
def step_traces(spark, sf_dir):
    """For every user, the first event of each step."""
    from ..operators import traces

    events = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.lit("any").alias("operation"), F.concat(F.lit("e"), "event_id").alias("object"), F.col("event_id").alias("seq"))
    # The steps are five literals: each user gets them.
    steps = events.select("subject").distinct().join(F.broadcast(_values(spark, _STEPS, "trace, predicate, step")), F.lit(True)).select("trace", "subject", "step", "predicate", F.lit(None).cast("string").alias("operation"))
    return traces.step_trace(steps, events)


_PATTERNS = "('c1', 1, true, 'c_mktsegment', 'BUILDING'), ('c1', 1, true, 'c_nationkey', '7'), ('c1', 2, false, 'c_mktsegment', 'NOTHING'), ('c2', 1, true, 'c_nationkey', '99'), ('c2', 2, false, 'c_mktsegment', 'MACHINERY'), ('c2', 2, false, 'c_nationkey', '3')"


@query(f"""
WITH p(case_id, pattern_id, must, field, value) AS (VALUES {_PATTERNS}),
f AS (SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer),
m AS (SELECT case_id, pattern_id, c_custkey, count(*) AS n FROM p JOIN f USING (field, value) GROUP BY ALL), b AS (SELECT case_id, pattern_id, max(n) AS n FROM m GROUP BY ALL),
w AS (SELECT case_id, pattern_id, must, count(*) AS c FROM p GROUP BY ALL)
SELECT case_id, pattern_id, must, (coalesce(n, 0) = c) = must AS passed FROM w LEFT JOIN b USING (case_id, pattern_id)""")
def eval_patterns(spark, sf_dir):
    from ..operators import traces

    facts = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return traces.expectations(_values(spark, _PATTERNS, "case_id, pattern_id, must, field, value"), facts, "c_custkey")


_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/', '')"


@query(f"""
SELECT page_id, CASE WHEN p = 'fr' OR starts_with(p, 'fr/') THEN 'inactive' WHEN NOT (p = 'en' OR starts_with(p, 'en/') OR p = 'es' OR starts_with(p, 'es/') OR p = 'fr' OR starts_with(p, 'fr/')) THEN 'inactive' ELSE 'active' END AS status,
CASE WHEN p = 'fr' OR starts_with(p, 'fr/') THEN 'inactive_path_prefix' WHEN NOT (p = 'en' OR starts_with(p, 'en/') OR p = 'es' OR starts_with(p, 'es/') OR p = 'fr' OR starts_with(p, 'fr/')) THEN 'not_in_active_path_prefixes' ELSE 'active_path_prefix' END AS reason
FROM (SELECT page_id, regexp_replace({_PATH}, '^/+|/+$', '', 'g') AS p FROM pages)""")
def target_selection(spark, sf_dir):
    from ..operators import target

    files = load(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*/", "").alias("path"))
    return target.decide(files, target.Profile(active_prefixes=["en", "es", "fr"], inactive_prefixes=["fr/"])).select("page_id", "status", "reason")


# --- unknowns, statuses --------------------------------------------------------------------------


@query("""
WITH t AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'unresolved_call' WHEN 'view' THEN 'conditional_build' END AS unknown_type, props AS label, min(event_id) AS pos, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, unknown_type ORDER BY pos, label) AS i FROM t)
SELECT user_id, unknown_type, CAST(sum(n) AS BIGINT) AS n, string_agg(label, ', ' ORDER BY pos, label) FILTER (i <= 20) AS affects, CASE unknown_type WHEN 'unresolved_call' THEN 'The call''s target is not known.' ELSE 'Qualify this by the build configuration.' END AS "constraint" FROM r GROUP BY user_id, unknown_type""")
def unknowns_by_type(spark, sf_dir):
    from ..operators import unknowns

    kinds = [("unresolved_call", F.col("event_type") == "error"), ("conditional_build", F.col("event_type") == "view")]
    return unknowns.unknowns(load(spark, sf_dir, "events"), kinds, unknowns.label(F.col("props")), F.col("event_id"), ["user_id"])


@query("SELECT c_nationkey, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) ELSE 'mixed' END AS build, CASE WHEN count(*) FILTER (c_acctbal < -900) = 0 THEN 'not_tracked' ELSE 'low' END AS semantic FROM customer GROUP BY 1")
def status_rollup(spark, sf_dir):
    from ..operators import unknowns

    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(unknowns.rollup(F.col("c_mktsegment")).alias("build"), unknowns.rollup(F.when(F.col("c_acctbal") < -900, "low")).alias("semantic"))
