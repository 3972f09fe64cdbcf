"""Queries over C++ that is written from the driver tables, so that SQL can work out its facts from the same tables.

Each customer is a source file: a class in two namespaces that derives from its market segment's, with a field, methods,
and a line for each order, behind a condition that its status tells; and a function outside the inner namespace whose
head spans lines. Each market segment is a header.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import receivers, tables, target
from ..sources.store import FactStore
from ..streaming import incremental
from . import callbacks, claims, evidence, headers, ingest, questions, workflow

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of all files."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    line = F.concat(F.lit("    settle_"), "o_orderkey", F.lit("(day);\n"))
    guarded = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("#if 0 // gone(\n"), line, F.lit("#endif\n"))).when(F.col("o_orderstatus") == "P", F.concat(F.lit("#ifdef PENDING\n"), line, F.lit("#endif\n"))).otherwise(line)
    orders = read("orders").select("o_custkey", F.struct("o_orderkey", guarded.alias("code")).alias("o")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["code"]), "").alias("orders"))
    people = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    text = """#include "{s}.h"
namespace r{r} { namespace n{n} {
class Customer{c} : public Segment{s} {
public:
    Account account; /* not a call(x) */
    void note(int what, int day);
    void pay(int amount, int day) override;
};
void Customer{c}::pay(int amount, int day) {
    account.charge(amount); this->note(amount, day);
    Segment{s}::audit();
    Ledger book(amount, "text(1, 2)");
{orders}}
} // namespace n{n}
int total{c}(
    int a,
    const Account& b) {
    return n{n}::rate(a) + (*hook)(b) + b.owner().mail->send(a, {a, 1});
}
}
"""
    parts = {"{c}": F.col("c_custkey"), "{s}": F.col("c_mktsegment"), "{r}": F.col("n_regionkey"), "{n}": F.col("n_nationkey"), "{orders}": F.coalesce("orders", F.lit(""))}
    body = F.lit(text)
    for mark, value in parts.items():
        body = F.replace(body, F.lit(mark), value.cast("string"))
    files = people.select(F.concat(F.lit("src/c"), "c_custkey", F.lit(".cpp")).alias("path"), body.alias("text"))
    head = F.concat(F.lit("#pragma once\nclass Segment"), "c_mktsegment", F.lit(" {\npublic:\n    virtual void pay(int amount, int day) = 0;\n    static void audit();\n};\n"))
    segments = read("customer").select("c_mktsegment").distinct().select(F.concat(F.lit("src/"), "c_mktsegment", F.lit(".h")).alias("path"), head.alias("text"))
    account = "struct Mail { void send(int what, int more); };\nclass Owner { public: Mail* mail; };\ntypedef Owner Person;\nclass Account {\npublic:\n    void charge(int amount);\n    Person owner() const;\n};\n"
    fixed = spark.createDataFrame([("src/account.h", account)], "path string, text string")
    return files.unionByName(segments).unionByName(fixed)


def _facts(spark, sf_dir) -> DataFrame:
    return ingest.facts(sources(spark, sf_dir), ingest.macro_map({"NDEBUG": ""}))


def _stored(spark, sf_dir) -> DataFrame:
    return tables.stored(_facts(spark, sf_dir), "fact_type")


_P = "p AS (SELECT c_custkey AS c, c_mktsegment AS s, 'src/c' || c_custkey || '.cpp' AS path, 'r' || n_regionkey AS r, 'r' || n_regionkey || '::n' || n_nationkey AS ns, 'n' || n_nationkey AS n, 'r' || n_regionkey || '::n' || n_nationkey || '::Customer' || c_custkey AS cls FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_CALLS = f"""{_P}, k AS (
SELECT path, cls || '::pay' AS caller, 'charge' AS callee, 'member' AS kind, 'account' AS receiver, 1 AS argc, 'active' AS build_status FROM p
UNION ALL SELECT path, cls || '::pay', 'note', 'member', 'this', 2, 'active' FROM p
UNION ALL SELECT path, cls || '::pay', 'Segment' || s || '::audit', 'qualified', NULL, 0, 'active' FROM p
UNION ALL SELECT path, cls || '::pay', 'Ledger', 'constructor', 'book', 2, 'active' FROM p
UNION ALL SELECT path, r || '::total' || c, n || '::rate', 'qualified', NULL, 1, 'active' FROM p
UNION ALL SELECT path, r || '::total' || c, 'hook', 'function_pointer', NULL, 1, 'active' FROM p
UNION ALL SELECT path, r || '::total' || c, 'owner', 'member', 'b', 0, 'active' FROM p
UNION ALL SELECT path, r || '::total' || c, 'send', 'chained', 'b.owner().mail', 2, 'active' FROM p
UNION ALL SELECT path, cls || '::pay', 'settle_' || o_orderkey, 'free', NULL, 1, CASE o_orderstatus WHEN 'F' THEN 'inactive' WHEN 'P' THEN 'conditional' ELSE 'active' END FROM p JOIN orders ON o_custkey = c)"""


@query(f"WITH {_CALLS} SELECT * FROM k")
def code_calls(spark, sf_dir):
    """Every kind of call, with its receiver, argument count and build status."""
    return _facts(spark, sf_dir).filter("fact_type = 'call'").select("path", F.col("subject").alias("caller"), F.col("object").alias("callee"), "kind", "receiver", "argc", "build_status")


@query(f"""WITH {_P}, f AS (
SELECT path, 6 AS line, cls || '::note' AS name, 'declaration' AS kind, 'void' AS type, 2 AS argc FROM p UNION ALL SELECT path, 7, cls || '::pay', 'declaration', 'void', 2 FROM p
UNION ALL SELECT path, 9, cls || '::pay', 'definition', 'void', 2 FROM p
UNION ALL SELECT path, 15 + (SELECT coalesce(sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 3 ELSE 1 END), 0) FROM orders WHERE o_custkey = c), r || '::total' || c, 'definition', 'int', 2 FROM p
UNION ALL SELECT DISTINCT 'src/' || s || '.h', 4, 'Segment' || s || '::pay', 'declaration', 'void', 2 FROM p UNION ALL SELECT DISTINCT 'src/' || s || '.h', 5, 'Segment' || s || '::audit', 'declaration', 'void', 0 FROM p
UNION ALL VALUES ('src/account.h', 1, 'Mail::send', 'declaration', 'void', 2), ('src/account.h', 6, 'Account::charge', 'declaration', 'void', 1), ('src/account.h', 7, 'Account::owner', 'declaration', 'Person', 0))
SELECT path, CAST(line AS BIGINT) AS line, name, kind, type, argc FROM f""")
def code_symbols(spark, sf_dir):
    """Functions and methods, with outer namespaces, in and after inner ones, heads over several lines."""
    return _facts(spark, sf_dir).filter("fact_type = 'symbol'").select("path", "line", F.col("subject").alias("name"), "kind", "type", "argc")


@query(f"""WITH {_P}
SELECT 'type' AS fact_type, cls AS subject, 'class' AS object, NULL AS type FROM p UNION ALL SELECT 'inherits', cls, 'Segment' || s, NULL FROM p UNION ALL SELECT 'field', cls, 'account', 'Account' FROM p
UNION ALL SELECT 'binding', cls || '::pay', unnest(['amount', 'day']), 'int' FROM p UNION ALL SELECT 'binding', r || '::total' || c, 'a', 'int' FROM p UNION ALL SELECT 'binding', r || '::total' || c, 'b', 'const Account&' FROM p
UNION ALL SELECT DISTINCT 'type', 'Segment' || s, 'class', NULL FROM p
UNION ALL VALUES ('type', 'Mail', 'struct', NULL), ('type', 'Owner', 'class', NULL), ('field', 'Owner', 'mail', 'Mail*'), ('alias', 'Person', 'Owner', NULL), ('type', 'Account', 'class', NULL)""")
def code_types(spark, sf_dir):
    """Classes, bases, fields, aliases and what functions bind."""
    return _facts(spark, sf_dir).filter("fact_type in ('type', 'inherits', 'field', 'alias', 'binding')").select("fact_type", "subject", "object", "type")


@query(f"""WITH {_CALLS} SELECT path, caller, callee, receiver, CASE receiver WHEN 'account' THEN 'Account' WHEN 'this' THEN split_part(caller, '::', 3) WHEN 'b' THEN 'Account' ELSE 'Mail' END AS type FROM k WHERE kind IN ('member', 'chained')""")
def code_receivers(spark, sf_dir):
    """The type of each receiver: a field, this, a parameter, and a chain through a method, an alias and a field."""
    found = receivers.receiver_types(_stored(spark, sf_dir))
    return found.select("path", F.col("subject").alias("caller"), F.col("object").alias("callee"), "receiver", "type")


@query(f"""WITH {_CALLS}, e AS (SELECT caller, callee, build_status, CASE WHEN callee = 'charge' THEN 'Account::charge' WHEN callee = 'owner' THEN 'Account::owner' WHEN callee = 'send' THEN 'Mail::send' WHEN callee = 'note' THEN regexp_replace(caller, 'pay$', 'note') WHEN callee LIKE 'Segment%' THEN callee END AS resolved FROM k)
SELECT caller, callee, resolved, CASE WHEN resolved IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, count(*) AS n FROM e GROUP BY ALL""")
def code_edges(spark, sf_dir):
    """Calls bound to the symbols they mean, across files."""
    return evidence.edges(_facts(spark, sf_dir)).groupBy("caller", "callee", "resolved", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P} SELECT DISTINCT 'Segment' || s AS base, 'pay' AS method, cls || '::pay' AS candidate FROM p")
def code_overriders(spark, sf_dir):
    """What a call of a virtual method may reach."""
    return receivers.overriders(_stored(spark, sf_dir))


@query("""SELECT 'src/c' || c_custkey || '.cpp' AS path, c_mktsegment || '.h' AS target, 'src/' || c_mktsegment || '.h' AS header, 'resolved' AS resolution FROM customer""")
def code_includes(spark, sf_dir):
    """Includes to the files they mean."""
    return headers.resolve_includes(sources(spark, sf_dir), ["include"]).select("path", "target", "header", "resolution")


@query(f"""WITH {_P}, o AS (SELECT path, cls || '::pay' AS caller, 'settle_' || o_orderkey AS callee, CASE o_orderstatus WHEN 'F' THEN 'contradicted' WHEN 'P' THEN 'conditional' ELSE 'supported' END AS active FROM p JOIN orders ON o_custkey = c)
SELECT cls || '::pay' AS subject, 'charge' AS object, 'calls' AS claim_type, 'supported' AS verdict FROM p
UNION ALL SELECT cls || '::pay', '', 'definition_exists', 'supported' FROM p UNION ALL SELECT cls || '::pay', 'Account::charge', 'reaches', 'supported' FROM p
UNION ALL SELECT path, s || '.h', 'includes', 'supported' FROM p UNION ALL SELECT path, 'other.h', 'includes', 'contradicted' FROM p""")
def code_claims(spark, sf_dir):
    """Claims about every customer's file, judged."""
    facts = _stored(spark, sf_dir)
    names = facts.filter("fact_type = 'type' and subject like 'r%'").select(F.concat("subject", F.lit("::pay")).alias("subject"), "path")
    head = facts.filter("fact_type = 'include'").select("path", F.col("object").alias("header"))
    rows = names.join(head, "path").select(F.inline(F.array(*(F.struct(F.lit(t).alias("claim_type"), s.alias("subject"), o.alias("object")) for t, s, o in (("calls", F.col("subject"), F.lit("charge")), ("definition_exists", F.col("subject"), F.lit("")), ("reaches", F.col("subject"), F.lit("Account::charge")), ("includes", F.col("path"), F.col("header")), ("includes", F.col("path"), F.lit("other.h")))))))
    claims = rows.withColumn("claim_id", F.sha1(F.concat_ws("\0", "claim_type", "subject", "object")))
    return evidence.verify(claims.select("claim_id", "claim_type", "subject", "object"), facts).select("subject", "object", "claim_type", "verdict")


@query("""SELECT c_custkey, 'contradicted' AS overall, CAST(5 AS BIGINT) AS claims, 'unsafe' AS safety FROM customer""")
def code_answers(spark, sf_dir):
    """An answer about every customer's class: what it calls, derives from and does not do, and one thing that is wrong."""
    prose = "pay of Customer{c}: Customer{c}::pay calls charge and note. Customer{c} derives from Segment{s}. Customer{c}::pay does not call account_of. src/c{c}.cpp includes nothing.h"
    texts = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.replace(F.replace(F.lit(prose), F.lit("{c}"), F.col("c_custkey").cast("string")), F.lit("{s}"), F.col("c_mktsegment")).alias("body"))
    return evidence.verify_text(texts, "c_custkey", "body", _facts(spark, sf_dir))


@query("SELECT kind, name, n FROM (SELECT 'fact_type' AS kind, 'inherits' AS name, count(*) AS n FROM customer UNION ALL SELECT 'fact_type', 'include', count(*) FROM customer UNION ALL SELECT 'file_role', 'project', (SELECT count(*) FROM customer) + (SELECT count(DISTINCT c_mktsegment) FROM customer) + 1 UNION ALL SELECT 'total', 'files', (SELECT count(*) FROM customer) + (SELECT count(DISTINCT c_mktsegment) FROM customer) + 1)")
def code_diagnostics(spark, sf_dir):
    """Counts of facts and files."""
    files = sources(spark, sf_dir)
    report = workflow.diagnostics(tables.stored(ingest.facts(files, ingest.macro_map({"NDEBUG": ""})), "fact_type"), tables.manifest(files, "path", "text"))
    return report.filter("name in ('inherits', 'include', 'project', 'files')")


def wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of a C file for every supplier: a table of callbacks, one kept and called, a task's entry on its way, contexts."""
    text = """static const Ops ops{k}[] = { .open = on_open{k}, on_close };
void init{k}(Timer *t, Callback onFire) {
    t->fireCallback = onFire;
}
void run{k}(Timer *t) {
    t->fireCallback(t, {k}); // t->lostCallback(t)
}
void setup{k}(void) {
    init{k}(&timer, onFire);
{guarded}}
static void prvPrepare{k}(TaskFunction_t entry, void *p) {
    tcb->pxTaskCode = entry;
    pxPortInitialiseStack(top, entry, p);
}
static void prvCreate{k}(TaskFunction_t entry) {
    prvPrepare{k}(entry, 0);
}
int xTaskCreate{k}(TaskFunction_t entry) {
    return prvCreate{k}(entry);
}
void Timer{k}_IRQHandler(void) { xQueueSendFromISR(queue, {k}); }
int xQueueDrain{k}(void) { return {k}; }
"""
    line = "    bus_registerHandler(&on_fire{k});\n"
    guarded = F.when(F.col("s_nationkey") % 2 == 0, F.lit("#ifdef WIRED\n" + line + "#endif\n")).otherwise(F.lit(line))
    body = F.replace(F.replace(F.lit(text), F.lit("{guarded}"), guarded), F.lit("{k}"), F.col("s_suppkey").cast("string"))
    path = F.concat(F.lit("dev/n"), "s_nationkey", F.lit("/s"), "s_suppkey", F.lit(".c"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(path.alias("path"), body.alias("text"))


def _wired(spark, sf_dir) -> DataFrame:
    return tables.stored(ingest.facts(wiring(spark, sf_dir), ingest.macro_map({"NDEBUG": ""})), "fact_type")


_W = "w AS (SELECT s_suppkey AS k, 'dev/n' || s_nationkey || '/s' || s_suppkey || '.c' AS path, CASE s_nationkey % 2 WHEN 0 THEN 'conditional' ELSE 'active' END AS st FROM supplier)"


@query(f"""WITH {_W}
SELECT path, 'bus_registerHandler' AS subject, 'registers_callback' AS predicate, 'on_fire' || k AS object, NULL AS field, 'setup' || k AS place, st AS build_status FROM w
UNION ALL SELECT path, 'fireCallback', 'registers_callback', 't', NULL, 'run' || k, 'active' FROM w
UNION ALL SELECT path, 'init' || k, 'stores_callback', 'onFire', 'fireCallback', 't->fireCallback', 'active' FROM w
UNION ALL SELECT path, 'run' || k, 'invokes_callback', 'fireCallback', 'fireCallback', 't.fireCallback', 'active' FROM w
UNION ALL SELECT path, 'ops' || k || '.open', 'callback_candidate', 'on_open' || k, 'open', 'ops' || k, 'active' FROM w
UNION ALL SELECT path, 'ops' || k || '.1', 'callback_candidate', 'on_close', '1', 'ops' || k, 'active' FROM w
UNION ALL SELECT path, 'prvPrepare' || k, 'stores_task_entry', 'entry', 'pxTaskCode', 'tcb->pxTaskCode', 'active' FROM w
UNION ALL SELECT path, 'prvPrepare' || k, 'initializes_stack_with_task_entry', 'pxPortInitialiseStack', 'entry', NULL, 'active' FROM w
UNION ALL SELECT path, 'Timer' || k || '_IRQHandler', 'has_execution_context', 'isr', NULL, NULL, 'active' FROM w
UNION ALL SELECT path, 'xQueueDrain' || k, 'has_execution_context', 'task', NULL, NULL, 'active' FROM w""")
def code_callbacks(spark, sf_dir):
    """Callbacks registered, kept, called and listed in tables, task entries, and contexts."""
    return callbacks.relations(_wired(spark, sf_dir)).drop("line")


@query(f"""WITH {_W}
SELECT path, CAST(9 AS BIGINT) AS line, 'setup' || k AS subject, 'callback_dataflows_to' AS predicate, 'run' || k AS object, 'onFire' AS field, 'fireCallback' AS place, 'active' AS build_status FROM w
UNION ALL SELECT path, CASE st WHEN 'active' THEN 20 ELSE 22 END, 'xTaskCreate' || k, 'task_entry_dataflows_to', 'pxPortInitialiseStack', 'entry', 'prvPrepare' || k, 'active' FROM w""")
def code_flows(spark, sf_dir):
    """From where a callback or a task's entry is handed over to where it is called or set up."""
    facts = _wired(spark, sf_dir)
    return callbacks.flows(facts, callbacks.relations(facts))


#: Claims about each supplier's file: type, subject, object, verdict and reason; {k} and {p} are its key and path.
_CLAIMED = [
    ("callback_registers", "bus_registerHandler", "on_fire{k}", "conditional", "callback_registration_supported"), ("callback_registers", "bus_registerHandler", "run{k}", "unknown", "callback_registration_not_found"),
    ("stores_callback", "init{k}", "t->fireCallback", "conditional", "stores_callback_supported"), ("stores_callback", "run{k}", "onFire", "unknown", "stores_callback_not_found"),
    ("invokes_callback", "run{k}", "fireCallback", "conditional", "invokes_callback_supported"), ("invokes_callback", "run{k}", "", "unknown", "claim_missing_endpoint"),
    ("callback_dataflow", "setup{k}", "run{k}", "conditional", "callback_dataflow_supported"), ("callback_dataflow", "run{k}", "setup{k}", "unknown", "callback_dataflow_not_found"),
    ("task_entry_dataflow", "xTaskCreate{k}", "pxPortInitialiseStack", "conditional", "task_entry_dataflow_supported"), ("task_entry_dataflow", "prvCreate{k}", "pxPortInitialiseStack", "unknown", "task_entry_dataflow_not_found"),
    ("execution_context", "Timer{k}_IRQHandler", "interrupt", "supported", "execution_context_supported"), ("execution_context", "xQueueDrain{k}", "isr", "contradicted", "execution_context_conflict"),
    ("execution_context", "run{k}", "task", "unknown", "execution_context_not_found"), ("execution_context", "run{k}", "moon", "unknown", "unsupported_execution_context"),
    ("target_profile", "name", "board", "supported", "target_profile_supported"), ("target_profile", "heap", "heap_{k}", "contradicted", "target_profile_value_mismatch"), ("target_profile", "colour", "", "unknown", "target_profile_attribute_not_found"),
    ("build_config", "LEVEL", "", "supported", "build_config_macro_present"), ("build_config", "LEVEL", "-{k}", "contradicted", "build_config_macro_value_mismatch"), ("build_config", "OTHER{k}", "1", "unknown", "build_config_macro_not_found"),
    ("allocation_profile", "static allocation", "off", "supported", "allocation_profile_supported"), ("allocation_profile", "static", "enabled", "contradicted", "allocation_profile_mismatch"), ("allocation_profile", "heap", "1", "unknown", "build_config_macro_not_found"),
    ("calls", "setup{k}", "init{k}", "supported", None), ("nothing", "run{k}", "x", "unknown", None),
]
_ROWS = ", ".join(str(c).replace("None", "NULL") for c in _CLAIMED)


@query(f"""WITH {_W}, c AS (SELECT k, path, t.* FROM w, (VALUES {_ROWS}) t(claim_type, subject, object, verdict, reason))
SELECT claim_type, replace(subject, '{{k}}', CAST(k AS VARCHAR)) AS subject, replace(object, '{{k}}', CAST(k AS VARCHAR)) AS object, verdict, reason, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT 'file_active', path, '', CASE WHEN path LIKE 'dev/n3/%' THEN 'contradicted' ELSE 'supported' END, CASE WHEN path LIKE 'dev/n3/%' THEN 'target_file_selection_mismatch' ELSE 'target_file_selection_supported' END, 1 FROM w
UNION ALL SELECT 'file_active', '/tree/' || path, 'inactive', CASE WHEN path LIKE 'dev/n3/%' THEN 'supported' ELSE 'contradicted' END, CASE WHEN path LIKE 'dev/n3/%' THEN 'target_file_selection_supported' ELSE 'target_file_selection_mismatch' END, 1 FROM w
UNION ALL SELECT 'file_active', 'not/' || k || '.c', 'active', 'unknown', 'target_file_selection_not_found', 1 FROM w""")
def code_more_claims(spark, sf_dir):
    """Claims of all other kinds about every supplier's file and the target it is built for."""
    files = wiring(spark, sf_dir)
    made = F.array(*(F.struct(F.lit(t).alias("claim_type"), F.lit(s).alias("subject"), F.lit(o).alias("object")) for t, s, o, _, _ in _CLAIMED))
    paths = F.array(*(F.struct(F.lit("file_active").alias("claim_type"), s.alias("subject"), F.lit(o).alias("object")) for s, o in ((F.col("path"), ""), (F.concat(F.lit("/tree/"), "path"), "inactive"), (F.concat(F.lit("not/"), "k", F.lit(".c")), "active"))))
    rows = files.withColumn("k", F.regexp_extract("path", r"s([0-9]+)\.c$", 1)).select("k", F.inline(F.concat(made, paths))).withColumns({c: F.replace(F.col(c), F.lit("{k}"), F.col("k")) for c in ("subject", "object")})
    rows = tables.cut(rows.select(F.concat_ws("\0", "k", F.monotonically_increasing_id()).alias("claim_id"), "claim_type", "subject", "object"))
    profile = target.Profile(inactive_prefixes=["dev/n3"], heap="heap_4.c")
    settings = target.settings(spark, "board", profile, {"LEVEL": "2", "configSUPPORT_STATIC_ALLOCATION": "0"})
    judged = claims.verify(rows, _wired(spark, sf_dir), settings, target.decide(files.select("path"), profile))
    return judged.groupBy("claim_type", "subject", "object", "verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


_ASKED = ["xTaskCreate{k} path prvPrepare{k}", "run{k} path setup{k}", "prvCreate{k} caller", "bus_registerHandler caller of s{k}", "xTaskCreate{k} callee", "run{k} の定義", "gone{k} の定義", "?", "path run{k}"]


def _questions(spark, sf_dir) -> DataFrame:
    """question (its text) of every supplier's file."""
    each = F.explode(F.array(*map(F.lit, _ASKED)))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", each.alias("q")).select(F.replace("q", F.lit("{k}"), F.col("s_suppkey").cast("string")).alias("question")).distinct()


@query(f"""WITH {_W}, n AS (SELECT count(*) AS n, sum(CASE st WHEN 'conditional' THEN 1 ELSE 0 END) AS loose FROM w), a AS (
SELECT 'xTaskCreate' || k || ' path prvPrepare' || k AS question, 'call_path' AS mode, 1 AS facts, '' AS unknowns FROM w
UNION ALL SELECT 'run' || k || ' path setup' || k, 'call_path', 0, 'call_graph_incomplete' FROM w
UNION ALL SELECT 'prvCreate' || k || ' caller', 'callers', 1, '' FROM w
UNION ALL SELECT 'bus_registerHandler caller of s' || k, 'callers', n, CASE WHEN loose > 0 THEN 'conditional_build_evidence' ELSE '' END FROM w, n
UNION ALL SELECT 'xTaskCreate' || k || ' callee', 'callees', 1, '' FROM w
UNION ALL SELECT 'run' || k || ' の定義', 'definition', 1, '' FROM w
UNION ALL SELECT 'gone' || k || ' の定義', 'definition', 0, 'definition_not_found' FROM w
UNION ALL SELECT DISTINCT '?', 'evidence', 0, 'low_confidence_retrieval' FROM w
UNION ALL SELECT 'path run' || k, 'call_path', 0, 'ambiguous_symbol' FROM w)
SELECT question, mode, CAST(facts AS BIGINT) AS facts, unknowns, CASE WHEN facts = 0 THEN 'insufficient_evidence' WHEN unknowns = '' THEN 'answerable' ELSE 'partial' END AS answerability FROM a""")
def code_assessed(spark, sf_dir):
    """How far the facts answer questions about every supplier's file."""
    return questions.assess_facts(_questions(spark, sf_dir), "question", "question", _wired(spark, sf_dir)).drop("constraints")


@query(f"""WITH {_W}
SELECT 'call_path' AS kind, 'xTaskCreate' || k || ' > prvCreate' || k || ' > prvPrepare' || k AS path, CAST(2 AS BIGINT) AS line, 'xTaskCreate' || k AS subject, 'prvPrepare' || k AS object, 'active' AS build_status FROM w
UNION ALL SELECT 'call', path, CASE st WHEN 'active' THEN 20 ELSE 22 END, 'xTaskCreate' || k, 'prvCreate' || k, 'active' FROM w
UNION ALL SELECT 'call', path, CASE st WHEN 'active' THEN 20 ELSE 22 END, 'xTaskCreate' || k, 'prvCreate' || k, 'active' FROM w
UNION ALL SELECT 'definition', path, 5, 'run' || k, NULL, 'active' FROM w
UNION ALL SELECT 'call', w.path, CASE w.st WHEN 'active' THEN 10 ELSE 11 END, 'setup' || w.k, 'bus_registerHandler', w.st FROM w, w AS asking""")
def code_answered(spark, sf_dir):
    """Routes, callers, callees and definitions that answer the questions."""
    return questions.answers(_questions(spark, sf_dir), "question", "question", _wired(spark, sf_dir)).drop("question", "mode")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``sources`` at two times. In the second, customers with over 9,000 are new, those in debt have one more function,
    those without orders are gone, and the header of MACHINERY has a setting that its customers' files ask for."""
    balance = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("src/c"), "c_custkey", F.lit(".cpp")).alias("path"), "c_acctbal")
    files = sources(spark, sf_dir).join(balance, "path", "left")
    more = F.concat("text", F.lit("void extra"), F.regexp_extract("path", r"c(\d+)", 1), F.lit("() {\n    settle_more(1);\n}\n"))
    later = F.when(F.col("c_acctbal") < 0, more).when(F.col("path") == "src/MACHINERY.h", F.concat("text", F.lit("#define PENDING 1\n"))).otherwise(F.col("text"))
    return files.filter("c_acctbal is null or c_acctbal <= 9000").select("path", "text"), files.filter("c_acctbal is null or contains(text, 'settle_')").select("path", later.alias("text"))


@query(f"""WITH {_CALLS}, q AS (SELECT * FROM p WHERE c IN (SELECT o_custkey FROM orders))
SELECT k.path, caller AS subject, callee AS object, CASE WHEN build_status = 'conditional' AND s = 'MACHINERY' THEN 'active' ELSE build_status END AS build_status FROM k JOIN q ON k.path = q.path
UNION ALL SELECT path, 'extra' || c, 'settle_more', 'active' FROM q JOIN customer ON c = c_custkey WHERE c_acctbal < 0
UNION ALL SELECT path || ' > src/' || s || '.h', 'Segment' || s || '::' || unnest(['pay', 'audit']), 'function', 'active' FROM q""")
def code_refreshed(spark, sf_dir):
    """Calls, and what files see of their headers, in a store that was built from one snapshot and refreshed to the next."""
    first, second = snapshots(spark, sf_dir)
    store = FactStore(spark, f"{tables.shared_folder(spark)}/store-{uuid.uuid4().hex}")
    for tree in (first, second):
        incremental.refresh(store, tree, {"NDEBUG": ""}, whole=True)
    seen = store.read("projected").filter("fact_type = 'symbol'").unionByName(store.read("facts").filter("fact_type = 'call'"), allowMissingColumns=True)
    return seen.select("path", "subject", "object", "build_status")


@query("""WITH k AS (SELECT s_suppkey AS k, 'src/n' || s_suppkey || '.cpp' AS path, 's' || s_suppkey AS ns FROM supplier)
SELECT path, ns || '::help' AS caller, 'go' AS callee, ns || '::Node::go' AS resolved, 'resolved' AS status FROM k
UNION ALL SELECT path, ns || '::help', 'stop', ns || '::Peer::stop', 'resolved' FROM k
UNION ALL SELECT path, ns || '::use', 'go', ns || '::Node::go', 'resolved' FROM k
UNION ALL SELECT path, ns || '::use', 'stop', ns || '::Peer::stop', 'resolved' FROM k
UNION ALL SELECT path, 'shared', 'go', ns || '::Node::go', 'resolved' FROM k
UNION ALL SELECT path, ns || '::Leaf::turn', 'stop', ns || '::Peer::stop', 'resolved' FROM k""")
def code_scoped(spark, sf_dir):
    """Calls on receivers whose types go by the same short names in every supplier's namespace, also through an alias, a
    base's method and field, and in functions of one name in many files."""
    text = """namespace s{k} {
class Peer { public: void go(int a); void stop(); };
class Node { public: void go(int a); Peer* peer; };
class Leaf : public Node { public: void turn() { peer->stop(); } };
using Other = Peer;
void help(Node* x) { x->go(1); x->peer->stop(); }
void use(Leaf* l, Other* o) { l->go(2); o->stop(); }
}
static void shared(s{k}::Node* x) { x->go(3); }
"""
    key = F.col("s_suppkey").cast("string")
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("src/n"), key, F.lit(".cpp")).alias("path"), F.replace(F.lit(text), F.lit("{k}"), key).alias("text"))
    return evidence.edges(ingest.facts(files, ingest.macro_map({}))).select("path", "caller", "callee", "resolved", "status")


def _intent_sql(text: str) -> str:
    some = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
    cases = " ".join("WHEN " + " OR ".join("(" + " AND ".join(map(some, groups)) + ")" for groups in ways) + f" THEN '{name}'" for name, ways in questions.INTENTS)
    return f"SELECT doc_id, CASE {cases} ELSE 'evidence' END AS mode FROM (SELECT doc_id, lower(coalesce({text}, '')) AS q FROM documents)"


@query(_intent_sql("text"))
def question_intents(spark, sf_dir):
    """What each document, read as a question, asks for."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", questions.intent(F.col("text")).alias("mode"))
