"""Callbacks, task entries and execution contexts: relations read off facts, and where a function that is handed over ends up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.names import short_name
from ..operators import dataflow

#: How callbacks, what registers them, task entries, and what sets up a task's stack are called.
CALLBACK = r"[Cc]allback|[Hh]andler|[Ff]unction"
REGISTRAR = r"\w+(?:register|Register|callback|Callback)[A-Za-z_]*$"
TASK_ENTRY = r"(?i)task(?:code|function)|px(?:code|taskcode)"
TASK_FIELD = r"(?i)^(?:pxTaskCode|pxTaskFunction|taskEntry|pxCode)$"
STACK_SETUP = r"PortInitialiseStack$"
TASK_CREATOR = r"Task"

_PLAIN = r"^&?\s*(?:[A-Za-z_]\w*::)*[A-Za-z_]\w*$"


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"^&?\s*", "")


def handed(facts: DataFrame) -> DataFrame:
    """path, line, caller, callee, symbol, build_status: every plain name that a call hands over."""
    calls = facts.filter("fact_type = 'call' and size(args) > 0")
    names = F.filter("args", lambda a: a.rlike(_PLAIN) & ~a.isin("NULL", "nullptr", "true", "false", "this"))
    return calls.select("path", "line", F.col("subject").alias("caller"), F.col("object").alias("callee"), F.explode(names).alias("a"), "build_status").select("path", "line", "caller", "callee", _bare(F.col("a")).alias("symbol"), "build_status")


def relations(facts: DataFrame) -> DataFrame:
    """path, line, subject, predicate, object, field, place, build_status.

    registers_callback: a registering API and each name it gets. stores_callback: a function and the name it puts into a
    member (field). invokes_callback: a function and the member it calls. callback_candidate: a table's field and the
    name in it. stores_task_entry and initializes_stack_with_task_entry: the same for task entries (object of the latter:
    the stack's set-up, field: the entry). has_execution_context: a function and isr or task. None of them is a call.
    """
    columns = ["path", "line", "subject", "predicate", "object", "field", "place", "build_status"]
    none = F.lit(None).cast("string")
    given, field = handed(facts), F.element_at(F.split("receiver", r"->|\."), -1)
    registers = given.filter(short_name(F.col("callee")).rlike(REGISTRAR)).select("path", "line", F.col("callee").alias("subject"), F.lit("registers_callback").alias("predicate"), F.col("symbol").alias("object"), none.alias("field"), F.col("caller").alias("place"), "build_status")
    put = facts.filter(F.col("fact_type") == "assign").filter(F.col("receiver").rlike(r"->|\.")).select("path", "line", "subject", "object", field.alias("field"), F.col("receiver").alias("place"), "build_status")
    stores = put.filter(F.col("field").rlike(CALLBACK) | F.col("object").rlike(CALLBACK)).withColumn("predicate", F.lit("stores_callback"))
    called = facts.filter("fact_type = 'call' and kind in ('member', 'chained')").filter(F.col("object").rlike(CALLBACK))
    invokes = called.select("path", "line", "subject", F.lit("invokes_callback").alias("predicate"), "object", F.col("object").alias("field"), F.concat_ws(".", "receiver", "object").alias("place"), "build_status")
    tables = facts.filter("fact_type = 'table_entry'").select("path", "line", "subject", F.lit("callback_candidate").alias("predicate"), "object", F.split_part("subject", F.lit("."), F.lit(-1)).alias("field"), F.split_part("subject", F.lit("."), F.lit(1)).alias("place"), "build_status")
    typed = facts.filter(F.col("fact_type") == "binding").filter(F.col("type").contains("TaskFunction_t")).select(F.col("path").alias("p"), F.col("subject").alias("s"), F.col("object").alias("o")).distinct()
    own = lambda rows, fn, name: rows.join(typed, (F.col("path") == F.col("p")) & (F.col(fn) == F.col("s")) & (F.col(name) == F.col("o")), "left").filter(F.col("o").isNotNull() | F.col(name).rlike(TASK_ENTRY)).drop("p", "s", "o")
    entries = own(put.filter(F.col("field").rlike(TASK_FIELD)), "subject", "object").withColumn("predicate", F.lit("stores_task_entry"))
    stacks = own(given.filter(F.col("callee").rlike(STACK_SETUP)), "caller", "symbol").select("path", "line", F.col("caller").alias("subject"), F.lit("initializes_stack_with_task_entry").alias("predicate"), F.col("callee").alias("object"), F.col("symbol").alias("field"), none.alias("place"), "build_status")
    contexts = facts.filter("fact_type = 'symbol' and kind = 'definition'").withColumn("context", lexical.api_context(short_name(F.col("subject")))).filter("context is not null")
    contexts = contexts.select("path", "line", "subject", F.lit("has_execution_context").alias("predicate"), F.col("context").alias("object"), none.alias("field"), none.alias("place"), "build_status")
    out = registers.select(*columns)
    for rows in (stores, invokes, tables, entries, stacks, contexts):
        out = out.unionByName(rows.select(*columns))
    return out


def flows(facts: DataFrame, found: DataFrame) -> DataFrame:
    """``callback_dataflows_to`` and ``task_entry_dataflows_to`` in the columns of ``relations``, between active facts.

    A callback flow leads from who hands a name over to who calls the field it is kept in (field: the name, place: the
    field). A task entry flows from its creator, through one function between at most, to the set-up of its stack.
    """
    given, live = handed(facts).filter("build_status <> 'inactive'"), found.filter("build_status <> 'inactive'")
    of = lambda p: live.filter(F.col("predicate") == p)
    stored = of("stores_callback").select("path", F.col("subject").alias("function"), F.col("object").alias("symbol"), "field", "build_status")
    invoked = of("invokes_callback").select("path", F.col("subject").alias("function"), "field", "build_status")
    back = dataflow.handed_on(given, stored, invoked)
    back = back.select("path", "line", F.col("caller").alias("subject"), F.lit("callback_dataflows_to").alias("predicate"), F.col("invoker").alias("object"), F.col("symbol").alias("field"), F.col("field").alias("place"), "build_status")
    stacks = of("initializes_stack_with_task_entry").select("path", F.col("subject").alias("function"), F.col("object").alias("setup"), F.col("field").alias("symbol"), "build_status")
    tasks = dataflow.forwarded(given, stacks).filter(F.col("creator").rlike(TASK_CREATOR))
    tasks = tasks.select("path", "line", F.col("creator").alias("subject"), F.lit("task_entry_dataflows_to").alias("predicate"), F.col("setup").alias("object"), F.col("symbol").alias("field"), F.col("function").alias("place"), "build_status")
    return back.unionByName(tasks)
