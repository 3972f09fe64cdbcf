"""From files to facts, as joins and windows over lines: guards, includes, functions, calls."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards
from ..functions import statements as stmt
from ..operators import tables

#: Comments, raw strings, strings and characters.
_NOISE = re.compile(r"//[^\n]*|R\"([^\s()\\]{0,16})\(.*?(?:\)\1\"|\Z)|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_DIRECTIVES = re.compile(r"^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", re.M)
_DIRECTIVE = r"^\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b\s*(.*?)\s*$"


def blank(text: str) -> str:
    """Comments and literals blanked, columns and lines kept."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def code_only(text: str) -> str:
    """``blank`` text without directives and the lines that continue them."""
    return _DIRECTIVES.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), blank(text))


@lru_cache(maxsize=1)
def _declarations():
    said = "text:string,owner:string,code:boolean,base:bigint,line:bigint,before:string,states:string"
    of_said = pa.struct([("text", pa.string()), ("owner", pa.string()), ("code", pa.bool_()), ("base", pa.int64()), ("line", pa.int64()), ("before", pa.string()), ("states", pa.string())])
    kind = pa.list_(pa.struct([("text", pa.string()), ("owner", pa.string()), ("ns", pa.string()), ("said", pa.list_(of_said))]))

    @F.arrow_udf(f"array<struct<text:string,owner:string,ns:string,said:array<struct<{said}>>>>")
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([stmt.declarations(code_only(t), [(s["first"], s["last"], s["rank"]) for s in held or ()]) if t else [] for t, held in rows], kind)

    return run


def branches(lines: DataFrame, macros: Column | None) -> DataFrame:
    """path, directive, expression, first, last (lines of content), depth, status, reason of each conditional branch.

    The first branch of a group that is not inactive decides: if it is active, all after it are not; if it is
    conditional, later ones are so at most. Groups without ``#endif`` run to the end of the file. ``macros``
    None: each line brings its own, in column macros. Lines that bring their file's last line's number, in column end,
    may lack those without a directive.
    """
    parts = F.regexp_extract("line", _DIRECTIVE, 1).alias("directive"), F.trim(F.regexp_replace(F.regexp_extract("line", _DIRECTIVE, 2), r"//.*$|/\*.*?(\*/|$)", " ")).alias("expression")
    at = Window.partitionBy("path").orderBy("line_no")
    macros = F.col("macros") if macros is None else macros
    last = F.col("end") if "end" in lines.columns else F.max("line_no").over(Window.partitionBy("path"))
    rows = lines.select("path", "line_no", macros.alias("macros"), *parts, last.alias("end")).filter("directive <> ''")
    opens, closes = F.col("directive").isin("if", "ifdef", "ifndef"), F.col("directive") == "endif"
    rows = rows.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0)) + F.when(closes, 1).otherwise(0))
    of_depth = Window.partitionBy("path", "depth").orderBy("line_no")
    rows = rows.withColumn("group", F.sum(F.when(opens, 1).otherwise(0)).over(of_depth.rowsBetween(Window.unboundedPreceding, 0))).filter("depth > 0 and `group` > 0")
    rows = rows.withColumn("last", F.coalesce(F.lead("line_no").over(Window.partitionBy("path", "depth", "group").orderBy("line_no")) - 1, F.col("end"))).filter(~closes)
    judged = guards.eval_guard(F.when(F.col("directive") == "elif", "if").otherwise(F.col("directive")), F.col("expression"), F.col("macros"))
    rows = rows.withColumn("own", F.when(F.col("directive") == "else", F.struct(F.lit("active").alias("status"), F.lit("else").alias("reason"))).otherwise(judged))
    siblings = Window.partitionBy("path", "depth", "group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.first(F.when(F.col("own.status") != "inactive", F.col("own.status")), ignorenulls=True).over(siblings)
    rows = rows.withColumn("prior", prior)
    status = F.when(F.col("prior") == "active", "inactive").when((F.col("prior") == "conditional") & (F.col("own.status") != "inactive"), "conditional").otherwise(F.col("own.status"))
    reason = F.when(F.col("prior") == "active", "preceded_by_active_branch").when(F.col("prior") == "conditional", "preceded_by_conditional_branch").otherwise(F.col("own.reason"))
    return rows.select("path", "directive", "expression", F.col("line_no").alias("line"), (F.col("line_no") + 1).alias("first"), "last", F.col("depth").cast("int").alias("depth"), status.alias("status"), reason.alias("reason"))


def line_status(lines: DataFrame, found: DataFrame) -> DataFrame:
    """path, line_no, line and build_status: inactive in any inactive branch, else conditional in any such."""
    rank = F.when(F.col("status") == "inactive", 2).when(F.col("status") == "conditional", 1).otherwise(0)
    spans = found.filter("last >= first").select("path", F.explode(F.sequence("first", "last")).alias("line_no"), rank.alias("rank"))
    worst = spans.groupBy("path", "line_no").agg(F.max("rank").alias("rank"))
    status = F.when(F.col("rank") == 2, "inactive").when(F.col("rank") == 1, "conditional").otherwise("active")
    return lines.join(worst, ["path", "line_no"], "left").select("path", "line_no", "line", status.alias("build_status"))


#: ``place = name``, also with an address; the last group is the name. Function pointers may be declared there.
_ASSIGNS = r"((?:\w+\s*(?:->|\.)\s*)*\b[A-Za-z_]\w*)(?:\s*\)\s*\([^()]*\))?\s*=\s*&?\s*((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)\s*[;,]"
#: The name of a table whose initialiser opens, and one entry of it: its field, if told, and the name it holds.
_TABLE, _ENTRY = r"\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?=\s*\{$", r"^\s*(?:\.\s*(\w+)\s*=\s*)?&?\s*((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)\s*\}?\s*$"
#: Names that are values, not functions or variables.
_VALUES = ["true", "false", "nullptr", "NULL", "this", "new"]

def _spans(found: DataFrame) -> DataFrame:
    """path, spans (first, last, rank) of the branches of a file that are not active."""
    span = F.struct("first", "last", F.when(F.col("status") == "inactive", 2).otherwise(1).alias("rank"))
    return found.filter("last >= first and status <> 'active'").groupBy("path").agg(F.collect_list(span).alias("spans"))


def _state(rank: Column) -> Column:
    return F.when(rank.cast("string") == "2", "inactive").when(rank.cast("string") == "1", "conditional").otherwise("active")


def facts(files: DataFrame, macros: Column | None) -> DataFrame:
    """Facts of files (path, text) under a map of macros (None: column macros of each file).

    Columns fact_type, path, line, subject, predicate, object, build_status, detail, kind, receiver, argc, type:
    include: path includes target. symbol: a function, its definition or declaration, its return type.
    call: caller calls callee (detail: the caller's scope; kind, receiver and args as ``statements.calls_of`` has them).
    assign: a function puts a name (object) into a place (receiver). table_entry: a table's field holds a name.
    type: a class defines its kind; inherits: a class and each base. field: a class and a member of a type. alias: a name
    and what it stands for. binding: a function and a parameter or local variable of a type.
    build_guard: branch lines and their status.
    """
    every = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    raw = files.select("path", *([] if macros is not None else ["macros"]), F.size(every).cast("long").alias("end"), F.posexplode(every).alias("n", "line")).filter(F.contains("line", F.lit("#")))
    marks = tables.stored(raw.filter(F.col("line").rlike(r"^\s*#\s*(?:if|el|endif|include)")).withColumn("line_no", F.col("n").cast("long") + 1).drop("n"))
    # Read three times below.
    guard = tables.stored(branches(marks, macros))
    spans = _spans(guard)
    include = marks.withColumn("target", F.regexp_extract("line", r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]", 1)).filter("target <> ''").join(spans, "path", "left")
    over = F.filter("spans", lambda s: F.col("line_no").between(s["first"], s["last"]))
    include = include.withColumn("build_status", _state(F.array_max(F.transform(over, lambda s: s["rank"]))))

    # What stands outside of functions, each with the statements in the block that it opens.
    # Reading them takes much longer than moving them: their number of tasks is not cut down for small sizes in bytes.
    # By a hash of the path, since a repartition by what the files lie by already (after a join) would be left out.
    spread = files.select("path", "text").join(spans, "path", "left").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path"))
    parts = spread.select("path", F.explode(_declarations()("text", "spans")).alias("d"))
    parts = parts.withColumn("decl", stmt.declared(F.col("d.text"), F.col("d.owner")))
    decl = F.col("decl")
    named = F.concat_ws("::", F.nullif("d.ns", F.lit("")), decl["name"])
    # The function around a statement, and the head of a definition is its function's as well: its initialisers call.
    defined = F.coalesce((decl["what"] == "function") & (decl["kind"] == "definition"), F.lit(False))
    rows = parts.select("path", F.col("d.ns").alias("ns"), "decl", named.alias("qualified"), F.when(defined, named).alias("caller"), F.explode("d.said").alias("s")).select("path", "ns", "decl", "qualified", "caller", "s.*")
    within = F.col("code") & F.col("text").rlike(r"^[\s\w:<>,*&]+[\s*&>]\w+\s*(\[[^\]]*\]\s*)*(=|;$)|\([^{]*\{.")
    spoken = F.col("caller").isNotNull() & F.contains("text", F.lit("(")) & (F.col("code") | F.contains("text", F.lit(":")))
    rows = rows.withColumns({"local": stmt.declared(F.when(within, F.col("text")), F.col("owner")), "called": stmt.calls(F.when(spoken, F.col("text")), ~F.col("code"))})
    rows = rows.withColumn("head", F.when(F.col("code"), F.col("local")).otherwise(decl)).drop("local", "decl")
    rows = rows.withColumn("what", F.when(F.col("code") & (F.col("head.what") != "variable"), None).otherwise(F.col("head.what"))).withColumn("fn", F.when(F.col("code"), F.col("caller")))

    head, c = F.col("head"), {"fact_type": "string", "line": "bigint", "subject": "string", "predicate": "string", "object": "string", "detail": "string", "kind": "string", "receiver": "string", "argc": "int", "type": "string", "args": "array<string>"}

    def fact(of_kind: str, subject: Column, predicate: str | Column, obj: Column, **more: Column) -> Column:
        known = {"fact_type": F.lit(of_kind), "line": F.col("line"), "subject": subject, "predicate": F.lit(predicate) if isinstance(predicate, str) else predicate, "object": obj, **more}
        return F.struct(*(known.get(name, F.lit(None)).cast(of).alias(name) for name, of in c.items()))

    def only(condition: Column, found: Column) -> Column:
        return F.when(condition, found).otherwise(F.array())

    places, held = (F.regexp_extract_all("text", F.lit(_ASSIGNS), F.lit(i)) for i in (1, 2))
    assigned = F.zip_with(places, held, lambda a, b: F.struct(F.regexp_replace(a, r"\s+", "").alias("place"), b.alias("name")))
    table = F.regexp_extract("before", _TABLE, 1)
    entries = F.transform(F.split("text", ","), lambda e, i: F.struct(F.coalesce(F.nullif(F.regexp_extract(e, _ENTRY, 1), F.lit("")), i.cast("string")).alias("field"), F.regexp_extract(e, _ENTRY, 2).alias("name")))
    opened = F.col("before") != ""

    # All that a statement says, in one row; then a row for each.
    arity = F.size(head["params"])
    said = [
        only(F.col("what") == "function", F.array(fact("symbol", F.col("qualified"), head["kind"], F.lit("function"), detail=arity, kind=head["kind"], argc=arity, type=head["type"]))),
        only((F.col("what") == "function") & (head["kind"] == "definition"), F.transform(F.filter(head["params"], lambda x: x["name"].isNotNull()), lambda x: fact("binding", F.col("qualified"), "declares", x["name"], type=x["type"]))),
        only(F.col("what") == "type", F.array(fact("type", F.col("qualified"), "defines", head["kind"]))),
        only((F.col("what") == "type") & head["type"].isNotNull(), F.transform(F.split(head["type"], ","), lambda x: fact("inherits", F.col("qualified"), "inherits", x))),
        only(F.col("what") == "alias", F.array(fact("alias", F.col("qualified"), "aliases", head["type"]))),
        only((F.col("what") == "variable") & ~F.col("code") & (F.col("ns") != ""), F.array(fact("field", F.col("ns"), "has_field", head["name"], type=head["type"]))),
        only((F.col("what") == "variable") & F.col("code") & F.col("fn").isNotNull(), F.array(fact("binding", F.col("fn"), "declares", head["name"], type=head["type"]))),
        only(F.col("code") & F.col("fn").isNotNull() & head["inner"].isNotNull(), F.transform(head["inner"], lambda x: fact("binding", F.col("fn"), "declares", x["name"], type=x["type"]))),
        only(F.size("called") > 0, F.transform("called", lambda x: fact("call", F.col("caller"), "calls", x["name"], line=F.col("base") + x["skip"], detail=F.nullif(F.col("ns"), F.lit("")), kind=x["kind"], receiver=x["receiver"], argc=x["argc"], args=x["args"]))),
        only(F.col("fn").isNotNull() & F.contains("text", F.lit("=")), F.transform(F.filter(assigned, lambda x: ~x["name"].isin(_VALUES)), lambda x: fact("assign", F.col("fn"), "assigns", x["name"], receiver=x["place"]))),
        only(opened & (table != ""), F.transform(F.filter(entries, lambda x: (x["name"] != "") & ~x["name"].isin(_VALUES)), lambda x: fact("table_entry", F.concat(table, F.lit("."), x["field"]), "holds", x["name"]))),
    ]
    told = rows.select("path", "base", "states", F.explode(F.flatten(F.array(*said))).alias("f")).select("path", "base", "states", "f.*")
    told = told.withColumn("build_status", _state(F.substring("states", F.col("line") - F.col("base") + 1, F.lit(1))))
    blank_ = [F.lit(None).cast(of).alias(name) for name, of in list(c.items())[6:]]
    includes = include.select(F.lit("include").alias("fact_type"), "path", F.col("line_no").cast("long").alias("line"), F.col("path").alias("subject"), F.lit("includes").alias("predicate"), F.col("target").alias("object"), "build_status", F.lit(None).cast("string").alias("detail"), *blank_)
    guards_ = guard.select(F.lit("build_guard").alias("fact_type"), "path", F.col("line").cast("long").alias("line"), F.concat_ws(" ", "directive", "expression").alias("subject"), F.lit("guards").alias("predicate"), F.concat_ws("-", "first", "last").alias("object"), F.col("status").alias("build_status"), F.col("reason").alias("detail"), *blank_)
    return told.select(*guards_.columns).unionByName(includes).unionByName(guards_)


def macro_map(values: dict[str, str]) -> Column:
    """Build settings as a map column; they are settings, so few."""
    return F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)) if values else F.expr("map('', '')")
