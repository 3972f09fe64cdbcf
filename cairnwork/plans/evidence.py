"""Evidence over facts: resolved call edges, verdicts on claims, prose to verdicts, profiles side by side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph, receivers, resolve, rules, tables, verdicts
from . import ingest

#: Words of a question that tell what is asked, tried in this order.
INTENTS = [("callers", ["who calls", "caller", "called by"]), ("callees", ["what does", "callee", "calls to"]), ("call_path", ["path from", "reach", "how does"]), ("definition", ["where is", "defined", "definition"])]

#: Kinds of claims that ``verify`` can judge.
KINDS = ("calls", "reaches", "includes", "inherits", "definition_exists", "build_active")


def edges(facts: DataFrame) -> DataFrame:
    """caller, callee, resolved, candidates, status, build_status, path, line of every call, against all symbols.

    A call on a receiver of a known type is that type's method, its own or the nearest base's; if classes below the type have it too, it may be any of them.
    """
    facts = tables.stored(facts, "fact_type")  # read in many places below
    symbols = facts.filter("fact_type = 'symbol' and build_status <> 'inactive'").groupBy(F.col("subject").alias("qualified_name"), "argc").agg(F.max(F.col("predicate") == "definition").alias("is_definition"))
    calls = facts.filter("fact_type = 'call'").select("path", "line", "subject", "receiver", "object", "argc", "detail", "build_status", F.expr(f"coalesce({receivers.ON_RECEIVER}, false)").alias("typed")).distinct()
    calls = tables.stored(calls, "typed")
    # Calls without a receiver have nothing to look up.
    found = receivers.typed(calls.filter("typed"), facts).drop("full").unionByName(calls.filter("not typed").withColumns({c: F.lit(None).cast("string") for c in ("type", "holder")}))
    asked = found.select(F.col("detail").alias("caller_ns"), F.concat_ws("::", F.coalesce("holder", "type"), "object").alias("callee"), "argc", F.col("subject").alias("caller"), F.col("object").alias("name"), "path", "line", "build_status", "type")
    asked = tables.stored(asked)  # read for its questions and for their answers
    out = resolve.call_resolution(asked, symbols)
    # Only what a call asks for is collected: a class may have any number of classes below it.
    wanted = asked.filter("type is not null").select(F.col("type").alias("base"), F.col("name").alias("method")).distinct()
    virtual = receivers.overriders(facts).join(wanted, ["base", "method"], "left_semi").groupBy("base", "method").agg(F.array_sort(F.collect_set("candidate")).alias("also"))
    out = out.join(virtual, (F.col("type") == F.col("base")) & (F.col("name") == F.col("method")), "left")
    every = F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(F.split("candidates", ","), F.array().cast("array<string>")), "also"))), ",")
    open_ = F.col("also").isNotNull()
    return out.select(
        "caller", F.col("name").alias("callee"), F.when(~open_, F.col("resolved")).alias("resolved"), F.when(open_, every).otherwise(F.col("candidates")).alias("candidates"),
        F.when(open_, "candidate_set").otherwise(F.col("status")).alias("status"), "build_status", "path", "line",
    )


def _by_name(claims: DataFrame, column: str, facts: DataFrame, name: str) -> DataFrame:
    """Claims with facts whose name is, or ends with, the claim's ``column``: an equi-join on suffixes."""
    return resolve.by_suffix(claims.filter(F.col(column).isNotNull() & (F.col(column) != "")), column, facts.filter(F.col(name).isNotNull()), name)


def _verdict(claims: DataFrame, kind: str, counted: DataFrame, verdict: Column) -> DataFrame:
    """claim columns and verdict; ``counted`` has claim_id and what ``verdict`` reads."""
    own = claims.filter(F.col("claim_type") == kind)
    joined = own.join(counted.withColumnRenamed("claim_id", "__id"), F.col("claim_id") == F.col("__id"), "left")
    return joined.select(*claims.columns, verdict.alias("verdict"))


def verify(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """A verdict for every claim (claim_id, claim_type, subject, object); unknown types stay unknown.

    calls: contradicted only if all outgoing calls of the subject are settled and none is the object.
    reaches: supported over settled edges, conditional over any, never contradicted. includes: contradicted if the
    subject's includes are known and do not name the object. definition_exists and build_active: contradicted
    if the only evidence is inactive. inherits: over any number of steps; contradicted if the class is known without it.
    """
    facts = tables.stored(facts, "fact_type")
    claims = tables.stored(claims)  # read for each kind
    # Kinds that no claim has cost nothing; six names at most come to the driver.
    has = {r[0] for r in claims.filter(F.col("claim_type").isin(*KINDS)).select("claim_type").distinct().collect()}
    result = claims.filter(~F.col("claim_type").isin(*KINDS) | F.col("claim_type").isNull()).withColumn("verdict", F.lit("unknown"))
    if has & {"calls", "reaches"}:
        result = _by_calls(result, claims, facts, has)

    if "includes" in has:
        included = facts.filter("fact_type = 'include' and build_status <> 'inactive'").select(F.col("subject").alias("file"), F.col("object").alias("target"), "build_status")
        keyed = resolve.by_suffix(claims.filter("claim_type = 'includes'"), "subject", included, "file", sep="/")
        named = F.coalesce(names.matches_path(F.col("target"), F.col("object")), F.lit(False))
        counted = keyed.groupBy("claim_id").agg(F.count_if(named).alias("hits"), F.count_if(named & (F.col("build_status") == "active")).alias("sure"), F.count(F.lit(1)).alias("all"))
        result = result.unionByName(_verdict(claims, "includes", counted, F.when(F.col("sure") > 0, "supported").when(F.col("hits") > 0, "conditional").when(F.col("all") > 0, "contradicted").otherwise("unknown")))

    states = ("active", "conditional", "inactive")
    for kind in sorted(has & {"definition_exists", "build_active"}):
        rows = facts.filter("fact_type = 'symbol' and predicate = 'definition'" if kind == "definition_exists" else "fact_type in ('symbol', 'call')")
        # Each name once before its suffixes are taken.
        known = rows.groupBy(F.col("subject").alias("name")).agg(*(F.count_if(F.col("build_status") == s).alias(s) for s in states))
        counted = _by_name(claims.filter(F.col("claim_type") == kind), "subject", known, "name").groupBy("claim_id").agg(*(F.sum(s).alias(s) for s in states))
        result = result.unionByName(_verdict(claims, kind, counted, F.when(F.col("active") > 0, "supported").when(F.col("conditional") > 0, "conditional").when(F.col("inactive") > 0, "contradicted").otherwise("unknown")))
    if "inherits" in has:
        below = facts.filter("fact_type = 'inherits' and build_status <> 'inactive'").select(names.short_name(F.col("subject")).alias("src"), names.short_name(F.col("object")).alias("dst"), "build_status").distinct()
        asked = claims.filter("claim_type = 'inherits'").withColumns({"__src": names.short_name(F.col("subject")), "__dst": names.short_name(F.col("object"))})
        above = graph.reach(below, asked.select(F.col("__src").alias("start"))).filter("hops > 0").select(F.col("start").alias("s"), F.col("node").alias("d"))
        known_class = facts.filter("fact_type = 'type'").select(names.short_name(F.col("subject")).alias("s2")).distinct()
        met = asked.join(above, (F.col("__src") == F.col("s")) & (F.col("__dst") == F.col("d")), "left").join(known_class, F.col("__src") == F.col("s2"), "left")
        counted = met.groupBy("claim_id").agg(F.count("d").alias("hits"), F.count("s2").alias("seen"))
        result = result.unionByName(_verdict(claims, "inherits", counted, F.when(F.col("hits") > 0, "supported").when(F.col("seen") > 0, "contradicted").otherwise("unknown")))
    return result


def _by_calls(result: DataFrame, claims: DataFrame, facts: DataFrame, has: set[str]) -> DataFrame:
    """``result`` with verdicts on claims of the kinds calls and reaches, of those in ``has``."""
    settled = (F.col("status") == "resolved") & (F.col("build_status") == "active")
    call = tables.stored(edges(facts))
    live = call.filter("build_status <> 'inactive'")
    # Suffixes are taken of the callers' names, not of all their calls.
    callers = tables.stored(_by_name(claims.filter(F.col("claim_type").isin("calls", "reaches")), "subject", live.select("caller").distinct(), "caller").select("claim_id", "claim_type", "object", "caller"))
    if "calls" in has:
        result = result.unionByName(_called(claims, callers, live, settled))
    if "reaches" in has:
        result = result.unionByName(_reached(claims, callers, live, settled))
    return result


def _called(claims: DataFrame, callers: DataFrame, live: DataFrame, settled: Column) -> DataFrame:
    out = callers.filter("claim_type = 'calls'").join(live, "caller")
    hit = names.matches_name(F.col("callee"), F.col("object")) | names.matches_name(F.col("resolved"), F.col("object")) | F.exists(F.split("candidates", ","), lambda c: names.matches_name(c, F.col("object")))
    out = out.withColumn("hit", F.coalesce(hit, F.lit(False)))
    counted = out.groupBy("claim_id").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & ~settled).alias("unsure"), F.count_if(~settled).alias("open"))
    by_calls = F.when((F.col("hits") > 0) & (F.col("unsure") == 0), "supported").when(F.col("hits") > 0, "conditional").when(F.col("open") == 0, "contradicted").otherwise("unknown")
    return _verdict(claims, "calls", counted, by_calls)


def _reached(claims: DataFrame, callers: DataFrame, live: DataFrame, settled: Column) -> DataFrame:
    targets = F.array_union(F.coalesce(F.split("candidates", ","), F.array().cast("array<string>")), F.array("resolved", F.when(F.col("candidates").isNull(), F.col("callee"))))
    hops = live.select(F.col("caller").alias("src"), F.explode(F.filter(targets, lambda x: x.isNotNull() & (x != ""))).alias("dst"), settled.alias("firm"))
    hops = tables.stored(hops.groupBy("src", "dst").agg(F.max("firm").alias("firm")))
    walk = callers.filter("claim_type = 'reaches'")
    reached = None
    for firm in (True, False):
        found = graph.reach(hops.filter("firm") if firm else hops, walk.select(F.col("caller").alias("start"))).filter("hops > 0").select("start", "node", F.lit(firm).alias("firm"))
        reached = found if reached is None else reached.unionByName(found)
    met = walk.join(reached, F.col("caller") == F.col("start")).filter(names.matches_name(F.col("node"), F.col("object"))).groupBy("claim_id").agg(F.max("firm").alias("firm"))
    return _verdict(claims, "reaches", met, F.when(F.col("firm"), "supported").when(F.col("firm").isNotNull(), "conditional").otherwise("unknown"))


def verify_text(texts: DataFrame, key: str, text: str, facts: DataFrame) -> DataFrame:
    """key, overall, safety, claims (how many): prose judged by the claims in it; without claims, unknown."""
    # Reading prose takes much longer than moving it, and a small file is one task: it is dealt out first, and read once.
    spread = texts.select(key, text).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    found = rules.claims_of(spread, key, text).withColumn("claim_id", F.sha1(F.concat_ws("\0", key, "place", "subject", "object")))
    judged = verify(found.select(key, "claim_id", "claim_type", "subject", "object", "polarity"), facts)
    judged = judged.withColumn("verdict", F.when(F.col("polarity") == "negative", verdicts.negate(F.col("verdict"))).otherwise(F.col("verdict")))
    rolled = judged.groupBy(F.col(key).alias("__k")).agg(verdicts.overall(F.col("verdict")).alias("overall"), F.count(F.lit(1)).alias("claims"))
    joined = texts.select(key).join(rolled, F.col(key) == F.col("__k"), "left")
    return joined.select(key, F.coalesce("overall", F.lit("unknown")).alias("overall"), F.coalesce("claims", F.lit(0)).alias("claims")).withColumn("safety", verdicts.safety(F.col("overall")))


def profile_matrix(files: DataFrame, profiles: dict[str, dict[str, str]]) -> DataFrame:
    """subject, one status per profile (of its facts), changed. Profiles are settings, a handful of them."""
    rows = None
    for name, macros in sorted(profiles.items()):
        own = ingest.facts(files, ingest.macro_map(macros)).filter("fact_type in ('symbol', 'call')").select("subject", F.concat_ws(" ", "predicate", "object").alias("what"), "build_status").withColumn("profile", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    rank = F.min(F.when(F.col("build_status") == "active", 0).when(F.col("build_status") == "conditional", 1).otherwise(2))
    each = rows.groupBy("subject", "what").pivot("profile", sorted(profiles)).agg(F.element_at(F.array(*map(F.lit, ["active", "conditional", "inactive"])), rank + 1))
    cells = F.array(*(F.coalesce(F.col(p), F.lit("absent")) for p in sorted(profiles)))
    return each.withColumn("changed", F.size(F.array_distinct(cells)) > 1)


def question_mode(question: str) -> tuple[str, list[str]]:
    """What a question asks for, and the names in it."""
    low = question.lower()
    mode = next((m for m, words in INTENTS if any(w in low for w in words)), "evidence")
    return mode, [n for n in re.findall(r"`?([A-Za-z_][A-Za-z0-9_:]*)(?:\(\))?`?", question) if "_" in n or "::" in n or f"{n}(" in question or f"`{n}" in question]


def collect(facts: DataFrame, question: str) -> DataFrame:
    """The facts that answer a question about callers, callees, definitions, or name its symbols."""
    mode, wanted = question_mode(question)
    name = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    live = facts.filter("build_status <> 'inactive'")
    hit = lambda column: F.exists(name, lambda q: names.matches_name(column, q))
    if mode == "callers":
        return live.filter((F.col("fact_type") == "call") & hit(F.col("object")))
    if mode == "callees":
        return live.filter((F.col("fact_type") == "call") & hit(F.col("subject")))
    if mode == "definition":
        return live.filter((F.col("predicate") == "definition") & hit(F.col("subject")))
    return live.filter(hit(F.col("subject")) | hit(F.col("object")))
