"""A verdict for every kind of claim: those of ``evidence.verify``, and claims about relations and about the build's settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import resolve
from . import callbacks, evidence

#: Claim types about relations, and the predicate each asks for.
RELATIONS = {
    "callback_registers": "registers_callback", "stores_callback": "stores_callback", "invokes_callback": "invokes_callback",
    "callback_dataflow": "callback_dataflows_to", "task_entry_dataflow": "task_entry_dataflows_to",
}
#: Claim types about settings; what a context, a status and an allocation may be called.
SETTINGS = ["target_profile", "build_config", "allocation_profile", "file_active"]
CONTEXTS = {"isr": ["isr", "interrupt", "irq"], "task": ["task", "thread"]}
STATES = {"active": ["", "active", "yes", "true"], "inactive": ["inactive", "no", "false"]}
SWITCHES = {"enabled": ["1", "true", "yes", "enabled", "enable", "on"], "disabled": ["0", "false", "no", "disabled", "disable", "off"]}
MODES = {"dynamic": ["dynamic", "malloc", "heap"], "static": ["static"]}


def _called(value: Column, words: dict[str, list[str]]) -> Column:
    """The key whose words have the value; null if none."""
    low = F.trim(F.lower(value))
    return F.coalesce(*(F.when(low.isin(w), key) for key, w in words.items()))


def _short(name: Column) -> Column:
    """Two names match either way if these are equal."""
    return names.short_name(names.head(_plain(name)))


def _plain(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"^\s*&", ""))


def _judged(claims: DataFrame, counted: DataFrame, cases: list[tuple[Column, str, str]], missing: str) -> DataFrame:
    """claims' columns, verdict and reason: of the first case that holds, else unknown for the reason ``missing``."""
    joined = claims.join(counted.withColumnRenamed("claim_id", "__id"), F.col("claim_id") == F.col("__id"), "left")
    picked = F.coalesce(*(F.when(c, F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))) for c, v, r in cases), F.struct(F.lit("unknown").alias("verdict"), F.lit(missing).alias("reason")))
    return joined.withColumn("__v", picked).select(*claims.columns, "__v.verdict", "__v.reason")


def on_relations(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Claims of the types in ``RELATIONS`` and ``execution_context``, by ``callbacks.relations`` and ``callbacks.flows``.

    Handing over, keeping and calling a callback is never proof that it runs, and a task entry runs when the scheduler
    lets it: what is found makes a claim conditional, what is not leaves it unknown. The object may be the name, the
    field or, if stored or invoked, the place. A context is supported, or contradicted by the other one.
    """
    live = found.filter("build_status <> 'inactive'")
    kinds = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    asked = claims.filter(F.col("claim_type").isin(list(RELATIONS))).withColumns({"__did": kinds[F.col("claim_type")], "__s": _short(F.col("subject")), "__o": _short(F.col("object"))})
    ends = F.array("object", F.when(~F.col("predicate").endswith("dataflows_to") & (F.col("predicate") != "registers_callback"), F.col("field")), F.when(F.col("predicate").isin("stores_callback", "invokes_callback"), F.col("place")), F.when(F.col("predicate") == "task_entry_dataflows_to", F.col("place")))
    known = live.filter(F.col("predicate").isin(list(RELATIONS.values()))).select("predicate", _short(F.col("subject")).alias("s"), F.explode(F.array_compact(ends)).alias("e")).select("predicate", "s", _short(F.col("e")).alias("o")).distinct()
    met = asked.join(known, (F.col("__did") == F.col("predicate")) & (F.col("__s") == F.col("s")) & (F.col("__o") == F.col("o"))).groupBy("claim_id").agg(F.count(F.lit(1)).alias("hits"))
    given = (F.col("subject") != "") & (F.col("object") != "")
    out = None
    for kind, predicate in RELATIONS.items():
        name = {"callback_registers": "callback_registration", "callback_dataflow": "callback_dataflow", "task_entry_dataflow": "task_entry_dataflow"}.get(kind, predicate)
        part = _judged(claims.filter(F.col("claim_type") == kind), met, [(F.coalesce(~given, F.lit(True)), "unknown", "claim_missing_endpoint"), (F.col("hits") > 0, "conditional", f"{name}_supported")], f"{name}_not_found")
        out = part if out is None else out.unionByName(part)

    own = claims.filter("claim_type = 'execution_context'")
    wanted = _called(F.col("object"), CONTEXTS)
    seen = live.filter("predicate = 'has_execution_context'").select(_short(F.col("subject")).alias("s"), F.col("object").alias("context"), "build_status")
    met = own.select("claim_id", _short(F.col("subject")).alias("__s"), wanted.alias("__w")).join(seen, F.col("__s") == F.col("s")).groupBy("claim_id").agg(
        F.count_if(F.col("context") == F.col("__w")).alias("hits"), F.count_if((F.col("context") == F.col("__w")) & (F.col("build_status") != "active")).alias("loose"), F.count_if(F.col("context") != F.col("__w")).alias("others"))
    cases = [
        (F.coalesce(~given, F.lit(True)), "unknown", "claim_missing_endpoint"), (wanted.isNull(), "unknown", "unsupported_execution_context"), ((F.col("hits") > 0) & (F.col("loose") == 0), "supported", "execution_context_supported"),
        (F.col("hits") > 0, "conditional", "execution_context_supported"), (F.col("others") > 0, "contradicted", "execution_context_conflict"),
    ]
    return out.unionByName(_judged(own, met, cases, "execution_context_not_found"))


def on_settings(claims: DataFrame, settings: DataFrame, selected: DataFrame) -> DataFrame:
    """Claims of the types in ``SETTINGS``, by settings (``target.settings``) and files with their status (``target.decide``).

    A setting that is there with another value contradicts; one that is not there leaves the claim unknown, unless it is
    an attribute of a known target. Without an object any value will do. Settings are a target's, so few; files are
    joined on the suffixes of their paths, either way.
    """
    any_value = F.coalesce(F.col("object") == "", F.lit(True))
    mode, switch, state = _called(F.regexp_replace("subject", r"(?i)[_ ]allocation$", ""), MODES), _called(F.col("object"), SWITCHES), _called(F.coalesce("object", F.lit("")), STATES)
    of_profile = F.coalesce(F.lower("subject").isin("name", "profile", "target_profile", "selected_profile"), F.lit(True)) & (F.col("claim_type") == "target_profile")
    key = F.when(F.col("claim_type") == "allocation_profile", F.concat(mode, F.lit("_allocation"))).when(of_profile, F.lit("name")).otherwise(F.col("subject"))
    value = F.when(F.col("claim_type") == "allocation_profile", switch).otherwise(F.col("object"))
    asked = claims.filter(F.col("claim_type").isin("target_profile", "build_config", "allocation_profile")).select("claim_id", "claim_type", _short(key).alias("__k"), value.alias("__v"), any_value.alias("__any"))
    asked = asked.withColumn("__own", F.col("__k")).withColumn("__k", F.explode(F.array_distinct(F.array("__k", F.when(F.col("claim_type") == "target_profile", "name").otherwise(F.col("__k"))))))
    rows = settings.select(_short(F.col("subject")).alias("k"), F.col("predicate").alias("p"), F.col("object").alias("v"))
    met = asked.join(rows, (F.col("__k") == F.col("k")) & ((F.col("claim_type") != "build_config") | (F.col("p") == "macro_value")))
    same = F.coalesce((F.col("v") == F.col("__v")) | ((F.col("claim_type") == "target_profile") & (_short(F.col("v")) == _short(F.col("__v")))), F.lit(False)) | (F.col("__any") & (F.col("claim_type") != "allocation_profile"))
    counted = met.groupBy("claim_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(same & (F.col("__k") == F.col("__own"))).alias("hits"))
    hit, other = F.col("hits") > 0, F.col("seen") > 0
    bare = F.coalesce(F.col("subject") == "", F.lit(True))
    parts = [
        ("target_profile", [(hit, "supported", "target_profile_supported"), (other & ~any_value, "contradicted", "target_profile_value_mismatch")], "target_profile_attribute_not_found"),
        ("build_config", [(bare, "unknown", "claim_missing_macro"), (hit & any_value, "supported", "build_config_macro_present"), (hit, "supported", "build_config_macro_value_supported"), (other, "contradicted", "build_config_macro_value_mismatch")], "build_config_macro_not_found"),
        ("allocation_profile", [(mode.isNull(), "unknown", "claim_missing_allocation_mode"), (switch.isNull(), "unknown", "claim_invalid_allocation_state"), (hit, "supported", "allocation_profile_supported"), (other, "contradicted", "allocation_profile_mismatch")], "build_config_macro_not_found"),
    ]
    out = None
    for kind, cases, missing in parts:
        part = _judged(claims.filter(F.col("claim_type") == kind), counted, cases, missing)
        out = part if out is None else out.unionByName(part)

    own = claims.filter("claim_type = 'file_active'")
    slashed = own.filter(~bare).withColumn("subject", F.regexp_replace(F.replace("subject", F.lit("\\"), F.lit("/")), "^/+|/+$", ""))
    files = selected.select(F.col("path").alias("file"), "status")
    longer = slashed.withColumn("__part", F.explode(names.suffixes(F.col("subject"), "/"))).join(files, F.col("__part") == F.col("file")).drop("__part")
    below = resolve.by_suffix(slashed, "subject", files, "file", sep="/").unionByName(longer).distinct()
    counted = below.groupBy("claim_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("status") == state).alias("hits"))
    cases = [(state.isNull(), "unknown", "claim_invalid_file_active_status"), (bare, "unknown", "claim_missing_file_path"), (hit, "supported", "target_file_selection_supported"), (other, "contradicted", "target_file_selection_mismatch")]
    return out.unionByName(_judged(own, counted, cases, "target_file_selection_not_found"))


def verify(claims: DataFrame, facts: DataFrame, settings: DataFrame, selected: DataFrame) -> DataFrame:
    """Claims (claim_id, claim_type, subject, object) of all kinds with verdict and reason (null where ``evidence.verify`` judged)."""
    more = [*RELATIONS, "execution_context", *SETTINGS]
    is_more = F.coalesce(F.col("claim_type").isin(more), F.lit(False))
    found = callbacks.relations(facts)
    basic = evidence.verify(claims.filter(~is_more), facts).withColumn("reason", F.lit(None).cast("string"))
    own = claims.filter(is_more)
    return basic.unionByName(on_relations(own, found.unionByName(callbacks.flows(facts, found)))).unionByName(on_settings(own, settings, selected))
