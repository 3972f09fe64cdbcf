"""Questions about code, many at once: what each asks for, the facts that answer it, what stays open, and what an answer may not say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, resolve, tables
from . import evidence

#: What a question asks for, tried in this order. Each has alternatives; one holds if every group of words in
#: it has a word that the question, in small letters, contains.
INTENTS = [
    ("ui_resource_command_binding", [
        [["resource", "accelerator", "toolbar", "menu"], ["command", "id", "binding", "対応", "つなが"]],
        [["リソース", "アクセラレータ", "ツールバー", "メニュー"], ["command", "コマンド", "対応", "id"]],
    ]),
    ("extension_execution", [
        [["plugin", "macro", "external", "extension"], ["execute", "execution", "path", "route", "command"]],
        [["プラグイン", "マクロ", "外部"], ["実行", "経路", "どう", "command", "コマンド"]],
    ]),
    ("windows_message_dialog", [
        [["windows"], ["message", "dialog", "callback"]], [["wm_command", "wm_initdialog", "dlgproc", "dialog callback"]],
        [["メッセージ"], ["dialog", "ダイアログ", "callback", "コールバック"]], [["ダイアログ"], ["コールバック", "メッセージ", "どう"]],
    ]),
    ("config_profile_io", [[["設定"], ["読み", "書", "保存", "ロード", "どう"]], [["csharedata", "commonsetting", "profile", "ini"]]]),
    ("file_loading_encoding", [[["ファイル"], ["読み", "ロード", "開", "どう"]], [["文字コード", "encoding", "file loading"]]]),
    ("undo_edit_execution", [[["undo", "redo", "アンドゥ", "リドゥ", "元に戻", "やり直"], ["編集", "edit", "operation", "追跡", "どう"]]]),
    ("search_execution", [[["検索"], ["実行", "どう"]], [["how is search executed"]]]),
    ("tinyusb_descriptor_trace", [[["descriptor", "ディスクリプタ"], ["tinyusb", "cdc", "msc", "hid"]]]),
    ("tinyusb_device_event_queue_trace", [[["dcd_event_handler"], ["tud_task"]], [["event", "イベント"], ["queue", "キュー"], ["tinyusb"]]]),
    ("tinyusb_endpoint_xfer_dispatch_trace", [[["xfer_cb", "dispatch", "ディスパッチ"], ["endpoint", "transfer", "転送", "完了"]]]),
    ("call_path", [[["到達", "path", "最終的"]]]),
    ("callers", [[["呼ばれる", "caller", "called from"]]]),
    ("callees", [[["呼ぶ", "callee", "calls"]]]),
    ("definition", [[["定義", "definition"]]]),
]
#: Words of a question that are no symbols.
STOP_WORDS = ["where", "call", "called", "from", "function", "path"]
#: Questions that ask the same and meet their facts in one task.
PER_BUCKET = 1000
#: What an answer may not say while something is open, by its type.
CONSTRAINTS = {
    "call_graph_incomplete": "That no path or caller was found does not show that there is none.",
    "definition_not_found": "Do not say where the symbol is defined.",
    "ambiguous_symbol": "Ask which symbol is meant.",
    "low_confidence_retrieval": "Say that nothing relevant was found.",
    "conditional_build_evidence": "Some facts hold only under conditions that the build's settings do not decide.",
    "inactive_build_evidence": "The definition found is not part of the target build.",
}


def intent(question: Column) -> Column:
    """The first of ``INTENTS`` that fits, else ``evidence``; so for a null question."""
    low = F.lower(F.coalesce(question, F.lit("")))
    out = F.lit("evidence")
    for name, ways in reversed(INTENTS):
        fits = F.lit(False)
        for groups in ways:
            every = F.lit(True)
            for words in groups:
                some = F.lit(False)
                for word in words:
                    some = some | low.contains(word)
                every = every & some
            fits = fits | every
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def symbols(question: Column) -> Column:
    """The names in a question, in order, without stop words."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"(?U)([A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)"), F.lit(1))
    return F.filter(found, lambda n: ~n.isin(STOP_WORDS))


def asked(questions: DataFrame, key: str, text: str) -> DataFrame:
    """key, mode, symbol (the first name) and, of a call path, goal (the last name, if there are two)."""
    named = questions.select(F.col(key), intent(F.col(text)).alias("mode"), symbols(F.col(text)).alias("n"))
    goal = F.when((F.col("mode") == "call_path") & (F.size("n") > 1), F.element_at("n", -1))
    return named.select(key, "mode", F.get("n", F.lit(0)).alias("symbol"), goal.alias("goal"))


def answers(questions: DataFrame, key: str, text: str, facts: DataFrame) -> DataFrame:
    """key, mode, kind, path, line, subject, object, build_status of every fact that answers a question.

    kind: call, definition, call_path (subject and object its ends, path the route, line its hops). Callers and callees
    are calls that are not inactive; a definition may be inactive only if no other is known. A call path is one of the
    shortest over resolved calls (or names as called, where nothing is known of the target) between all symbols that the
    ends may mean; it is conditional if one of its hops is. Questions join facts on suffixes of names, so common names are no pairs beyond their matches. Other
    modes have no facts here.
    """
    # What is asked the same is answered once. Many that ask for a common name are dealt to buckets, and each bucket gets its
    # own copy of the facts, so that no task pairs all of the ones with all of the others.
    want = tables.stored(asked(questions, key, text).select("*", _kind_id(), F.xxhash64(F.monotonically_increasing_id()).alias("row")))
    kinds = tables.cut(want.groupBy("kind_id", "mode", "symbol", "goal").agg(F.ceil(F.count(F.lit(1)) / PER_BUCKET).alias("buckets")))
    size = kinds.select("kind_id", "buckets")
    dealt = want.join(size, "kind_id").select("kind_id", F.pmod("row", "buckets").alias("bucket"), key)
    found = _answers(kinds.drop("buckets"), "kind_id", facts)
    copied = found.join(size, "kind_id").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).drop("buckets")
    return dealt.join(copied, ["kind_id", "bucket"]).select(key, *(c for c in found.columns if c != "kind_id"))


def _kind_id() -> Column:
    """What a question asks for, as one value."""
    return F.sha1(F.to_json(F.struct("mode", "symbol", "goal"))).alias("kind_id")


def _answers(want: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """``answers`` of what is ``asked``."""
    facts = tables.stored(facts, "fact_type")
    calls = facts.filter("fact_type = 'call' and build_status <> 'inactive'").select(F.lit("call").alias("kind"), "path", "line", "subject", "object", "build_status")
    defined = facts.filter("fact_type = 'symbol' and predicate = 'definition'").select(F.lit("definition").alias("kind"), "path", "line", "subject", F.lit(None).cast("string").alias("object"), "build_status")
    of = lambda *modes: want.filter(F.col("mode").isin(*modes) & F.col("symbol").isNotNull())
    out = resolve.by_suffix(of("callers", "evidence"), "symbol", calls, "object").unionByName(resolve.by_suffix(of("callees"), "symbol", calls, "subject"))
    found = resolve.by_suffix(of("definition", "evidence"), "symbol", defined, "subject")
    live = found.filter("build_status <> 'inactive'")
    rest = found.filter("build_status = 'inactive' and mode = 'definition'").join(live.select(F.col(key).alias("__k")).distinct(), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    out = out.unionByName(live).unionByName(rest)

    hops = evidence.edges(facts).filter("build_status <> 'inactive'").select(F.col("caller").alias("src"), F.coalesce("resolved", "callee").alias("dst"), "build_status")
    # A hop is sure if one of its calls is.
    hops = tables.cut(hops.groupBy("src", "dst").agg(F.bool_or(F.col("build_status") == "active").alias("sure")))
    ends = want.filter("goal is not null")
    begins = resolve.by_suffix(ends, "symbol", hops.select(F.col("src").alias("start")).distinct(), "start")
    reached = tables.cut(graph.reach(hops, begins.select("start").distinct()))
    met = begins.join(reached.select(F.col("start").alias("s"), "node", F.col("hops").alias("far")), F.col("start") == F.col("s")).filter("far > 0").withColumn("__last", F.col("goal"))
    # Only nodes that the goal's name may mean: suffixes of reached nodes are few per pair of ends.
    met = met.filter((F.col("node") == F.col("goal")) | F.endswith("node", F.concat(F.lit("::"), F.col("goal"))))
    best = met.groupBy(key, "mode", "symbol", "goal").agg(F.min(F.struct("far", "start", "node")).alias("x")).select(key, "mode", "symbol", "goal", "x.*")
    best = tables.cut(best)
    walked = graph.routes(reached, best.select(F.col("start").alias("from"), F.col("node").alias("goal")).distinct()).select(F.col("start").alias("s"), F.col("goal").alias("g"), "route")
    nodes = F.split("route", " > ")
    steps = walked.select("s", "g", F.inline(F.arrays_zip(F.slice(nodes, F.lit(1), F.size(nodes) - 1).alias("src"), F.slice(nodes, 2, F.size(nodes)).alias("dst"))))
    status = F.when(F.bool_and("sure"), "active").otherwise("conditional").alias("worst")
    walked = walked.join(steps.join(hops, ["src", "dst"]).groupBy("s", "g").agg(status), ["s", "g"])
    path = best.join(walked, (F.col("start") == F.col("s")) & (F.col("node") == F.col("g")))
    path = path.select(key, "mode", F.lit("call_path").alias("kind"), F.col("route").alias("path"), F.col("far").cast("long").alias("line"), F.col("start").alias("subject"), F.col("node").alias("object"), F.col("worst").alias("build_status"))
    return out.select(*path.columns).unionByName(path)


def assess(questions: DataFrame, key: str, text: str, answered: DataFrame) -> DataFrame:
    """key, mode, facts, unknowns (sorted), answerability, constraints: one row a question, by the rows of ``answers``.

    answerable: facts and nothing open; partial: facts, but something open; insufficient_evidence: no facts.
    """
    rows = asked(questions, key, text).join(_counted(answered, key), F.col(key).eqNullSafe(F.col("__k")), "left")
    return _assessed(rows, key)


def assess_facts(questions: DataFrame, key: str, text: str, facts: DataFrame) -> DataFrame:
    """``assess`` of the ``answers`` from ``facts``: questions that ask the same are answered once, so that many that ask
    for a common name cost no pairs of question and fact."""
    want = tables.stored(asked(questions, key, text).select("*", _kind_id()))
    kinds = tables.cut(want.select("kind_id", "mode", "symbol", "goal").distinct())
    counted = _counted(_answers(kinds, "kind_id", facts), "kind_id")
    return _assessed(want.join(counted, F.col("kind_id") == F.col("__k"), "left"), key)


def _counted(answered: DataFrame, key: str) -> DataFrame:
    """__k (the key), facts, and how many of them are loose (conditional) and gone (inactive)."""
    return answered.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("build_status") == "conditional").alias("loose"), F.count_if(F.col("build_status") == "inactive").alias("gone"))


def _assessed(rows: DataFrame, key: str) -> DataFrame:
    rows = rows.withColumn("facts", F.coalesce("facts", F.lit(0)))
    none, mode = F.col("facts") == 0, F.col("mode")
    lost = (mode.isin("callers", "callees", "definition") & F.col("symbol").isNull()) | ((mode == "call_path") & F.col("goal").isNull())
    missing = F.when(lost, "ambiguous_symbol").when(mode == "definition", "definition_not_found").when(mode == "evidence", "low_confidence_retrieval").otherwise("call_graph_incomplete")
    open_ = F.array_sort(F.array_compact(F.array(F.when(none, missing), F.when(F.col("loose") > 0, "conditional_build_evidence"), F.when(F.col("gone") > 0, "inactive_build_evidence"))))
    said = F.create_map(*(F.lit(x) for kv in CONSTRAINTS.items() for x in kv))
    level = F.when(none, "insufficient_evidence").when(F.size(open_) == 0, "answerable").otherwise("partial")
    return rows.select(key, "mode", "facts", F.array_join(open_, ",").alias("unknowns"), level.alias("answerability"), F.array_join(F.transform(open_, lambda u: said[u]), " ").alias("constraints"))
