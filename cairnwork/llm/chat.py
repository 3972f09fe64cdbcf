"""Chat formatting by quotation linking.

Messages are split into what their author wrote and what they quote (lines that begin with ``>``, as deep as
there are such signs). Quoted passages of every level are re-flowed, normalised and hashed sentence by sentence, and
meet the sentences of all earlier messages of the conversation. At each level, the message that most of the passages
come from (of equals the last) is their origin; that of the outermost level with an origin is the one answered. A
message without one answers the one before it. The reply tree, walked in preorder, gives each message its place, and
quotes are left out of the text.

A conversation may hold a third of all rows: the messages of a sentence are dealt over tasks in blocks, the
message before is found in windows over blocks of turns, and the walk is list ranking by pointer doubling, so no task
holds a conversation. Texts are written once as they are parsed, and joined once, to the finished places.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_heavy, utf8, written

#: Turns per block of the windows.
BLOCK = 1024
#: What stands for a null turn, before all others.
LEAST = -(1 << 62)
_QUOTE = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)(.*)$")
#: How lines that announce a quote end.
_ANNOUNCES = re.compile(r"(?:\bwrote|\bwrites|\bsaid|\bschrieb|\ba écrit|\bescribió)\s*:\s*$", re.I)
_SENTENCE = re.compile(r"[^.!?]+[.!?]*")
_WORD = re.compile(r"\w+")


def _sentences(lines: list[str]) -> list[int]:
    out = []
    for paragraph in re.split(r"\n\s*\n", "\n".join(lines)):
        for sentence in _SENTENCE.findall(" ".join(paragraph.split())):
            words = _WORD.findall(sentence.lower())
            if words:
                out.append(xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63))
    return out


def parse_message(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """What the author wrote, its sentences' hashes, and (level, hash) of every quoted sentence."""
    own: list[str] = []
    quoted: list[tuple[int, int]] = []
    level, run = 0, []

    def end_run() -> None:
        if level:
            quoted.extend((level, h) for h in _sentences(run))
        run.clear()

    for line in text.split("\n"):
        found = _QUOTE.match(line)
        now = found[1].count(">") if found else 0
        if now != level:
            end_run()
            if now and not level:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ANNOUNCES.search(own[-1]):
                    own.pop()
            level = now
        if now:
            run.append(found[2])
        else:
            own.append(line)
    end_run()
    kept = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip() if quoted or len(own) < text.count("\n") + 1 else text
    return kept, _sentences(own), quoted


def _parsed(messages: DataFrame, conv_type: str) -> DataFrame:
    """conv, c (conversation), at (turn), key, turn, role, own, sentences, quotes of every row."""
    names = ["conv", "c", "at", "key", "turn", "role", "own", "sentences", "quotes"]
    kind = pa.list_(pa.struct([("level", pa.int32()), ("sentence", pa.int64())]))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_message(t.decode("utf-8", "replace")) for t in utf8(batch.column(6))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([[{"level": a, "sentence": b} for a, b in x[2]] for x in found], kind)], names)

    return messages.mapInArrow(parse, f"conv {conv_type}, c long, at long, key long, turn long, role string, own string, sentences array<long>, quotes array<struct<level:int,sentence:long>>")


def messages_of(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The parsed rows as a table in the shared folder. Null turns come first, null conversations are one."""
    conv, turn, text = F.col(conv_col), F.col(turn_col).cast("long"), F.col(text_col)
    role = F.col(role_col).cast("string")
    c = F.xxhash64(conv.cast("string"), conv.isNull())
    rows = messages.select(conv.alias("conv"), c.alias("c"), F.coalesce(turn, F.lit(LEAST)).alias("at"), F.xxhash64(turn, role, text, F.lit(1)).alias("key"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    return written(_parsed(rows, messages.schema[conv_col].dataType.simpleString()), "messages")


def _before(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """``out``: the last non-null ``value`` of the rows before each in (turn, key) order, within ``keys``.

    Windows span a block of turns; a block that has none before takes it from the blocks before.
    """
    rows = rows.withColumn("__block", F.floor(F.col("turn") / BLOCK)).withColumn("__value", value)
    near = Window.partitionBy(*keys, "__block").orderBy("turn", "key", "probe").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "__block").agg(F.max(F.when(F.col("__value").isNotNull(), F.struct("turn", "key", "__value"))).alias("__last"))
    far = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__far", F.last("__last", ignorenulls=True).over(far)["__value"]).drop("__last")
    joined = rows.withColumn("__near", F.last("__value", ignorenulls=True).over(near)).join(blocks, [*keys, "__block"])
    return joined.withColumn(out, F.coalesce("__near", "__far")).drop("__near", "__far", "__value", "__block")


def _linked(parsed: DataFrame) -> DataFrame:
    """A row per distinct message: c, turn, key, n_rows, parent, linked, origins."""
    base = cut(parsed.groupBy("c", F.col("at").alias("turn"), "key").agg(F.count(F.lit(1)).alias("n_rows")))
    previous = _before(base.withColumn("probe", F.lit(0)), ["c"], F.struct("turn", "key"), "previous").drop("probe")
    asked = parsed.select("c", F.col("at").alias("turn"), "key", F.inline(F.array_distinct(F.transform("quotes", lambda q: F.struct(q["level"].alias("level"), q["sentence"].alias("sentence"), F.size(F.filter("quotes", lambda r: r == q)).alias("weight"))))))
    asked = cut(asked.distinct())
    at = ["c", "turn", "key"]
    if asked.isEmpty():
        none = F.array().cast("array<struct<level:int,turn:bigint,passages:bigint>>")
        return previous.select(*at, "n_rows", F.col("previous").alias("parent"), F.lit(False).alias("linked"), none.alias("origins"))
    written_ = parsed.select("c", F.explode(F.array_distinct("sentences")).alias("sentence"), F.struct(F.col("at").alias("turn"), "key").alias("source"))
    written_ = cut(written_.join(asked.select("c", "sentence").distinct(), ["c", "sentence"], "left_semi").distinct())
    # Messages that have a common sentence are dealt over as many parts as BLOCK asks for.
    parts = written_.groupBy("c", "sentence").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = written_.join(parts, ["c", "sentence"]).select("c", "sentence", F.pmod(F.xxhash64("source"), "parts").cast("int").alias("part"), "source")
    asked = asked.join(parts, ["c", "sentence"]).select(*at, "level", "sentence", "weight", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = asked.join(dealt, ["c", "sentence", "part"]).filter(F.col("source") < F.struct("turn", "key"))
    votes = met.groupBy(*at, "level", "source").agg(F.sum("weight").alias("votes"))
    levels = votes.groupBy(*at, "level").agg(F.max(F.struct("votes", "source")).alias("best"))
    linked = levels.groupBy(*at).agg(F.min_by("best", "level")["source"].alias("source"), F.array_sort(F.collect_list(F.struct("level", F.nullif(F.col("best.source.turn"), F.lit(LEAST)).alias("turn"), F.col("best.votes").alias("passages")))).alias("origins"))
    none = F.array().cast(linked.schema["origins"].dataType)
    return previous.join(cut(linked), at, "left").select(*at, "n_rows", F.coalesce("source", "previous").alias("parent"), F.col("source").isNotNull().alias("linked"), F.coalesce("origins", none).alias("origins"))


def link_replies(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct message: c (a hash of the conversation), turn, key, n_rows, parent, linked, origins.

    ``parent`` is struct(turn, key) of the message answered (null for a conversation's first), ``linked``
    whether a quotation says so; ``origins`` has level, turn and passages for each level of quotes that was found.
    Rows that repeat whole are one message, ``n_rows`` of them. Null texts are empty and quote nothing.
    """
    return _linked(messages_of(messages, conv_col, turn_col, role_col, text_col))


def _jump(state: DataFrame, done: str, most_rounds: int = 64) -> DataFrame:
    """Follow ``to`` of nodes until each is done: value is that of where it ends.

    state: c, key, to (key or null), value, steps. A node is done when ``to`` is null.
    """
    names = ["c", "key", "to", "value", "steps"]
    state = cut(state.select(*names))
    settled, moving = [state.filter("to is null")], state.filter("to is not null")
    for _ in range(most_rounds):
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        # Only nodes that are still under way are joined, with where they are now.
        places = reduce(DataFrame.unionByName, settled, moving)
        ahead = places.select("c", F.col("key").alias("to"), F.col("to").alias("to2"), F.col("value").alias("value2"), F.col("steps").alias("steps2"))
        moved = cut(moving.join(ahead, ["c", "to"], "left").select("c", "key", F.col("to2").alias("to"), F.coalesce("value2", "value").alias("value"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")))
        settled.append(moved.filter("to is null"))
        if len(settled) == 5:  # so that plans stay small
            settled = [cut(reduce(DataFrame.unionByName, settled))]
        moving = moved.filter("to is not null")
    raise RuntimeError(f"{done}: not settled after {most_rounds} rounds")


def reply_order(linked: DataFrame) -> DataFrame:
    """``linked`` with ``position``: the place, from 0, in the preorder walk of the conversation's reply tree."""
    linked = cut(linked)
    nodes = linked.select("c", "turn", "key", F.col("parent.key").alias("parent"))
    replies = nodes.filter("parent is not null")
    first = replies.groupBy("c", "parent").agg(F.min(F.struct("turn", "key"))["key"].alias("child"))
    # The next sibling is the one before in the reversed order.
    back = replies.select("c", "parent", (-F.col("turn")).alias("turn"), F.bitwise_not("key").alias("key"), F.lit(0).alias("probe"), F.col("key").alias("real"))
    sibling = _before(back, ["c", "parent"], F.col("real"), "sibling").select("c", F.col("real").alias("key"), "sibling")
    known = cut(nodes.join(first.withColumnRenamed("parent", "key"), ["c", "key"], "left").join(sibling, ["c", "key"], "left"))
    # Beyond its subtree, a node goes on to its next sibling, or to where its parent goes on.
    beyond = _jump(known.select("c", "key", F.when(F.col("sibling").isNull(), F.col("parent")).alias("to"), F.col("sibling").alias("value"), F.lit(0).alias("steps")), "reply_order")
    onward = known.join(beyond.select("c", "key", "value"), ["c", "key"]).select("c", "key", F.coalesce("child", "value").alias("to"), F.lit(None).cast("long").alias("value"), F.lit(1).alias("steps"))
    ranks = cut(_jump(onward, "reply_order").select("c", "key", "steps"))
    total = ranks.groupBy("c").agg(F.max("steps").alias("total"), F.count(F.lit(1)).alias("n"))
    placed = join_heavy(ranks, total, ["c"], "n").select("c", "key", (F.col("total") - F.col("steps")).cast("long").alias("position"))
    return linked.join(placed, ["c", "key"])


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct message: conv, turn, role, text, parent_turn, linked, origins, position, n_quotes, n_rows, chat.

    A conversation's text is ``chat`` of its messages by position. A null role is written ``unknown``.
    """
    turn_type = messages.schema[turn_col].dataType
    parsed = messages_of(messages, conv_col, turn_col, role_col, text_col)
    placed = reply_order(_linked(parsed)).drop("turn")
    # Rows that repeat are one message; they are where the join has brought them.
    rows = parsed.join(placed, ["c", "key"]).dropDuplicates(["c", "key"])
    return rows.select(
        F.col("conv").alias(conv_col), F.col("turn").cast(turn_type).alias(turn_col), F.col("role").alias(role_col), F.col("own").alias(text_col),
        F.nullif(F.col("parent.turn"), F.lit(LEAST)).cast(turn_type).alias("parent_turn"), "linked", "origins", "position", F.size("quotes").alias("n_quotes"), "n_rows",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "own", F.lit("\n<|end|>\n")).alias("chat"),
    )


def conversations(chats: DataFrame, most: int = 512, conv_col: str = "conv_id") -> DataFrame:
    """conv, part, text: the conversations in reply order, ``most`` messages a part, so that none is gathered whole."""
    part = F.floor(F.col("position") / most).alias("part")
    listed = chats.groupBy(conv_col, part).agg(F.array_sort(F.collect_list(F.struct("position", "chat"))).alias("x"))
    return listed.select(conv_col, "part", F.array_join(F.transform("x", lambda m: m["chat"]), "").alias("text"))
