"""Token ids in Parquet files: list columns, dictionary and delta encoding, small row groups, page indexes.

One row per document in ascending id order: doc_id, shard, local_start, n_tokens, ids. ``ids`` is
dictionary encoded (a chunk has few distinct ids beside its length); the other numbers are delta encoded
(writer version 2, dictionary off). Row groups and pages are of bounded size and Parquet's page index is
written, so readers can fetch single columns, row groups or pages. Files are range partitioned and sorted
by id; ``start`` over the whole corpus is a shard's offset plus local_start. The offsets, one row per shard, lie in
``_offsets`` beside the files, so that a read of some ids reads no other counts.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import byte_characters, slices, utf8

SLICE_BYTES = 1 << 20
#: Bytes of units and ids that a worker remembers in each of two generations (the older one is then dropped), bytes
#: that an entry takes besides, and the longest unit that is remembered: text without spaces is one unit.
REMEMBERED, ENTRY, LONGEST = 64 << 20, 160, 64
#: Unicode's White_Space characters, as a character class; letters of ASCII and Latin-1; ASCII marks.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _MARK = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-/:-@\[-`{-~"
_UNIT = re.compile(f"[{_WHITE}]*[{_LETTER}]+(?=[{_WHITE}{_MARK}]|\\Z)|[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


#: A unit that the pattern keeps whole.
_WORD = re.compile(f" ?[{_LETTER}]+")


class ByteTokens:
    """A byte-level BPE of the tokenizers library that splits texts by its own pattern.

    That pattern joins neither a character that is not white space to white space after it, nor a letter
    to an ASCII mark after it, so a text may be cut there: the units' ids in a row are the ids of the whole
    text. Units repeat, and their ids are remembered. Of new ones, words go straight to the library's model,
    all else through its whole pipeline. A tokenizer of another kind gets whole texts.

    Added tokens in a text get their own ids, and only what is between them is cut; with ``special_as_text``,
    those that are special are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        added = {t.content: (i, t) for i, t in self.lib.get_added_tokens_decoder().items() if t.content and not (special_as_text and t.special)}
        self.added = {content: np.int32(i).tobytes() for content, (i, _) in added.items()}
        # The longest of those that begin at one place, as in the library.
        self.split = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None
        pre = self.lib.pre_tokenizer
        state = pre.__getstate__().decode() if pre is not None else ""
        self.cuts = self.lib.normalizer is None and '"ByteLevel"' in state and '"add_prefix_space":false' in state and '"use_regex":true' in state
        # Tokens that take more than their own characters, or are sought in two passes, are left to the library.
        self.cuts = self.cuts and not any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()) and len({t.normalized for _, t in added.values()}) < 2
        self.model, self.characters = self.lib.model, byte_characters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _learn(self, unit: str) -> bytes:
        ids = self.young.get(unit) or self.old.get(unit)
        if ids is None:
            if _WORD.fullmatch(unit):
                ids = array("i", [t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(self.characters))]).tobytes()
            else:
                ids = self._ids(unit)
        if len(unit) <= LONGEST:
            self.young[unit] = ids
            self.held += ENTRY + 4 * len(unit) + len(ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not self.cuts:
            return np.frombuffer(self._ids(text), np.int32)
        parts = self.split.split(text) if self.split else [text]
        found = []
        for i, part in enumerate(parts):
            found += [self.added[part]] if i % 2 else self._cut(part)
        return np.frombuffer(b"".join(found), np.int32)

    def _cut(self, text: str) -> list[bytes]:
        if self.held > REMEMBERED:
            self.young, self.old, self.held = {}, self.young, 0
        units = _UNIT.findall(text)
        found = list(map(self.young.get, units))
        if None in found:
            found = [self._learn(u) if ids is None else ids for u, ids in zip(units, found, strict=True)]
        return found


@lru_cache(maxsize=4)
def tokens_of(path: str, special_as_text: bool = False) -> ByteTokens:
    return ByteTokens(path, special_as_text)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, files: int | None = None, row_group_bytes: int = 32 << 20, page_rows: int = 512, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = True) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the files to ``path``.

    Rows with a null id come first; rows of one id are ordered by their text. ``special_as_text``: special tokens
    in a text are ordinary text; if false, ids are those of the library with its own settings.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, done = tokens_of(tokenizer_path, special_as_text), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = utf8(batch.column(1))
            for begin, stop in slices(texts, SLICE_BYTES):
                ids = [np.append(own.encode(t.decode("utf-8", "replace")), np.int32(end_id)) for t in texts[begin:stop]]
                ends = np.cumsum([0, *map(len, ids)])
                n = stop - begin
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, n), pa.array(np.full(n, shard, np.int32)), pa.array(ends[:-1] + done), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids)))],
                    ["doc_id", "shard", "local_start", "n_tokens", "ids"],
                )
                done += int(ends[-1])

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(encode, f"doc_id {id_type}, shard int, local_start long, n_tokens int, ids array<int>").write
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": str(1 << 20),
    }
    writer.options(**options).parquet(path)
    # One row per file: a window over them is a small one.
    held = docs.sparkSession.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    held.select("shard", before.alias("offset")).coalesce(1).write.parquet(f"{path}/_offsets")


def read_tokens(spark: SparkSession, path: str, low=None, high=None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the files; only the columns asked for are read.

    ``low`` and ``high`` (either may be None) bound the ids: only row groups and pages that may have such are read.
    """
    rows = spark.read.parquet(path)
    rows = rows if low is None else rows.filter(F.col("doc_id") >= low)
    rows = rows if high is None else rows.filter(F.col("doc_id") <= high)
    # As many rows as files; Spark broadcasts them if they are small.
    offsets = spark.read.parquet(f"{path}/_offsets")
    return rows.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    return pd.Series([zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in ids], dtype="int64")
