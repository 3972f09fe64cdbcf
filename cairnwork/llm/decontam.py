"""Benchmark decontamination as a prefix-filtered set join.

Every run of ``window`` words of a benchmark item (a whole item, if shorter) is a set of word
shingles. A document contains the window only if it has all of the set, so the necessary prefix
under any order is one shingle; the order is rarity in the corpus, so that the fewest documents are
met. Document shingles meet prefix shingles in a join; positional bounds (room for what precedes
the shingle in the window) and length bounds (room for what follows) cut candidates, and the words
of the window are then compared one by one.

The benchmark's shingles reach the document scan in blocks of at most ``block`` hashes (8 MB), one
scan of the corpus per block, so a benchmark of any size works and none is broadcast whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, utf8
from .words import shingles, words_of

SLICE_BYTES = 1 << 20
#: Tasks over which the places of one shingle are dealt.
SALTS = 8
_WINDOWS = "item_id string, size int, words array<string>, shingle array<long>"


def benchmark_windows(items: DataFrame, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, size, words and shingle hashes of every window of every item."""

    def cut_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            rows: list[tuple] = []
            for item, text in zip(ids, texts, strict=True):
                found = words_of([text])
                n = len(found.hashes)
                size = min(n, window)
                if not size:
                    continue
                each = min(k, size)
                hashes = shingles(found, each)[0].view(np.int64)
                every = found.text(0, n)
                for at in range(n - size + 1):
                    rows.append((item, size, every[at : at + size], hashes[at : at + size - each + 1].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], ["item_id", "size", "words", "shingle"])

    return items.select(F.col(id_col).cast("string"), text_col).mapInArrow(cut_items, _WINDOWS)


def _body(text: Column) -> tuple[Column, Column]:
    """A hash of the text and its size in bytes: with the id, they tell rows apart."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("body"), F.octet_length(text).alias("bytes")


def _counts(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """In how many documents each wanted shingle is: shingle, docs (one row per task at most)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(wanted), np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for begin, end in slices(texts, SLICE_BYTES):
                found = words_of(texts[begin:end])
                owner = np.repeat(np.arange(end - begin), found.counts)
                for k in sizes:
                    hashes, valid = shingles(found, k)
                    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    hit = np.flatnonzero(valid & (wanted[at] == hashes))
                    if len(hit):
                        pairs = np.unique(owner[hit] * np.int64(len(wanted)) + at[hit])
                        np.add.at(seen, pairs % len(wanted), 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(seen[some])], ["shingle", "docs"])

    return docs.mapInArrow(count, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))


def _occurrences(docs: DataFrame, id_type: str, wanted: np.ndarray, sizes: list[int], before: int, after: int) -> DataFrame:
    """A row per row of ``docs`` (at null), and one per place of a wanted shingle with the words around it.

    docs: id, the text, two numbers that tell texts of one id apart.
    """
    schema = f"doc {id_type}, body long, bytes int, n_words long, shingle long, at long, lead int, around array<string>"

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for begin, end in slices(texts, SLICE_BYTES):
                found = words_of(texts[begin:end])
                owner = np.repeat(np.arange(end - begin), found.counts)
                docs_at, hashes_at, places, leads, around = [], [], [], [], []
                for k in sizes if len(wanted) else []:
                    hashes, valid = shingles(found, k)
                    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    for i in np.flatnonzero(valid & (wanted[at] == hashes)).tolist():
                        d = int(owner[i])
                        low, high = int(found.first[d]), int(found.first[d + 1])
                        docs_at.append(begin + d)
                        hashes_at.append(hashes[i])
                        places.append(i - low)
                        leads.append(min(before, i - low))
                        around.append(found.text(max(low, i - before), min(high, i + after)))
                n, counts = end - begin, found.counts
                rows = np.concatenate((np.arange(begin, end), np.asarray(docs_at, np.int64)))
                # A document's own row takes a key of its own, so that these rows spread.
                keys = np.concatenate((rows[:n].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + counts.view(np.uint64), np.asarray(hashes_at, np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(rows)) for c in (ids, batch.column(2), batch.column(3))), pa.array(counts[rows - begin]), pa.array(keys.view(np.int64)), pa.array([None] * n + places, pa.int64()), pa.array([None] * n + leads, pa.int32()), pa.array([None] * n + around, pa.list_(pa.string()))],
                    ["doc", "body", "bytes", "n_words", "shingle", "at", "lead", "around"],
                )

    return docs.mapInArrow(find, schema)


def judge(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = 1 << 20) -> DataFrame:
    """A row per id and text: doc, body, bytes (which tell texts apart), n_words, n_hit, n_items, items (sorted), contaminated, copies.

    Texts are lower-cased (A-Z). Null and empty texts have no words and are never hit; items without words have no
    windows; a null item_id is left out of ``items``, though its windows count. ids may repeat or be null: each row
    is judged by its own text; ``copies`` rows have that id and text. No items: nothing is hit.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    windows = cut(benchmark_windows(items, window, k, item_col, item_text_col))
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(k))).distinct().collect())
    keys = windows.select(F.explode("shingle").alias("shingle")).distinct()
    blocks = max(1, -(-keys.count() // block))
    texts = docs.select(F.col(text_col))
    counted = None
    for b in range(blocks):
        part = keys.filter(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b)
        wanted = np.sort(np.asarray(part.toArrow().column(0)).view(np.uint64)) if sizes else np.zeros(0, np.uint64)
        if len(wanted):
            own = _counts(texts, wanted, sizes)
            counted = own if counted is None else counted.unionByName(own)
    ranked = windows.dropDuplicates(["item_id", "words"])
    if counted is None:
        prefixes = ranked.select("item_id", "size", "words", F.element_at("shingle", 1).alias("shingle"), F.lit(0).alias("lies"))
    else:
        every = ranked.select("item_id", "size", "words", F.posexplode("shingle").alias("lies", "shingle"))
        rare = every.join(counted, "shingle").groupBy("item_id", "size", "words").agg(F.min_by(F.struct("shingle", "lies"), F.struct("docs", "lies")).alias("rarest"), F.count(F.lit(1)).alias("present"))
        # A shingle that no document has makes its window impossible.
        prefixes = rare.filter(F.col("present") == F.col("size") - F.least("size", F.lit(k)) + 1).select("item_id", "size", "words", "rarest.shingle", "rarest.lies")
    prefixes = cut(prefixes)
    needed = prefixes.select("shingle").distinct()
    blocks = max(1, -(-needed.count() // block))
    out = None
    for b in range(blocks):
        part = needed.filter(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b)
        wanted = np.sort(np.asarray(part.toArrow().column(0)).view(np.uint64))
        met = _occurrences(docs.select(id_col, text_col, *_body(F.col(text_col))), id_type, wanted, sizes, window - min(k, window), window)
        out = met if out is None else out.unionByName(met.filter("at is not null"))
    begins = F.col("at") - F.col("lies")
    fits = (F.col("at") >= F.col("lies")) & (F.col("n_words") - F.col("at") >= F.col("size") - F.col("lies"))
    same = F.expr("slice(around, lead - lies + 1, size)") == F.col("words")
    # A line that many documents share is one shingle: its places are dealt over SALTS tasks. A benchmark is small.
    salted = prefixes.select(F.col("shingle").alias("prefix"), "item_id", "size", "words", "lies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    mine = (F.col("shingle") == F.col("prefix")) & (F.pmod(F.xxhash64("doc", "body", "at"), F.lit(SALTS)) == F.col("part"))
    row = ["doc", "body", "bytes"]
    # One pass over the texts gives both: rows of documents, which meet nothing, and the places that hold a window.
    joined = (
        out.join(salted, mine & fits & F.expr("lead >= lies") & same, "left")
        .filter("at is null or words is not null")
        .groupBy(*row, "item_id", F.when(F.col("at").isNotNull(), begins).alias("begin"), F.when(F.col("at").isNotNull(), begins + F.col("size")).alias("end"))
        .agg(F.max("n_words").alias("n_words"), F.count_if(F.col("at").isNull()).alias("copies"))
    )
    # Words in any window: of each window, what lies beyond the farthest end so far. The windows of one
    # document are as many as its words and items allow; rows of equal id and text are one until the end.
    so_far = F.max("end").over(Window.partitionBy(*row).orderBy("begin", "end", "item_id").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("end").isNotNull(), F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(so_far, F.lit(0)))))
    judged = (
        joined.withColumn("fresh", fresh)
        .groupBy(*row)
        .agg(F.max("n_words").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"), F.max("copies").alias("copies"))
        .select(*row, F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "copies")
    )
    return judged


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items (sorted), contaminated. See ``judge``."""
    judged = judge(docs, items, id_col=id_col, **how).withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return judged.select(F.col("doc").alias(id_col), "n_words", "n_hit", "n_items", "items", "contaminated")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, all columns. Rows are matched by id and text."""
    body, size = _body(F.col(text_col))
    hit = judge(docs, items, id_col=id_col, text_col=text_col, **how).filter("contaminated").select(F.col("doc").alias("__doc"), F.col("body").alias("__b"), F.col("bytes").alias("__s"))
    # As columns, so that each text is hashed once.
    keyed = docs.withColumns({"__body": body, "__bytes": size})
    return keyed.join(hit, keyed[id_col].eqNullSafe(F.col("__doc")) & (F.col("__body") == F.col("__b")) & (F.col("__bytes") == F.col("__s")), "left_anti").drop("__body", "__bytes")
