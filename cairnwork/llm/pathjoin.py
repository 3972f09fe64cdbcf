"""N-gram Jaccard self-join by chosen paths.

Texts become sets of five-word shingles. A set is embedded as ``COORDS`` min-hash tokens, of which two
sets share a part that is their Jaccard similarity. In each run, a node of a random tree splits its
sets: two coordinates are drawn from the node's own hash, and every set moves on to the two children
that its tokens at those coordinates name. Two sets of similarity s stay together in one child at
least with probability 1 - (1 - s)^2. Nodes of up to ``small`` sets become buckets, and so do
nodes that splitting doesn't thin out (their sets are alike); all pairs of a bucket are compared
exactly. Runs are repeated until the recall at the threshold reaches the target: what ``recall_of`` says, which
takes into account that all runs draw from one embedding.

Texts with equal sets are one class from the start, so copies add no rows to the join. Buckets give no
pairs either: each gives a row per set with its number of links and a hub of its local component. A pair
that several buckets hold counts in the first of them only, which each bucket knows since a
set brings the sorted list of its buckets. Buckets of over ``block`` sets or ``BLOCK_BYTES`` are compared block against
block, each pair of blocks a group of its own, so that no group is larger than two blocks (or two texts). A class of
n near copies so sends each set to n / ``block`` groups: its links are n^2, and their number is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, groups_of, join_heavy, slices, utf8
from .graph import components
from .words import mix, shingle_sets, words_of

COORDS = 48
SLICE_BYTES = 1 << 20
#: Bytes of shingles that a block holds on average, and shingles that are compared at once.
BLOCK_BYTES = 16 << 20
COLUMNS = 4096
_DRAW = np.random.default_rng(20240229).integers(0, 1 << 63, (2, COORDS), dtype=np.uint64) | np.uint64(1)


def recall_of(threshold: float, runs: int, deepest: int = 8) -> float:
    """The probability that a pair at the threshold is together in some bucket, where nodes split ``deepest`` times.

    The pair has m of the ``COORDS`` tokens in common, m binomial. A node draws two coordinates: of one (or two) that
    are equal, it hands the pair to one (or two) children. The runs are independent only once m is given.
    """
    total = 0.0
    for m in range(COORDS + 1):
        pairs = math.comb(COORDS, 2)
        two, one = math.comb(m, 2) / pairs, m * (COORDS - m) / pairs
        p = 1.0
        for _ in range(deepest):
            p = one * p + two * (1 - (1 - p) ** 2)
        total += math.comb(COORDS, m) * threshold**m * (1 - threshold) ** (COORDS - m) * (1 - (1 - p) ** runs)
    return total


def runs_for(threshold: float, recall: float, deepest: int = 8) -> int:
    """The least number of runs whose ``recall_of`` is ``recall``; ValueError if 64 are too few."""
    found = next((r for r in range(1, 65) if recall_of(threshold, r, deepest) >= recall), None)
    if found is None:
        raise ValueError(f"no recall of {recall} at {threshold} with {COORDS} coordinates")
    return found


def _sketch(tokens: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(tokens), 8192):
        part = (tokens[begin : begin + 8192, None] ^ _DRAW[0]) * _DRAW[1]
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _print(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(tokens + np.uint64(len(tokens))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """docs: id, body, text. The text's set as fingerprint, size and sketch, without the text."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            prints, sizes, sketches = [], [], []
            for begin, end in slices(texts, SLICE_BYTES):
                for tokens in shingle_sets(words_of(texts[begin:end]), k):
                    prints.append(_print(tokens))
                    sizes.append(len(tokens))
                    sketches.append(_sketch(tokens).tolist() if len(tokens) else [])
            first, second = zip(*prints, strict=True) if prints else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int32()))], ["id", "body", "fp1", "fp2", "size", "sketch"])

    return docs.mapInArrow(sign, "id long, body long, fp1 long, fp2 long, size int, sketch array<int>")


def _children(node: Column) -> Column:
    """The two children that a set's sketch names below ``node``."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDS - 1)), F.lit(COORDS)).cast("int")
    return F.array(*(F.xxhash64(node, i, F.get("sketch", i)) for i in (first, second)))


def _buckets(classes: DataFrame, runs: int, small: int, deepest: int) -> DataFrame:
    """bucket, rep, n, shingles (of all its sets): who meets whom; buckets that hold the same sets are one."""
    nodes = classes.select("rep", "size", F.lit(None).cast("long").alias("above"), F.explode(F.flatten(F.array(*(_children(F.lit(-1 - r).cast("long")) for r in range(runs))))).alias("node"))
    found = None
    for depth in range(1, deepest + 1):
        held = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("rep")).alias("sig"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("sig2")).filter("n > 1"))
        nodes = cut(join_heavy(nodes, held, ["node"], "n"))
        done = (F.col("n") <= small) | (F.col("n") > 0.5 * F.col("above")) if depth < deepest else F.lit(True)
        done = F.coalesce(done, F.lit(False))
        own = nodes.filter(done).select(F.xxhash64("n", "sig", "sig2").alias("bucket"), "rep", "n", "shingles")
        found = own if found is None else found.unionByName(own)
        rest = nodes.filter(~done)
        if rest.isEmpty():
            break
        # Counted and joined below: split once, not for each.
        nodes = cut(rest.select("node", "rep", "size", "n").join(classes.select("rep", "sketch"), "rep").select("rep", "size", F.col("n").alias("above"), F.explode(_children(F.col("node"))).alias("node")))
    return found.dropDuplicates(["bucket", "rep"])


def _tokens(docs: DataFrame, k: int) -> DataFrame:
    """docs: id, text, fp1, fp2, m, meets. The set of each text that still has that fingerprint."""

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            wanted = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for begin, end in slices(texts, 4 * SLICE_BYTES):
                sets = shingle_sets(words_of(texts[begin:end]), k)
                same = [i for i, tokens in enumerate(sets) if _print(tokens) == wanted[begin + i]]
                part = batch.slice(begin, end - begin).take(pa.array(same, pa.int64()))
                ends = np.cumsum([0, *(len(sets[i]) for i in same)]).astype(np.int32)
                flat = np.concatenate([sets[i] for i in same]) if same else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), part.column(5), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["rep", "m", "meets", "tokens"])

    return docs.mapInArrow(take, "rep long, m long, meets array<struct<bucket:long,n:long,shingles:long>>, tokens array<long>")


def _overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the lists share (each list's values are distinct)."""
    n = len(lists)
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(n), [len(x) for x in lists])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.full((n, n), np.count_nonzero(count == n), np.float32)
    some = (count > 1) & (count < n)
    place = np.cumsum(some) - 1
    use = some[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int(some.sum()), COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + COLUMNS])
        block = np.zeros((n, min(COLUMNS, int(some.sum()) - begin)), np.float32)
        block[owner[low:high], column[low:high] - begin] = 1
        out += block @ block.T
    return out


def _compare(threshold: float):
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "task"):
            ids = np.asarray(group.column("rep").to_numpy())
            first = np.unique(ids, return_index=True)[1]
            if len(first) < 2:
                continue
            group = group.take(pa.array(first))
            ids = ids[first]
            weight, side = np.asarray(group.column("m").to_numpy(), np.float64), np.asarray(group.column("side").to_numpy())
            cross = bool(group.column("cross")[0].as_py())
            bucket = group.column("bucket")[0].as_py()
            sets = [x.values.to_numpy() for x in group.column("tokens").combine_chunks()]
            sizes = np.asarray([len(x) for x in sets], np.float64)
            shared = _overlaps(sets)
            near = np.zeros(shared.shape, bool)
            for i, row in enumerate(shared):
                near[i] = row.astype(np.float64) * (1 + threshold) >= threshold * (sizes[i] + sizes) - 1e-9
            del shared
            np.fill_diagonal(near, False)
            if cross:
                near &= side[:, None] != side[None, :]
            if not near.any():
                continue
            before = [np.asarray([b for b in x.as_py() if b < bucket], np.int64) for x in group.column("buckets").combine_chunks()]
            counted = near & (_overlaps(before) == 0) if any(len(x) for x in before) else near
            label = np.arange(len(ids))
            while True:
                lower = np.asarray([min(own, int(label[row].min())) if row.any() else own for own, row in zip(label.tolist(), near, strict=True)])
                lower = lower[lower]
                if (lower == label).all():
                    break
                label = lower
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((counted @ weight).astype(np.int64)), pa.array(ids[label])], ["rep", "links", "hub"])

    return compare


def _classes(docs: DataFrame, threshold: float, k: int, recall: float, small: int, block: int, deepest: int, id_col: str, text_col: str) -> DataFrame:
    """id, body (a hash of the text), fp1, fp2, size, class_id, n_links of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("body"), F.col(text_col).alias("text"))
    signed = cut(_signatures(texts, k))
    classes = signed.filter("size > 0").groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = cut(classes)
    named = classes.filter("rep is not null")
    met = _buckets(named, runs_for(threshold, recall, deepest), small, deepest)
    meets = met.groupBy("rep").agg(F.collect_list(F.struct("bucket", "n", "shingles")).alias("meets")).withColumnRenamed("rep", "r")
    wanted = named.select("rep", "fp1", "fp2", "m").join(meets, F.col("rep") == F.col("r")).drop("r")
    sets = _tokens(texts.join(wanted, F.col("id") == F.col("rep")).select("id", "text", "fp1", "fp2", "m", "meets"), k)
    blocks = F.ceil(F.greatest(F.col("meet.n") / F.lit(float(block)), F.col("meet.shingles") * 8 / F.lit(float(BLOCK_BYTES)))).cast("int")
    each = (
        sets.withColumn("buckets", F.col("meets.bucket"))
        .withColumn("meet", F.explode("meets"))
        .withColumn("nb", F.least(blocks, F.col("meet.n").cast("int")))
        .withColumn("side", F.pmod(F.xxhash64("rep", "meet.bucket"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select(
            F.concat_ws("/", "meet.bucket", F.least("side", "other"), F.greatest("side", "other")).alias("task"),
            F.col("meet.bucket").alias("bucket"), "side", "rep", "m", "buckets", "tokens",
        )
    )
    # "cross" holds for a whole task: of two blocks, only pairs across them are compared.
    each = each.withColumn("cross", F.split_part("task", F.lit("/"), F.lit(2)) != F.split_part("task", F.lit("/"), F.lit(3)))
    links = cut(each.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(threshold), "rep long, links long, hub long"))
    joined = components(links.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = cut(
        classes.select("fp1", "fp2", "rep", "m")
        .join(counts.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left").drop("r")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("fp1", "fp2", "m", F.coalesce("component", "rep").alias("class_id"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    narrow = signed.select("id", "body", "fp1", "fp2", "size")
    none = narrow.filter("size = 0").select("*", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return join_heavy(narrow.filter("size > 0"), known, ["fp1", "fp2"], "m").select(*none.columns).unionByName(none)


def near_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9997, small: int = 32, block: int = 1024, deepest: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, n_links.

    class_id: the smallest id in the row's connected component under similarity >= ``threshold``.
    n_links: other rows whose text is as similar as that, copies included. ids are integers.
    Texts of 1 to k - 1 words have one shingle, all their words. Null texts, and texts without
    words, are like nothing: n_links 0, class_id their own id. Rows with a null id count as copies
    of their text where another row has an id; else their class_id is null. An empty table gives no rows.
    """
    found = _classes(docs, threshold, k, recall, small, block, deepest, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9997, small: int = 32, block: int = 1024, deepest: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each near-duplicate class does: that of the smallest id.

    Rows are matched by id and text: of rows that share that id and are in the class, one stays. All texts without
    words stay. Of rows with a null id whose text no row with an id is like, one of each set of shingles stays.
    """
    rows = _classes(docs, threshold, k, recall, small, block, deepest, id_col, text_col)
    first = rows.filter("size > 0 and id <=> class_id").withColumns({"f1": F.when(F.col("id").isNull(), F.col("fp1")), "f2": F.when(F.col("id").isNull(), F.col("fp2"))})
    one = first.groupBy("class_id", "f1", "f2").agg(F.min("body").alias("body")).select(F.col("class_id").alias("id"), "body")
    bare = rows.filter("size = 0").select("id", "body").withColumn("n", F.lit(1))
    # How many rows have that id and text: mostly one.
    counted = first.groupBy("id", "body").agg(F.count(F.lit(1)).alias("n")).join(one.withColumnsRenamed({"id": "i", "body": "b"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("body") == F.col("b"))).drop("i", "b")
    kept = cut(counted.unionByName(bare.distinct())).withColumnsRenamed({"id": "__id", "body": "__body", "n": "__n"})
    # As a column, so that each text is hashed once.
    docs = docs.withColumn("__key", F.xxhash64(F.col(text_col)))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__body"))
    out = docs.join(kept.filter("__n = 1").drop("__n"), same, "left_semi")
    if not kept.filter("__n > 1").isEmpty():
        out = out.unionByName(docs.join(kept.filter("__n > 1").drop("__n"), same, "left_semi").dropDuplicates([id_col, "__key"]))
    return out.drop("__key")
