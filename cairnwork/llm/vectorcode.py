"""Vectors as short codes: each part of a vector is named by the nearest entry of that part's codebook.

Components are integers, ``floor(scale * c)``, and all distances are exact. The nearest entry is sought by norm: entries
lie sorted by norm, a few whose norms are next to the part's give a first distance, and by the triangle inequality only
entries whose norm differs from the part's by no more than that can be as near. A binary search names that annulus, and
its entries, bounds included, are the ones that are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, written
from .vectors import usable, usual_length

#: Entries next to a part by norm that give the first distance, and rows that are compared together.
SEEDS, BLOCK = 8, 256
#: Rounding of square roots is far below this share of the norms.
SLACK = 1e-9


class Annuli:
    """The codebook of one part, a (k, m) array of integers, as searched by norm."""

    def __init__(self, entries: np.ndarray):
        self.k, self.m = entries.shape
        entries = np.array(entries.tolist(), object).reshape(entries.shape)
        squares = (entries * entries).sum(axis=1)
        self.order = np.array(sorted(range(self.k), key=lambda i: (squares[i], i)), np.int64)
        self.entries, self.squares = entries[self.order], squares[self.order]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.most = max((abs(int(c)) for c in entries.ravel()), default=0)
        self.evaluated = 0
        self._typed: dict = {}

    def _as(self, kind) -> tuple[np.ndarray, np.ndarray]:
        """The factors of ``k * distance + index``, less the part's own square: a product and what is added to it."""
        if kind not in self._typed:
            self._typed[kind] = (-2 * self.k * self.entries.T).astype(kind), (self.k * self.squares + self.order.astype(object)).astype(kind)
        return self._typed[kind]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, the lower index on ties.

        ``parts`` holds whole numbers as float64. Numbers that it or 64 bits can't square exactly are Python's.
        """
        n = len(parts)
        most = max(self.most, int(np.abs(parts).max(initial=0)))
        bound = self.k * self.m * 4 * most * most + self.k
        kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
        parts = parts if kind is np.float64 else parts.astype(np.int64) if kind is np.int64 else np.frompyfunc(int, 1, 1)(parts).reshape(parts.shape)
        factors, added = self._as(kind)
        own = self.k * (parts * parts).sum(axis=1)
        norms = np.sqrt((own / self.k).astype(np.float64))
        # The entries next by norm, and the least distance to them.
        seeds = min(SEEDS, self.k)
        first = np.clip(np.searchsorted(self.norms, norms) - seeds // 2, 0, self.k - seeds)
        near = np.full(n, np.inf) if kind is not object else np.full(n, 1 << 2000, object)
        for s in range(seeds):
            near = np.minimum(near, (factors.T[first + s] * parts).sum(axis=1) + added[first + s])
        reach = np.sqrt(np.maximum((near + own) / self.k, 0).astype(np.float64))
        slack = SLACK * (1 + norms + reach)
        low, high = np.searchsorted(self.norms, norms - reach - slack, "left"), np.searchsorted(self.norms, norms + reach + slack, "right")
        self.evaluated += int((high - low).sum())
        best = np.empty(n, kind)
        by_place = np.argsort(low, kind="stable")
        far = np.inf if kind is np.float64 else np.iinfo(np.int64).max if kind is np.int64 else 1 << 2000
        for begin in range(0, n, BLOCK):
            rows = by_place[begin : begin + BLOCK]
            a, b = int(low[rows].min()), int(high[rows].max())
            keys = parts[rows] @ factors[:, a:b] + added[a:b]
            places = np.arange(a, b)
            keys[(places < low[rows, None]) | (places >= high[rows, None])] = far
            best[rows] = keys.min(axis=1)
        best = best + own
        if kind is np.float64:
            best = best.astype(np.int64)
        return (best % self.k).astype(np.int64), best // self.k


def _whole(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """An Arrow list column of vectors of one length as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(-1, length) * scale)


def _rows(embeddings: DataFrame, id_col: str, vector_col: str, *more: str) -> tuple[DataFrame, int]:
    rows = usable(embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), *more))
    length = usual_length(rows)
    return rows.filter(F.size("embedding") == length), length


def fit_codebooks(rows: DataFrame, length: int, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> np.ndarray:
    """Codebooks (parts, entries, length / parts) over all ``rows`` (vec_id, embedding; all of ``length``).

    They begin as the parts of the ``size`` smallest ids (null ids last, equal ids by their vectors), and each round
    moves an entry to the floor of the mean of the parts it is nearest to; entries without parts stay. A round is one scan:
    a task adds up its own rows, so that it hands on ``parts * size`` sums at most whatever its rows, and that is also
    what reaches the driver.
    """
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(size).select("embedding").collect()
    m = length // parts
    start = np.floor(np.array([r[0] for r in first], np.float64).reshape(-1, length) * scale)
    books = np.array([[int(c) for c in row] for row in start], object).reshape(-1, parts, m).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        books = _moved(rows, books, scale)
    return books


def _moved(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, k, m = books.shape

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Annuli(b) for b in books]
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, m), object)
        for batch in batches:
            whole = _whole(batch.column(0), parts * m, scale)
            for p in range(parts if len(whole) else 0):
                mine = whole[:, p * m : (p + 1) * m]
                index, _ = searched[p].nearest(mine)
                counts[p] += np.bincount(index, minlength=k)
                if np.abs(mine).max() * len(mine) < 1 << 53:
                    held = np.array([np.bincount(index, mine[:, j], k) for j in range(m)]).T.astype(np.int64)
                    sums[p] += held
                else:
                    np.add.at(sums[p], index, np.frompyfunc(int, 1, 1)(mine))
        where = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(where[:, 0].astype(np.int32)), pa.array(where[:, 1].astype(np.int32)), pa.array(counts[counts > 0]), pa.array([[int(c) for c in sums[p, e]] for p, e in where], pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    added = rows.select("embedding").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    # Sums of tasks may pass 64 bits together.
    total = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")) for j in range(m)]).alias("sums"))
    moved = books.copy()
    for row in total.collect():
        moved[row["part"], row["entry"]] = [int(s) // row["n"] for s in row["sums"]]
    return moved


def encode_vectors(rows: DataFrame, books: np.ndarray, scale: int = 1024, *keep: str) -> DataFrame:
    """vec_id, the columns ``keep``, ``code`` (one byte for each part) and ``error`` (squared distances, summed) of ``rows``.

    An error beyond 64 bits is an ``OverflowError`` of the task.
    """
    parts, k, m = books.shape
    if k > 256:
        raise ValueError("a code has one byte for each part")
    kept = rows.select("vec_id", *keep, "embedding")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Annuli(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _whole(batch.column(batch.num_columns - 1), parts * m, scale)
            found = [searched[p].nearest(whole[:, p * m : (p + 1) * m]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.tolist(), pa.int64())],
                [*batch.schema.names[:-1], "code", "error"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(encode, f"{schema}, code binary, error long")


def decode_vectors(codes: DataFrame, books: np.ndarray, scale: int = 1024) -> DataFrame:
    """vec_id and the vector (array<double>) that each ``code`` stands for."""
    id_type = codes.schema["vec_id"].dataType.simpleString()
    flat = (books.astype(np.float64) + 0.5) / scale

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(flat))
            found = np.concatenate([flat[p][at[:, p]] for p in range(len(flat))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(decode, f"vec_id {id_type}, embedding array<double>")


def compress_vectors(embeddings: DataFrame, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors (vec_id, label, code, error, label_error), and the codebooks.

    Vectors that are null, hold nulls, NaN or infinities, or are not of the length that most have are left out. Repeated,
    equal and null ids are rows of their own; ``label_error`` adds up the errors of all rows with an equal label, nulls
    together, and one label may hold any share of them. Fewer rows than ``size`` give fewer entries, an empty table none
    and no codes. Other columns are not read. Broadcast are the codebooks, ``size`` vectors.
    """
    rows, length = _rows(embeddings, id_col, vector_col, F.col(label_col).alias("label"))
    if not length:
        books = np.zeros((parts, 0, 0), object)
        return rows.filter("false").select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    books = fit_codebooks(rows, length, parts, size, rounds, scale)
    codes = written(encode_vectors(rows, books, scale, "label"), "vector-codes")
    # A struct is equal to another where both hold a null.
    key = F.struct("label").alias("key")
    sums = codes.groupBy(key).agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    return join_heavy(codes.withColumn("key", key), sums, ["key"], "n").select("vec_id", "label", "code", "error", "label_error"), books
