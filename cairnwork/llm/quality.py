"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class is a Gaussian over transformed statistics of the text; its covariance is shrunk towards its
diagonal. The score is the logistic of the difference of the two Mahalanobis log densities (plus log
priors), divided by ``TEMPER`` since statistics of one text depend on each other; ranks and the sign
of the difference stay as they are. Cholesky factors are inverted once, when the model is fitted.

Spark sums the moments of each class (one row per class, whatever the number of labelled rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, utf8
from .words import words_of

SLICE_BYTES = 1 << 20
TEMPER = 4.0
#: Words and characters of typical text that each text is thought to have besides its own, so that the
#: shares of a text of a few words say little; and the shares of that typical text.
PRIOR_WORDS, PRIOR_CHARS = 30, 150
TYPICAL = {"length": 5.5, "square": 42.0, "upper": 0.015, "digits": 0.001, "marks": 0.025, "symbols": 0.0003, "repeats": 0.006, "short": 0.31, "marked": 0.0005}
NAMES = ["chars", "word_length", "spread", "upper", "digits", "marks", "symbols", "distinct", "repeats", "short_words", "lines", "marked_words"]

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 mark, 4 symbol, 5 line end
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[list(b".,;:'\"-()?")] = 3
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 4
_CLASS[10] = 5


def _logit(share: np.ndarray) -> np.ndarray:
    return np.log((share + 0.005) / (1.005 - share))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of transformed statistics for each text; all counts of an empty text are 0."""
    out = []
    for begin, end in slices(texts, SLICE_BYTES):
        part = texts[begin:end]
        words = words_of(part)
        data = np.frombuffer(b"\0".join(part) + b"\0", np.uint8)
        opens = np.concatenate(([0], np.cumsum([len(x) + 1 for x in part])))
        kind = _CLASS[data]
        # Capitals of Latin-1 letters: the second byte after 0xC3 is below 0x9F.
        kind[1:][(data[:-1] == 0xC3) & (data[1:] < 0x9F)] = 1
        sums = {k: np.diff(np.concatenate(([0], np.cumsum(kind == k)))[opens]) for k in range(1, 6)}
        chars = np.diff(np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[opens]) - 1
        n = words.counts
        owner = np.repeat(np.arange(len(part)), n)
        size = (words.end - words.start).astype(float)
        total = lambda x, owner=owner, m=len(part): np.bincount(owner, x, m)
        per_word = lambda x, prior, n=n: (x + PRIOR_WORDS * TYPICAL[prior]) / (n + PRIOR_WORDS)
        per_char = lambda k, prior, sums=sums, chars=chars: _logit(np.minimum(1, (sums[k] + PRIOR_CHARS * TYPICAL[prior]) / (chars + PRIOR_CHARS)))
        mean = per_word(total(size), "length")
        repeats = np.zeros(len(size))
        if len(size):
            repeats[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
        marked = (kind[words.end] == 4).astype(float)
        distinct = np.array([len(np.unique(words.hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)], float)
        out.append(np.column_stack([
            np.log1p(chars), np.log(mean), np.log(np.sqrt(np.maximum(per_word(total(size**2), "square") - mean**2, 0.1))),
            per_char(1, "upper"), per_char(2, "digits"), per_char(3, "marks"), per_char(4, "symbols"),
            np.log((distinct + PRIOR_WORDS) / (n**0.8 + PRIOR_WORDS)), _logit(per_word(total(repeats), "repeats")), _logit(per_word(total((size <= 3).astype(float)), "short")),
            np.log((sums[5] + 2) / (n / 40 + 2)), _logit(per_word(total(marked), "marked")),
        ]))
    return np.round(np.concatenate(out), 6) if out else np.zeros((0, len(NAMES)))


@dataclass(frozen=True)
class Quadratic:
    """Per class: mean, inverse Cholesky factor, log determinant and log prior. None: too few labels."""

    mean: tuple[np.ndarray, np.ndarray] | None
    factor: tuple[np.ndarray, np.ndarray] | None
    constant: tuple[float, float] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), 0.5)
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.mean, self.factor, self.constant, strict=True)]
        return np.round(1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPER, -500, 500))), 12)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x (array<double>) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(utf8(batch.column(1)))
            ends = np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["id", "x"])

    return docs.select(id_col, text_col).mapInArrow(measure, f"id {id_type}, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrinkage: float = 0.05) -> Quadratic:
    """Moments of the labelled rows that are not held out; rows without label or id teach nothing.

    A class of n rows gets a shrinkage of d / (n + d) for d statistics, and ``shrinkage`` at least.
    """
    d = len(NAMES)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    rows = measured.filter(~held_out(F.col("id"))).join(marked, "id")
    x = [F.get("x", i) for i in range(d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1)]
    found = {r[0]: r[1:] for r in rows.groupBy("y").agg(F.count(F.lit(1)), *sums).collect()}
    if any(found.get(y, (0,))[0] < 2 for y in (0, 1)):
        return Quadratic(None, None, None)
    means, factors, constants = [], [], []
    total = found[0][0] + found[1][0]
    for y in (0, 1):
        n, values = found[y][0], np.asarray(found[y][1:], float)
        mean = values[:d] / n
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = values[d:] / n
        cov = second + np.tril(second, -1).T - np.outer(mean, mean)
        diagonal = np.diag(np.maximum(np.diag(cov), 0) + 1e-3)
        share = max(shrinkage, d / (n + d))
        lower = np.linalg.cholesky((1 - share) * cov + share * diagonal + 1e-4 * np.eye(d))
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        constants.append(math.log(n / total) - float(np.log(np.diag(lower)).sum()))
    return Quadratic((means[0], means[1]), (factors[0], factors[1]), (constants[0], constants[1]))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Only the text goes into a score. Null texts count as empty and are scored like any. Without labels of
    both classes (two of each) every score is 0.5. A null id is not held out.
    """
    measured = cut(document_statistics(docs, id_col, text_col))
    model = fit(measured, labels, id_col, label_col)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    return measured.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score("x").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns, without a shuffle of texts.

    These are the rows whose ``predicted`` is 1 in ``score_quality``. So where labels of both classes are missing (two of
    each) and every score is 0.5, a ``threshold`` above that keeps none.
    """
    model = fit(document_statistics(docs, id_col, text_col), labels, id_col, label_col)
    if model.mean is None:
        return docs.filter(F.lit(0.5) >= threshold)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics([(t or "").encode() for t in text])), dtype=float)

    return docs.filter(score(F.col(text_col)) >= threshold)
