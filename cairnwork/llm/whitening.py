"""Embedding whitening: exact sums of centred products by one aggregate, eigenvectors by LAPACK, projection in columns.

Three scans of the vectors: sums, bounds and count for each dimension; then one aggregate with a column for each pair of
dimensions of the upper triangle; then the projection. All of it is SQL expressions made from the number of dimensions,
which alone bounds what reaches the driver: ``d * (d + 1) / 2`` whole numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import usable, usual_length

#: Signed 64-bit numbers lie below this.
LONG = 1 << 63


@dataclass
class Moments:
    """Of ``n`` vectors of whole numbers: sums, bounds, and sums of products of what is left of a whole centre."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]
    centre: list[int]
    products: dict[tuple[int, int], int]

    def covariance(self) -> np.ndarray:
        """Divisor ``n``. The centre is within one of the mean; what it misses is taken off exactly."""
        d, n = len(self.sums), self.n
        rest = [s - n * c for s, c in zip(self.sums, self.centre, strict=True)]
        out = np.empty((d, d))
        for (i, j), p in self.products.items():
            out[i, j] = out[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
        return out


@dataclass
class Whitening:
    """Means, and the directions (one a column) with their variances, the largest first."""

    moments: Moments
    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> tuple[DataFrame, int]:
    """vec_id and columns x0, x1, ... (long), ``floor(scale * c) + shift``, of the usable vectors; and how many columns.

    Vectors that are null, hold nulls, NaN or infinities, or are not of the length that most have are left out.
    """
    rows = usable(embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), "v")
    d = usual_length(rows, "v")
    columns = [F.expr(f"floor({scale} * CAST(v[{i}] AS DOUBLE)) + {shift}").alias(f"x{i}") for i in range(d)]
    return rows.filter(F.size("v") == d).select("vec_id", *columns), d


def moments(vectors: DataFrame, d: int) -> Moments:
    """Exact sums over all vectors. Products are added in 64 bits where the bounds allow it, else as decimals."""
    told = vectors.agg(F.count("*").alias("n"), *[F.expr(f"{f}(x{i})").alias(f"{f}{i}") for i in range(d) for f in ("sum", "min", "max")]).first()
    n, sums, least, most = told["n"], *([told[f"{f}{i}"] for i in range(d)] for f in ("sum", "min", "max"))
    if not n:
        return Moments(0, [0] * d, [0] * d, [0] * d, [0] * d, {})
    centre = [s // n for s in sums]
    wide = max([max(b - c, c - a) for a, b, c in zip(least, most, centre, strict=True)], default=0)
    kind = "BIGINT" if n * wide * wide < LONG else "DECIMAL(19,0)"
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    centred = vectors.select(*[F.expr(f"CAST(x{i} - {centre[i]} AS {kind})").alias(f"y{i}") for i in range(d)])
    products = centred.agg(*[F.expr(f"sum(y{i} * y{j})").alias(f"p{i}_{j}") for i, j in pairs]).first()
    return Moments(n, sums, least, most, centre, {pair: int(p) for pair, p in zip(pairs, products, strict=True)})


def fit(held: Moments, components: int = 8) -> Whitening:
    d = len(held.sums)
    if not held.n or not d:
        return Whitening(held, np.zeros(d), np.zeros((d, 0)), np.zeros(0), 0.0)
    covariance = held.covariance()
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    # A direction whose variance is rounding alone has none.
    flat = max(values.max(initial=0.0), 0.0) * d * np.finfo(float).eps
    variances = np.where(values[order] > flat, values[order], 0.0)
    return Whitening(held, np.array([s / held.n for s in held.sums]), vectors[:, order], variances, float(np.trace(covariance)))


def project(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """vec_id, deviation (decimal or long, exact: sum over dimensions of ``(n * x - S)^2``), w0, w1, ... of every vector."""
    held, d = fitted.moments, len(fitted.moments.sums)
    widest = sum(max(held.n * b - s, s - held.n * a) ** 2 for a, b, s in zip(held.least, held.most, held.sums, strict=True))
    kind = "BIGINT" if widest < LONG else "DECIMAL(38,0)"
    # The product n * x itself passes 64 bits later than the squares do.
    off = [f"CAST({held.n}L * (x{i} - {held.centre[i]}L) - {held.sums[i] - held.n * held.centre[i]}L AS {kind})" for i in range(d)]
    deviation = " + ".join(f"{o} * {o}" for o in off) or "0L"
    out = [F.expr(deviation).alias("deviation")]
    centred = vectors.select("vec_id", *[f"x{i}" for i in range(d)], *[F.expr(f"CAST(x{i} AS DOUBLE) - {float(fitted.mean[i])!r}D").alias(f"c{i}") for i in range(d)])
    for k, e in enumerate(fitted.variances):
        weights = fitted.directions[:, k] / math.sqrt(e) if e > 0 else None
        told = " + ".join(f"c{i} * {float(w)!r}D" for i, w in enumerate(weights)) if weights is not None else "CAST(NULL AS DOUBLE)"
        out.append(F.expr(told).alias(f"w{k}"))
    return centred.select("vec_id", *out)


def identity_error(projected: DataFrame, components: int) -> float | None:
    """The largest absolute entry of the covariance (divisor n) of w0, w1, ... minus the identity; null without any."""
    if not components:
        return None
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    told = projected.agg(*[F.avg(f"w{a}").alias(f"m{a}") for a in range(components)], *[F.expr(f"avg(w{a} * w{b})").alias(f"p{a}_{b}") for a, b in pairs]).first()
    return max(abs(told[f"p{a}_{b}"] - told[f"m{a}"] * told[f"m{b}"] - (a == b)) for a, b in pairs)


def whiten(embeddings: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Unusable vectors (see ``whole_vectors``) are left out; repeated, equal and null ids are rows of their own, and other
    columns are not read. Fewer than ``components`` dimensions give fewer components, an empty table no rows. A component
    without variance (one vector, equal vectors) has a null ``whitened``, and ``identity_error`` is over the others, null
    if there is none; ``explained`` is null where no dimension has variance. Components beyond about 2^63 / ``scale``
    fail as overflows. ``deviation`` is a decimal where 64 bits might not hold it.
    """
    vectors, d = whole_vectors(embeddings, id_col, vector_col, scale, shift)
    fitted = fit(moments(vectors, d), components)
    projected = written(project(vectors, fitted), "whitened")
    error = identity_error(projected, int((fitted.variances > 0).sum()))
    rows = [
        F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(float(e) / fitted.trace if fitted.trace > 0 else None).cast("double").alias("explained"))
        for k, e in enumerate(fitted.variances)
    ]
    told = F.explode(F.array(*rows) if rows else F.expr("CAST(array() AS array<struct<component: int, whitened: double, explained: double>>)"))
    return projected.select("vec_id", "deviation", told.alias("r")).select(
        "vec_id", "r.component", F.lit(fitted.moments.n).cast("long").alias("n"), "deviation", "r.whitened", "r.explained", F.lit(error).cast("double").alias("identity_error")
    )
