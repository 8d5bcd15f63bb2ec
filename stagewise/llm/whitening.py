"""Whitening of embeddings: one aggregation sums the centred products of every pair of dimensions, LAPACK decomposes what it gives.

Entries are fixed-point numbers (`scale` steps to a unit), and statistics are those of the distinct vectors, so copies weigh
once. The covariance is symmetric, so only its upper triangle is summed, in square tiles of TILE by TILE dimensions: a vector
becomes a row for each tile of the triangle, and the aggregation has one generated expression for each pair of places in a
tile. So it has the same few expressions for any number of dimensions, and Spark compiles them; one expression for each
entry of the triangle, 2,080 at 64 dimensions, is more than it compiles, and their plan took much of the driver's memory.
All are partial sums: tasks send a row a tile, and the driver gets those of the triangle however many vectors there are.
Rows are then projected by generated expressions too:
nothing but the entries' arithmetic happens to a row, and rows never meet.

Null vectors, vectors with a null or a non-finite entry, and those shorter than the longest one are left out. Rows with equal
vectors, or equal or null ids, all stay. No vectors give no rows. A single distinct vector, or dimensions without variance,
give components whose eigenvalue is zero up to rounding: their whitened values are null, since nothing can be scaled to one.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Dimensions along a side of a tile; TILE * TILE sums are few enough for Spark to compile them.
TILE = 8
#: An eigenvalue below this part of the largest is rounding.
NOTHING = 1e-12


class Whitening(NamedTuple):
    """What was fitted to n distinct vectors: sums by dimension, covariance, eigenvalues and unit eigenvectors (by row) in falling order."""

    n: int
    sums: list[int]
    greatest: int
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def fixed(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """(key, x): whole numbers of steps below each entry, of the vectors that can be used."""
    finite = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    steps = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return embeddings.where(F.col(vector).isNotNull() & finite).select(F.col(key), steps.alias("x"))


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Divisor n, centred before multiplying: a generated sum for every pair of places in a tile, in one aggregation by tile."""
    d, sides = len(sums), range(-(-len(sums) // TILE))
    means = ", ".join(f"{s / n!r}D" for s in sums)
    empty = ", ".join(["0D"] * (TILE * len(sides) - d))
    centred = f"concat(transform(arrays_zip(x, array({means})), e -> e.x - e.`1`), array({empty}))" if empty else f"transform(arrays_zip(x, array({means})), e -> e.x - e.`1`)"
    tiles = ", ".join(f"struct({p} AS p, {q} AS q)" for p in sides for q in sides if p <= q)
    rows = fit.select(F.expr(centred).alias("c")).select("c", F.explode(F.expr(f"array({tiles})")).alias("t"))
    places = rows.selectExpr("t.p", "t.q", *(f"c[t.{side} * {TILE} + {k}] AS {name}{k}" for side, name in (("p", "a"), ("q", "b")) for k in range(TILE)))
    pairs = [(i, j) for i in range(TILE) for j in range(TILE)]
    out = np.zeros((d, d))
    for r in places.groupBy("p", "q").agg(*(F.expr(f"sum(a{i} * b{j})").alias(f"s{i}_{j}") for i, j in pairs)).collect():  # a row a tile
        for i, j in pairs:
            x, y = r["p"] * TILE + i, r["q"] * TILE + j
            if x < d and y < d:
                out[x, y] = out[y, x] = r[f"s{i}_{j}"] / n
    return out


def fit(vectors: DataFrame) -> Whitening | None:
    """Statistics and components of distinct vectors (x), all of one length; null if there are none."""
    d = vectors.select(F.max(F.size("x"))).first()[0]
    if not d:
        return None
    first = vectors.selectExpr("count(1)", "max(array_max(transform(x, c -> abs(c))))", *(f"sum(x[{i}])" for i in range(d))).first()
    n, sums = first[0], list(first[2:])
    v = covariance(vectors, n, sums)
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    rows = columns.T[order]
    largest = np.abs(rows).argmax(axis=1)
    return Whitening(n, sums, first[1], v, values[order], rows * np.sign(rows[np.arange(d), largest])[:, None])


def projected(w: Whitening, k: int) -> Column:
    """The k-th component of x, scaled to variance one; null where there is no variance."""
    e = float(w.values[k])
    if e <= NOTHING * max(float(w.values[0]), 0.0) or e <= 0:
        return F.lit(None).cast("double")
    terms = " + ".join(f"(x[{i}] - {s / w.n!r}D) * {float(a)!r}D" for i, (s, a) in enumerate(zip(w.sums, w.vectors[k], strict=True)))
    return F.expr(f"({terms}) / {float(np.sqrt(e))!r}D")


def deviation(w: Whitening) -> Column:
    """The sum over dimensions of (n * x - S)^2, exact: in whole numbers of 64 bits where they must suffice, else in decimals; null where the sum has no 64 bits."""
    kind = "bigint" if len(w.sums) * (2 * w.n * w.greatest) ** 2 < 2**63 else "decimal(19,0)"
    squares = " + ".join(f"cast({w.n}L * x[{i}] - ({s}L) AS {kind}) * cast({w.n}L * x[{i}] - ({s}L) AS {kind})" for i, s in enumerate(w.sums))
    return F.expr(squares).try_cast("long")


def identity_error(vectors: DataFrame, w: Whitening, k: int) -> float | None:
    """How far the covariance of the first k components is from the identity, at most."""
    shown = vectors.select(*(projected(w, i).alias(f"w{i}") for i in range(k)))
    pairs = list(combinations_with_replacement(range(k), 2))
    found = shown.selectExpr(*(f"covar_pop(w{i}, w{j})" for i, j in pairs)).first()
    off = [abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True) if v is not None]
    return float(max(off)) if off else None


def whitened(embeddings: DataFrame, components: int = 4, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """A row for each usable row of embeddings and each of the first components.

    (key, component from 1, n, deviation, whitened, explained, identity_error); identity_error is one value for all rows.
    """
    kept = fixed(embeddings, vector, key, scale)
    out = f"{key} {embeddings.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = stash(kept.select("x").distinct(), "vectors")
    d = distinct.select(F.max(F.size("x"))).first()[0]
    if not d:
        return embeddings.sparkSession.createDataFrame([], out)
    distinct, kept = (df.where(F.size("x") == d) for df in (distinct, kept))
    w = fit(distinct)
    k, trace = min(components, d), float(np.trace(w.covariance))
    error = F.lit(identity_error(distinct, w, k)).cast("double").alias("identity_error")

    def shown(i: int) -> Column:
        part = F.lit(float(w.values[i]) / trace if trace > 0 else None).cast("double")
        return F.struct(F.lit(i + 1).alias("component"), projected(w, i).alias("whitened"), part.alias("explained"))

    rows = kept.select(key, deviation(w).alias("deviation"), F.explode(F.array(*(shown(i) for i in range(k)))).alias("c"))
    return rows.select(key, "c.component", F.lit(w.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", error)
