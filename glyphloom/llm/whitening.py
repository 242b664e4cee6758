"""Embedding whitening: every vector in the units of its principal components.

Entries become whole numbers x = floor(64 c) + 1,000,000, so that sums over all rows and
each row's deviation from the mean, sum of (n x - S)^2, are exact.  The centred rows
(n x - S) / n are a distributed matrix whose computeSVD gives the components; its singular
values, squared and divided by n, are the eigenvalues of the covariance with divisor n.  The
total variance is that of the exact deviations, not the sum of eigenvalues.  The covariance
of the result is measured, around its own mean, against the identity.

Only matrices as wide as a vector come to the driver.  Rows are read again for each pass
(sums, products, mean and products of the result) rather than written in between.

A vector that is null or holds a null or non-finite entry is left out.  The width of most
vectors counts (the larger of two as frequent); vectors of another width are left out too.
An entry beyond 2^56 counts as that.  A deviation beyond a long is null.  Components whose
eigenvalue is below 10^-12 of the largest have no direction of their own and are left out:
one vector, equal vectors or vectors of no entry give no rows.  Repeated rows and null ids
count like others.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
UNITS, SHIFT = 64, 1_000_000
SAFE = 1 << 62  # whole numbers below it are added and multiplied as longs, others as Python's
SMALLEST = 1e-6  # of the largest singular value
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whole_numbers(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and x of the rows that count."""
    rows = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch["vector"]), width), False))
    c = rows["vector"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(c).all(1)
    with np.errstate(over="ignore"):
        x = np.floor(c[finite] * UNITS)
    return rows["vec_id"].filter(pa.array(finite)), np.clip(x, -(2.0**56), 2.0**56).astype(np.int64) + SHIFT


@dataclass
class Sums:
    """n rows and the exact sum of each entry."""

    n: int
    total: list[int]

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred rows, and each row's sum of (n x - S)^2 as whole numbers."""
        largest = max((abs(t) for t in self.total), default=0)
        small = self.n * int(np.abs(x).max(initial=0)) + largest < SAFE
        kind = np.int64 if small else object
        d = x.astype(kind) * self.n - np.array(self.total, kind)
        centred = (d / self.n).astype(np.float64)
        if small and int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) >= SAFE:
            d = d.astype(object)
        return centred, (d * d).sum(1)


@dataclass
class Whitening:
    """What has been learnt: sums, directions by column, their eigenvalues, and the total variance."""

    sums: Sums
    directions: np.ndarray
    eigenvalues: np.ndarray
    variance: float
    identity_error: float = 0.0

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.directions / np.sqrt(self.eigenvalues)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


def _added(vectors: DataFrame, width: int, partial: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, keys: list[str], kind: str) -> list:
    """Each task adds its batches' numbers key by key; Spark adds those of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = partial(whole_numbers(batch, width)[1])
            held = new if held is None else {c: v if c in keys else held[c] + v for c, v in new.items()}
        if held is not None:
            yield pa.RecordBatch.from_pydict(held)

    made = vectors.mapInArrow(run, schema)
    return made.groupBy(*keys).agg(*[F.sum(F.col(c).cast(kind)).alias(c) for c in made.columns if c not in keys]).collect()  # a matrix as wide as a vector at most


def sums_of(vectors: DataFrame, width: int) -> Sums:
    low = 31

    def partial(x: np.ndarray) -> dict[str, np.ndarray]:
        # two halves, so that no sum of a task leaves a long
        return {"entry": np.arange(width), "high": (x >> low).sum(0), "rest": (x & ((1 << low) - 1)).sum(0), "n": np.full(width, len(x))}

    rows = sorted(_added(vectors, width, partial, "entry long, high long, rest long, n long", ["entry"], "decimal(38,0)"))
    return Sums(int(rows[0]["n"]) if rows else 0, [(int(r["high"]) << low) + int(r["rest"]) for r in rows])


def learn(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """None where no vector counts or all are equal."""
    vectors = _vectors(df, id_col, vector_col)
    usual = vectors.where("size(vector) > 0").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if usual is None:
        return None
    width = usual["width"]
    sums = sums_of(vectors, width)
    if not sums.n:
        return None
    (squares,) = _added(vectors, width, lambda x: {"all": np.zeros(1, np.int64), "squares": np.array([float(sums.deviations(x)[1].sum())])}, "all long, squares double", ["all"], "double")
    variance = squares["squares"] / float(sums.n) ** 3
    if variance == 0:
        return None

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = sums.deviations(whole_numbers(batch, width)[1])[0]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(c) + 1, dtype=np.int32) * width, c.ravel())], ["row"])

    rows = vectors.mapInArrow(centre, "row array<double>").select(array_to_vector("row").alias("row"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), sums.n, width)
    # all components, for which the products of columns are decomposed at once and not by iteration
    found = matrix.computeSVD(width, False, SMALLEST)
    values, directions = found.s.toArray()[:components], found.V.toArray()[:, :components]
    directions = directions * np.where(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])] < 0, -1.0, 1.0)
    learnt = Whitening(sums, directions, values**2 / sums.n, variance)
    learnt.identity_error = _identity_error(vectors, learnt)
    return learnt


def _identity_error(vectors: DataFrame, learnt: Whitening) -> float:
    """The largest absolute entry of the result's covariance less the identity; centred before it is multiplied."""
    width, k, n = len(learnt.sums.total), len(learnt.eigenvalues), learnt.sums.n
    project = lambda x: learnt.project(learnt.sums.deviations(x)[0])
    rows = _added(vectors, width, lambda x: {"component": np.arange(k), "total": project(x).sum(0)}, "component long, total double", ["component"], "double")
    mean = np.array([r["total"] for r in sorted(rows)]) / n
    a, b = np.triu_indices(k)

    def products(x: np.ndarray) -> dict[str, np.ndarray]:
        w = project(x) - mean
        return {"a": a, "b": b, "total": (w.T @ w)[a, b]}

    rows = _added(vectors, width, products, "a long, b long, total double", ["a", "b"], "double")
    return max(abs(r["total"] / n - (r["a"] == r["b"])) for r in rows)


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: what `RESULT` names."""
    learnt = learn(df, components, id_col, vector_col)
    if learnt is None:
        return df.sparkSession.createDataFrame([], RESULT)
    width, k, n = len(learnt.sums.total), len(learnt.eigenvalues), learnt.sums.n
    explained = learnt.eigenvalues / learnt.variance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_numbers(batch, width)
            centred, squares = learnt.sums.deviations(x)
            deviation = pa.array([int(s) if s < 2**63 else None for s in squares], pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), deviation.take(each), pa.array(learnt.project(centred).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), learnt.identity_error))],
                schema=_SCHEMA,
            )

    return _vectors(df, id_col, vector_col).mapInArrow(run, RESULT)
