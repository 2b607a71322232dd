"""Whitening vectors with an eigendecomposition that grows one vector at a time.

The fit list holds each distinct vector once. Each of its partitions keeps the mean of the
vectors it has met and the spectrum (eigenvalues and eigenvectors) of their scatter about
it. A further vector changes the scatter by a rank-one matrix, centred as Welford's rule has
it: the eigenvalues become the roots of a secular equation, found between the old ones
by rational steps guarded by bisection, and the eigenvectors are turned by the vectors that
Gu and Eisenstat's corrected weights give. Entries of no weight are deflated, and equal
eigenvalues first have their weights turned into one of them.

Spectra of partitions are merged eight at a time, in levels, by the same step: each scaled
eigenvector of one is a rank-one change of the other, and so is the distance of the means.
Last, a Rayleigh-Ritz refinement over all of the fit list: the covariance in the basis found
is summed up by all tasks from centred vectors, and the small matrix, nearly diagonal by
then, is diagonalised. Every step gathers matrices of the square of the dimension only.

Vectors are whole numbers here: entries c become floor(64 c) + 1,000,000. Rows without a vector or
with a null, infinite or NaN entry are dropped, as are empty vectors, vectors of a length other
than the most frequent one (the lesser of equals) and those with an entry of 2**50 or more.
Directions without variance (below 1e-10 of the mean eigenvalue) cannot be whitened and are
left out, so fewer than ``components`` may come out; without any rows, none. ``deviation`` is null
where it does not fit into 64 bits. Repeated rows are answered each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import partitions, written

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 50)
COMPONENTS, MERGED = 16, 8
_EPS = float(np.finfo(float).eps)
_STEPS = 80


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Distances [i, j] of root i of ``1 + sum(weights / (poles - x))`` from pole j.

    Poles rise strictly and weights are positive. Root i lies between pole i and the
    next one, the last below the last pole and the sum of weights. Each is held as its
    distance from the nearer pole, so that small distances keep all their digits.
    """
    count = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    middle = poles + (upper - poles) / 2
    right = 1 + (weights / (poles - middle[:, None])).sum(axis=1) < 0
    right[-1] = False
    at = np.arange(count) + right
    offsets = poles - poles[at][:, None]
    width = upper - poles
    low = np.where(right, -width / 2, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(count) < count - 1, width / 2, width))
    x = (low + high) / 2
    line = np.arange(count)
    # Poles below a root and those above it weigh apart in the rational step.
    below = line[None, :] <= line[:, None]
    near = np.minimum(line, max(count - 2, 0))
    far = np.minimum(near + 1, count - 1)
    below[-1, -1] = count == 1
    todo = line
    for _ in range(_STEPS):
        gaps = offsets[todo] - x[todo, None]
        terms = weights / gaps
        value = 1 + terms.sum(axis=1)
        slack = _EPS * (count + 8) * (1 + np.abs(terms).sum(axis=1))
        up = value < 0
        low[todo] = np.where(up, x[todo], low[todo])
        high[todo] = np.where(up, high[todo], x[todo])
        open_ = (np.abs(value) > slack) & (high[todo] - low[todo] > 2 * _EPS * np.maximum(np.abs(low[todo]), np.abs(high[todo])))
        todo, gaps, terms, value = todo[open_], gaps[open_], terms[open_], value[open_]
        if not len(todo):
            break
        slopes = terms / gaps
        one, two = gaps[np.arange(len(todo)), near[todo]], gaps[np.arange(len(todo)), far[todo]]
        lower = np.where(below[todo], slopes, 0).sum(axis=1)
        higher = slopes.sum(axis=1) - lower
        a = (one + two) * value - one * two * (lower + higher)
        b = one * two * value
        c = value - one * lower - two * higher
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            last = todo == count - 1
            step = np.where(last, np.where(a >= 0, (a + root) / (2 * c), 2 * b / (a - root)), step)
            moved = x[todo] + step
            inside = np.isfinite(moved) & (moved > low[todo]) & (moved < high[todo])
        x[todo] = np.where(inside, moved, low[todo] + (high[todo] - low[todo]) / 2)
    return x[:, None] - offsets


def rank_one(values: np.ndarray, vectors: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``V diag(values) V' + change change'``; values rise, vectors are columns."""
    z = vectors.T @ change
    size = float(z @ z)
    if not size > 0:
        return values, vectors
    least = 8 * _EPS * max(float(values[-1]), size)
    close = np.diff(values) <= least
    if close.any():
        values, vectors, z = values.copy(), vectors.copy(), z.copy()
        begin = 0
        while begin < len(values):
            end = int(np.searchsorted(values, values[begin] + least, "right"))
            if end - begin > 1:
                # A reflection turns the weights of equal values into the last of them.
                mirror = z[begin:end].copy()
                length = np.copysign(np.linalg.norm(mirror), mirror[-1])
                mirror[-1] += length
                square = mirror @ mirror
                if square > 0:
                    block = vectors[:, begin:end]
                    vectors[:, begin:end] = block - np.outer(block @ mirror, mirror * (2 / square))
                    z[begin:end] = 0
                    z[end - 1] = -length
                values[begin:end] = values[begin:end].mean()
            begin = end
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > least)
    if not len(live):
        return values, vectors
    poles, weights = values[live], z[live]
    away = secular_roots(poles, weights * weights)
    roots = poles[0] + away[:, 0]
    count = len(live)
    # Weights for which the roots found are exact, so that the vectors are orthogonal.
    line = np.arange(count)
    spread = poles[:, None] - poles
    under = np.where(line[:, None] < line, spread, np.roll(spread, -1, axis=0))
    under[-1] = 1.0
    exact = np.sqrt(np.abs((away / under).prod(axis=0)))
    turned = np.copysign(exact, weights)[:, None] / -away.T
    turned /= np.linalg.norm(turned, axis=0)
    out = vectors.copy()
    out[:, live] = vectors[:, live] @ turned
    changed = values.copy()
    changed[live] = roots
    order = np.argsort(changed, kind="stable")
    return changed[order], out[:, order]


@dataclass
class Spectrum:
    """How many vectors, their mean, and the eigenvalues and eigenvectors of their scatter."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dimension: int) -> Spectrum:
        return cls(0, np.zeros(dimension), np.zeros(dimension), np.eye(dimension))

    def _change(self, change: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, change)

    def add(self, vector: np.ndarray) -> None:
        apart = vector - self.mean
        self.count += 1
        self.mean = self.mean + apart / self.count
        self._change(apart * np.sqrt((self.count - 1) / self.count))

    def merge(self, other: Spectrum) -> None:
        if not other.count:
            return
        total = self.count + other.count
        apart = other.mean - self.mean
        self._change(apart * np.sqrt(self.count * other.count / total))
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._change(vector * np.sqrt(value))
        self.mean = self.mean + apart * (other.count / total)
        self.count = total

    def row(self, number: int) -> pa.RecordBatch:
        lists = [pa.array([part.ravel()], pa.list_(pa.float64())) for part in (self.mean, self.values, self.vectors)]
        columns = [pa.array([number], pa.int64()), pa.array([self.count], pa.int64()), *lists]
        return pa.RecordBatch.from_arrays(columns, names=["part", "count", "mean", "values", "vectors"])

    @classmethod
    def of(cls, count: int, mean, values, vectors) -> Spectrum:
        values = np.array(values)
        return cls(count, np.array(mean), values, np.array(vectors).reshape(len(values), len(values)))


_SPECTRUM = "part long, count long, mean array<double>, values array<double>, vectors array<double>"


def matrix_of(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def whole_vectors(vectors: Column) -> Column:
    """The vector as whole numbers; null unless every entry is a finite number of bounded size."""
    entries = F.transform(vectors, lambda c: c.cast("double"))
    fine = F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True)))
    whole = F.transform(entries, lambda c: F.floor(c * SCALE) + SHIFT)
    return F.when(vectors.isNotNull() & (F.size(vectors) > 0) & fine, whole)


def spectra(fit: DataFrame, dimension: int) -> DataFrame:
    """One spectrum for each partition that has vectors."""

    def run(batches):
        found = Spectrum.empty(dimension)
        for batch in batches:
            for vector in matrix_of(batch.column("x"), dimension).astype(float):
                found.add(vector)
        if found.count:
            yield found.row(TaskContext.get().partitionId())

    return fit.mapInArrow(run, _SPECTRUM)


def merged(rows: DataFrame, dimension: int) -> DataFrame:
    """One spectrum for each MERGED of them."""

    def run(table: pa.Table) -> pa.Table:
        found = Spectrum.empty(dimension)
        rows = table.sort_by("part").to_pylist()
        for row in rows:
            found.merge(Spectrum.of(*(row[name] for name in ("count", "mean", "values", "vectors"))))
        return pa.Table.from_batches([found.row(rows[0]["part"] // MERGED)])

    return rows.groupBy(F.floor(F.col("part") / MERGED)).applyInArrow(run, _SPECTRUM)


def spectrum_of(fit: DataFrame, dimension: int) -> Spectrum:
    """The spectrum of the whole list, merged level by level; each level is written."""
    # Dealt out anew: an update costs far more than the few bytes of its vector, by which tasks are sized.
    rows = written(spectra(fit.repartition(partitions(fit.sparkSession)), dimension), "spectra")
    while rows.count() > 1:
        rows = written(merged(rows, dimension), "spectra")
    row = rows.first()
    return Spectrum.of(row["count"], row["mean"], row["values"], row["vectors"])


def summed(frame: DataFrame, measure, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the arrays of one shape that ``measure`` makes of batches, each task sending one."""

    def run(batches):
        total = None
        for batch in batches:
            part = measure(batch)
            total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    kind = "long" if measure.whole else "double"
    sums = frame.mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(int(np.prod(shape)), np.int64 if measure.whole else float)
    for row in sums.collect():
        out[row["at"]] = row["value"]
    return out.reshape(shape)


@dataclass
class Whitening:
    """What a fit found: exact count and sums, eigenvalues by falling size, and their vectors as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of ``n x - sums``."""
        apart = x * self.n - self.sums
        if np.abs(apart).max(initial=0) < 1 << 28 and apart.shape[1] < 1 << 6:
            return np.einsum("ij,ij->i", apart, apart).tolist()
        wide = [sum(value * value for value in row) for row in apart.tolist()]
        return [value if value < 1 << 63 else None for value in wide]


def fit_whitening(vectors: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit the distinct vectors of a column ``x`` of arrays of whole numbers, all of one length."""
    fit = written(vectors.select("x").distinct(), "fit")

    def totals(batch):
        x = matrix_of(batch.column("x"), dimension)
        return np.append(x.sum(axis=0), len(x))

    totals.whole = True
    *sums, n = summed(fit, totals, (dimension + 1,)).tolist()
    if not n:
        return None
    # Orthonormal to the last digit; a basis close to the eigenvectors.
    basis = np.linalg.qr(spectrum_of(fit, dimension).vectors[:, ::-1])[0]
    model = Whitening(n, np.array(sums), np.ones(dimension), basis, 0.0)

    def projected(batch):
        y = model.centred(matrix_of(batch.column("x"), dimension)) @ model.vectors
        return y.T @ y

    projected.whole = False
    small = summed(fit, projected, (dimension, dimension)) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    trace = float(np.trace(small))
    values, turn = values[::-1], turn[:, ::-1]
    kept = np.flatnonzero(values > 1e-10 * trace / dimension)[:components]
    model = Whitening(n, model.sums, values[kept], basis @ turn[:, kept], trace)
    if not len(kept):
        return model

    def checked(batch):
        w = model.whitened(matrix_of(batch.column("x"), dimension))
        return np.vstack([w.T @ w, w.sum(axis=0)])

    checked.whole = False
    found = summed(fit, checked, (len(kept) + 1, len(kept))) / n
    covariance = found[:-1] - np.outer(found[-1], found[-1])
    model.identity_error = float(np.abs(covariance - np.eye(len(kept))).max())
    return model


def most_frequent_length(vectors: DataFrame) -> int | None:
    lengths = vectors.groupBy(F.size("x").alias("length")).count()
    row = lengths.orderBy(F.desc("count"), "length").first()
    return row["length"] if row else None


_OUT = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(rows: DataFrame, id_column: str, vector_column: str, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component."""
    spark = rows.sparkSession
    named = rows.select(F.col(id_column).cast("long").alias("vec_id"), whole_vectors(F.col(vector_column)).alias("x"))
    named = named.where("x IS NOT NULL")
    dimension = most_frequent_length(named)
    schema = f"vec_id long, {_OUT}"
    if dimension is None:
        return spark.createDataFrame([], schema)
    named = named.where(F.size("x") == dimension)
    model = fit_whitening(named, dimension, components)

    def run(batches):
        size = len(model.values)
        for batch in batches:
            x = matrix_of(batch.column("x"), dimension)
            count = len(x)
            each = pa.array(np.repeat(np.arange(count), size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * size, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(each),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, count) if size else np.zeros(0)),
                    pa.array(np.full(count * size, model.identity_error)),
                ],
                names=schema.replace(" long", "").replace(" int", "").replace(" double", "").split(", "),
            )

    return named.mapInArrow(run, schema)


def op13_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
