"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Every entry ``c`` becomes the integer ``x = floor(256 c)``. The fit is over distinct x vectors, each once:

1. Each task adds up the rows it has and their products about its own mean; the moments of all tasks are merged
   by the usual update for means, so that nothing is multiplied before it is centred. Sums are integers and exact.
2. The scatter, of the vectors' dimension squared, is factored on the driver: Cholesky with the largest remaining
   diagonal entry as pivot, up to the numerical rank, gives ``S = L L'`` with as many columns as there are directions.
3. One-sided Jacobi rotates pairs of columns of ``L`` until all are orthogonal, a round of disjoint pairs at a time. Then
   the squared norm of a column is an eigenvalue of ``S``, and the column itself, normalised, its eigenvector. Working on
   the factor keeps small eigenvalues to full relative precision, which forming ``L' L`` would lose.

Rows are projected by a broadcast of the leading components. ``identity_error`` is measured on the whitened values of the
fit list, not derived from the model.

Rows whose vector is null, empty or holds null or non-finite entries take no part. Vectors of different dimensions are
fitted apart, each with the numbers of its own dimension. A component without variance (fewer distinct vectors than
components, say) cannot be scaled and has no rows, so a table with one distinct vector gives an empty result, as an empty
table does. Entries beyond 64-bit integers are set to the nearest such; ``deviation`` is null where it passes 64 bits. Repeated
rows and null ids each give their own rows; equal eigenvalues leave their components free to turn, the same for all
rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaforge.llm.tables import release, stored

SCALE = 256
COMPONENTS = 4
#: Rows whose moments are added up at once.
BLOCK = 4096
#: Columns count as orthogonal when their cosine is below this.
ORTHOGONAL = 1e-15
SWEEPS = 60
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def integers(entries: np.ndarray) -> np.ndarray:
    """``floor(256 c)`` as 64-bit integers, at most as large as those can be."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * entries.astype(np.float64))
    out = np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)
    out[x >= 2.0**62] = [min(int(v), _MOST) if np.isfinite(v) else _MOST for v in x[x >= 2.0**62]]
    out[x <= -(2.0**62)] = [max(int(v), _LEAST) if np.isfinite(v) else _LEAST for v in x[x <= -(2.0**62)]]
    return out


def packed(row: np.ndarray) -> bytes:
    """A vector in the smallest of four integer widths that holds it, so that equal vectors are equal bytes."""
    low, high = int(row.min()), int(row.max())
    for width in (1, 2, 4):
        if -(1 << 8 * width - 1) <= low and high < 1 << 8 * width - 1:
            return bytes([width]) + row.astype(f"<i{width}").tobytes()
    return b"\x08" + row.astype("<i8").tobytes()


def unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<i{value[0]}", offset=1).astype(np.int64)


def _by_dim(batch: pa.RecordBatch, column: int):
    """Row numbers and the matrix of integers, dimension by dimension."""
    vectors = batch.column(column)
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.empty(0, np.int64)
    flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, integers(flat[starts[at][:, None] + np.arange(dim)])


@dataclass
class Moments:
    """Number of rows, exact sums, and products about the mean."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        """Of a block of integers or of doubles."""
        if rows.dtype.kind == "i":
            high, low = (rows >> 32).sum(0), (rows & 0xFFFFFFFF).sum(0)
            sums = [(a << 32) + b for a, b in zip(high.tolist(), low.tolist())]
        else:
            sums = rows.sum(0).tolist()
        y = rows - np.array([s / len(rows) for s in sums])
        return Moments(len(rows), sums, y.T @ y)

    def add(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = np.array([a / self.n - b / other.n for a, b in zip(self.sums, other.sums)])
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n))
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], scatter)


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """``dim, x``: each distinct vector of integers once, packed."""

    def run(batches):
        for batch in batches:
            for dim, _, x in _by_dim(batch, 0):
                columns = [pa.array(np.full(len(x), dim, np.int32)), pa.array([packed(r) for r in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "x"])

    # Spark removes repetitions within each task before it shuffles, so a vector in a third of all rows is no burden.
    return rows.select(vector).mapInArrow(run, "dim int, x binary").dropDuplicates()


def merged(found: DataFrame, dims: int | None = None) -> dict[int, Moments]:
    """Moments of each dimension from ``dim, turn, moments`` of the tasks, in two steps; see :func:`as_rows`."""

    def run(batches):
        held: dict[int, Moments] = {}
        for batch in batches:
            for row in batch.to_pylist():
                _keep(held, row["dim"], _from_row(row))
        if held:
            yield as_rows(held)

    groups = max(1, int(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    # Each task's row is of bounded size, the dimension squared, and so is what is left at the end.
    half = found.repartition(groups).mapInArrow(run, _MOMENTS)
    out: dict[int, Moments] = {}
    for row in half.toLocalIterator():
        _keep(out, row["dim"], _from_row(row.asDict()))
    return out


_MOMENTS = "dim int, n long, whole boolean, sums array<string>, scatter binary"


def as_rows(held: dict[int, Moments]) -> pa.RecordBatch:
    """Sums as text: exact integers of any size, or doubles that read back the same."""
    ks = sorted(held)
    columns = [
        pa.array(ks, pa.int32()), pa.array([held[k].n for k in ks], pa.int64()),
        pa.array([isinstance(held[k].sums[0], int) for k in ks]),
        pa.array([list(map(repr, held[k].sums)) for k in ks], pa.list_(pa.string())),
        pa.array([held[k].scatter.tobytes() for k in ks], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["dim", "n", "whole", "sums", "scatter"])


def _from_row(row: dict) -> Moments:
    sums = [int(s) if row["whole"] else float(s) for s in row["sums"]]
    return Moments(row["n"], sums, np.frombuffer(bytes(row["scatter"])).reshape(len(sums), -1))


def _keep(held: dict[int, Moments], dim: int, found: Moments) -> None:
    held[dim] = held[dim].add(found) if dim in held else found


def moments(fit: DataFrame, project=None) -> dict[int, Moments]:
    """Moments of the fit list, or of what ``project(dim, x)`` makes of its rows."""

    def run(batches):
        held: dict[int, Moments] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                values = batch.column(1).filter(pa.array(dims == dim)).to_pylist()
                for start in range(0, len(values), BLOCK):
                    x = np.array([unpacked(v) for v in values[start : start + BLOCK]])
                    rows = project(dim, x) if project else x
                    if rows.shape[1]:
                        _keep(held, dim, Moments.of(rows))
        if held:
            yield as_rows(held)

    return merged(fit.mapInArrow(run, _MOMENTS))


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``L``, in the order of the given rows, with as many columns as the numerical rank, and ``L L' = scatter``."""
    rest = scatter.astype(np.float64).copy()
    size = len(rest)
    factor = np.zeros((size, size))
    floor = size * np.finfo(float).eps * max(rest.diagonal().max(), 0.0)
    done = np.zeros(size, bool)
    for k in range(size):
        diagonal = np.where(done, -np.inf, rest.diagonal())
        pivot = int(diagonal.argmax())
        if diagonal[pivot] <= floor:
            return factor[:, :k]
        column = np.where(done, 0.0, rest[:, pivot]) / math.sqrt(diagonal[pivot])
        factor[:, k] = column
        rest -= np.outer(column, column)
        done[pivot] = True
    return factor


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns in rounds of disjoint ones, as in a tournament."""
    players = list(range(n)) + ([-1] if n % 2 else [])
    half, out = len(players) // 2, []
    for _ in range(len(players) - 1):
        pairs = [(a, b) for a, b in zip(players[:half], players[::-1][:half]) if a >= 0 and b >= 0]
        out.append(tuple(np.array(side, np.int64) for side in zip(*pairs)))
        players = [players[0], players[-1], *players[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared column norms, falling, and unit columns, after rotating columns until all are orthogonal."""
    a = factor.copy()
    pairs = rounds_of_pairs(a.shape[1]) if a.shape[1] > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for left, right in pairs:
            p, q = a[:, left], a[:, right]
            pp, qq, pq = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            cosine = np.abs(pq) / np.sqrt(pp * qq)
            worst = max(worst, float(cosine.max()))
            turn = cosine > ORTHOGONAL
            if not turn.any():
                continue
            safe = np.where(turn, pq, 1.0)
            zeta = (qq - pp) / (2 * safe)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, left], a[:, right] = c * (p - t * q), c * (q + t * p)
        if worst <= ORTHOGONAL * 10:
            break
    norms = (a * a).sum(0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], a[:, order] / np.sqrt(norms[order])


@dataclass
class Model:
    """``values`` and ``components`` (columns) of the covariance, by falling value."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    def __post_init__(self):
        self.mean = np.array([s / self.n for s in self.sums])
        self.length2 = sum(s * s for s in self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.components) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of ``(n x - S)^2``."""
        most = int(np.abs(x.astype(np.float64)).max()) + 1 if x.size else 0
        widest = max(map(abs, self.sums)) + 1
        if x.shape[1] * most * max(most, widest) < 1 << 62:
            squares, products = (x * x).sum(1).tolist(), (x @ np.array(self.sums, np.int64)).tolist()
            out = [self.n * self.n * a - 2 * self.n * b + self.length2 for a, b in zip(squares, products)]
        else:
            out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v <= _MOST else None for v in out]


def model_of(found: Moments, components: int) -> Model:
    values, columns = one_sided_jacobi(pivoted_cholesky(found.scatter))
    trace = float(found.scatter.trace())
    return Model(found.n, found.sums, trace / found.n, values[:components] / found.n, columns[:, :components])


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each dimension. The list of distinct vectors is written once and deleted again."""
    distinct = stored(fit_list(rows, vector), "distinct")
    models = {dim: model_of(m, components) for dim, m in moments(distinct).items()}
    shared = rows.sparkSession.sparkContext.broadcast(models)
    for dim, m in moments(distinct, lambda dim, x: shared.value[dim].whitened(x)).items():
        models[dim].identity_error = float(np.abs(m.scatter / m.n - np.eye(len(m.sums))).max())
    release(distinct)
    return models


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row and component."""
    v = F.col(vector).cast("array<double>")
    rows = embeddings.select(F.col(key).alias("key"), v.alias("v")).where(usable(F.col("v")))
    models = rows.sparkSession.sparkContext.broadcast(fit(rows, "v", components))

    def run(batches):
        for batch in batches:
            for dim, at, x in _by_dim(batch, 1):
                model = models.value[dim]
                k = len(model.values)
                if not k:
                    continue
                whole = np.tile(model.values / model.trace, len(at))
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(whole), model.n)), pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(model.whitened(x).ravel()), pa.array(whole), pa.array(np.full(len(whole), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = embeddings.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
