"""Whitening of embeddings: eigenvectors in float32, refined in higher precision by matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, written

#: Steps of a unit: entries become whole numbers of 1/256.
STEPS, COMPONENTS = 256, 4
#: Precision of the refinement (on x86 64 bits of mantissa).
HIGH = np.longdouble
#: Whole numbers up to this are exact as float64.
EXACT = 1 << 53
#: Refinements at most; the error falls with its square, so a few are enough.
ROUNDS = 40
#: Sums of products travel as two parts: multiples of 2^62 and the rest.
LIMB = 62
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """`n` distinct grid vectors with sums `sums`; eigenvectors as rows of `vectors`, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None


def grid(vector: Column, steps: int = STEPS) -> Column:
    """Whole numbers floor(steps * entry), or NULL for a vector that is missing, empty or not finite everywhere.

    Entries that leave the range of a long are cut to its ends.
    """
    entry = vector.cast("array<double>")
    fine = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(entry, lambda c: F.floor(c * F.lit(float(steps))).cast("long"))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(entry) > 0), whole)


def matrix_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows of equal length as a matrix."""
    held = batch.column(column)
    return held.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of rows (at -1) and the sum of each dimension of a task's rows."""
    count, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = matrix_of(batch, "x")
            part = _exact(x).sum(axis=0)
            count, total = count + len(x), part if total is None else total + part
    if count:
        values = [Decimal(count), *(Decimal(int(v)) for v in total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "value"])


def _exact(x: np.ndarray) -> np.ndarray:
    """As Python's whole numbers, if sums of a block could leave a long."""
    largest = max(abs(int(x.min())), abs(int(x.max())))
    return x if largest * (len(x) + 1) < 1 << 62 else x.astype(object)


def _products(centre: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of products of centred whole numbers of a task's rows: (i, j, high, low) for i <= j."""
    size = len(centre)
    total = np.zeros((size, size), object)
    for batch in batches:
        x = matrix_of(batch, "x") if batch.num_rows else np.zeros((0, size), np.int64)
        for start in range(0, len(x), BLOCK):
            part = x[start : start + BLOCK]
            far = max(abs(int(part.min()) - max(centre)), abs(int(part.max()) - min(centre)))
            if far * far * len(part) < EXACT:  # products and sums are exact in float64
                z = (part - np.array(centre, np.int64)).astype(np.float64)
                total += (z.T @ z).astype(np.int64).astype(object)
            else:
                z = part.astype(object) - np.array(centre, object)
                total += z.T @ z
    i, j = np.triu_indices(size)
    values = [int(v) for v in total[i, j]]
    if any(values):
        high = [Decimal(v >> LIMB) for v in values]
        low = [Decimal(v & ((1 << LIMB) - 1)) for v in values]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, kind), pa.array(low, kind)], ["i", "j", "high", "low"]
        )


def covariance(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number of rows of `vectors` (x), their sums, and their covariance (divisor n), centred and exact to HIGH.

    Rows are centred at the whole numbers next to the means before they are multiplied; what the means have beyond
    that is taken off exactly at the end. Only sums leave a task: its size depends on the dimension alone.
    """
    totals = map_arrow(vectors, _sums, "i int, value decimal(38,0)").groupBy("i").agg(F.sum("value").alias("value")).collect()
    sums = {row["i"]: int(row["value"]) for row in totals}
    n = sums.pop(-1, 0)
    if not n:
        return 0, [], np.zeros((0, 0), HIGH)
    total = [sums[i] for i in range(len(sums))]
    centre = tuple((2 * s + n) // (2 * n) for s in total)
    parts = map_arrow(vectors, partial(_products, centre), "i int, j int, high decimal(38,0), low decimal(38,0)")
    cells = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    rest = [s - n * c for s, c in zip(total, centre)]
    out = np.zeros((len(total), len(total)), HIGH)
    for row in cells:
        i, j = row["i"], row["j"]
        value = (int(row["high"]) << LIMB) + int(row["low"])
        out[i, j] = out[j, i] = HIGH(str(n * value - rest[i] * rest[j])) / HIGH(str(n)) / HIGH(str(n))
    return n, total, out


def _symmetric(matrix: np.ndarray) -> np.ndarray:
    return (matrix + matrix.T) / 2


def refined_eigenvectors(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix in HIGH precision.

    The first vectors come from float32. Each round is one step of Ogita and Aishima: from R = I - X'X and S = X'AX it
    takes eigenvalues, and a correction E of X such that X + XE has an error of the order of the square. Eigenvalues that
    are closer than the error of the step form a cluster: there the step only makes the vectors orthogonal, and the
    cluster's own small problem, shifted to its mean so that its differences keep their digits, is solved and turns the
    vectors. What rounding turns in a narrow gap is made orthogonal again at the end of the round. Equal eigenvalues stay a cluster; any orthogonal vectors of it are right.
    """
    size = len(matrix)
    scale = np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(size, HIGH), np.eye(size, dtype=HIGH)
    a = matrix / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    tiny = HIGH(np.finfo(HIGH).eps)
    norm = np.sqrt((a * a).sum())
    for _ in range(rounds):
        r, s = (_symmetric(m) for m in (np.eye(size, dtype=HIGH) - x.T @ x, x.T @ (a @ x)))
        values = np.diag(s) / (1 - np.diag(r))
        rest = s - np.diag(values)
        if np.abs(r).max() <= 4 * size * tiny and np.abs(rest).max() <= 4 * size * tiny * norm:
            break
        delta = 2 * (np.sqrt((rest**2).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > delta
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(values)
        ends = [0, *(np.flatnonzero(np.diff(values[order]) > delta) + 1).tolist(), size]
        for start, end in zip(ends, ends[1:]):
            if end - start > 1:
                some = order[start:end]
                mean = values[some].mean()
                small = _symmetric(x[:, some].T @ (a @ x[:, some] - mean * x[:, some]))
                width = np.abs(small).max()
                if width > 8 * size * tiny * norm:
                    turn = np.linalg.eigh((small / width).astype(np.float64))[1].astype(HIGH)
                    x[:, some] = x[:, some] @ turn
        x = x + x @ _symmetric(np.eye(size, dtype=HIGH) - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _whitened(model: Whitening, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `deviation` and `whitened` of each row."""
    n, sums, shown = model.n, np.array(model.sums, object), len(model.vectors)
    scaled = np.array([v / (np.sqrt(HIGH(e)) * n) if e > 0 else np.full(len(v), np.nan) for v, e in zip(model.vectors, model.values)])
    scaled = scaled.astype(np.float64).reshape(shown, len(model.sums))
    reach = max((abs(s) for s in model.sums), default=0)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            x = matrix_of(part, "x")
            far = n * max(abs(int(x.min())), abs(int(x.max()))) + reach
            if far * far * len(sums) < 1 << 63:
                y = x * n - sums.astype(np.int64)
                deviation = pa.array((y * y).sum(axis=1))
            else:
                y = x.astype(object) * n - sums
                deviation = pa.array([d if d < 1 << 63 else None for d in map(int, (y * y).sum(axis=1))], pa.int64())
            white = pa.array((y.astype(np.float64) @ scaled.T).ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * shown, pa.int32()), white)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], deviation, lists], [*part.schema.names[:-1], "deviation", "whitened"])


def fit_whitening(vectors: DataFrame, vector_column: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> Whitening:
    """The whitening of the distinct grid vectors of a column, each counted once.

    Vectors that are missing, empty or not finite everywhere are left out; so are vectors of another length than the
    most frequent one (of equally frequent ones the longest). Components without variance have no whitened values.
    `identity_error` is the largest entry of the whitened values' covariance minus the identity, over the fit list.
    Memory of the driver grows with the square of the dimension only.
    """
    x = vectors.select(grid(F.col(vector_column), steps).alias("x")).filter("x is not null")
    lengths = x.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", "size")).alias("most")).first()["most"]
    if most is None:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, None)
    fit = written(x.filter(F.size("x") == most["size"]).distinct(), "fit-list")
    n, sums, matrix = covariance(fit)
    values, columns = refined_eigenvectors(matrix)
    trace = np.trace(matrix)
    real = values > trace * len(sums) * np.finfo(np.float64).eps
    values = np.where(real, values, 0)[:components]
    model = Whitening(n, tuple(sums), columns.T[:components], values, float(trace), None)
    shown = np.flatnonzero(values > 0).tolist()
    pairs = [(i, j) for i in shown for j in shown if i <= j]
    if not pairs:
        return model
    white = map_arrow(fit, partial(_whitened, model), "deviation long, whitened array<double>")
    moments = white.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"m{i}_{j}") for i, j in pairs)).first()
    error = max(abs(moments[f"m{i}_{j}"] - (i == j)) for i, j in pairs)
    return Whitening(model.n, model.sums, model.vectors, model.values, model.trace, float(error))


def whitened_rows(
    df: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding", steps: int = STEPS
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is missing, empty, not finite everywhere or of another length than the fit's give none. Rows that
    repeat an id, or have none, give rows of their own. `deviation` is NULL where it does not fit a long; `whitened` is
    NULL for a component without variance. Other columns of the input are not read; an empty table gives none.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), grid(F.col(vector_column), steps).alias("x"))
    rows = rows.filter(F.size("x") == len(model.sums)).filter("x is not null")
    rows = map_arrow(rows, partial(_whitened, model), f"id {kind}, deviation long, whitened array<double>")
    explained = [float(e / HIGH(model.trace)) if model.trace > 0 else None for e in model.values]
    rows = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", F.array(*(F.lit(e).cast("double") for e in explained))[F.col("at")].alias("explained") if explained
        else F.lit(None).cast("double").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
