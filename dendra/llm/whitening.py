"""Whitening of embedding vectors: rotation onto the eigenvectors of the covariance, each component scaled to variance one.

1. Each partition computes count, local mean (from the exact sum) and centred scatter of its vectors, an Arrow batch at a time. Two such states merge by
   Chan's formula: the scatters add up, with the outer product of the difference of the means. Nothing is squared before it is centred,
   so vectors far from zero lose no digits. ``treeReduce`` merges the states, a few at a time, so the driver gets a few states, whatever the
   number of partitions.
2. The driver takes the eigenvectors of one matrix of the vectors' width (``eigh``).
3. The vectors are projected in a second pass and written; the same states over the written components verify that their covariance
   is the identity.

Whole vectors are scaled to whole numbers first; sums and the deviation are exact, in whole numbers of any size.

Defined cases: vectors that are null or hold a null or non-finite entry are dropped. Vectors of several widths are whitened apart, each width
by its own fit. A component without variance (below RANK of the largest eigenvalue) has ``whitened`` null and takes no
part in the check; with no component left the check is null. Ties of eigenvalues leave the components in the order that
``eigh`` gives, the same for all rows. Null ids and repeated rows stay rows; repeated vectors count as often as they occur. Columns of the
input named as a result are replaced, others pass through. An empty table, or one without vectors, gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendra.llm.common import need, written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Eigenvalues below this share of the largest are no variance but rounding.
RANK = 1e-12
#: States that one step of the tree merges, and so the most that reach the driver.
FAN = 8
#: Entries below this are summed and squared as 64-bit numbers, others as whole numbers of any size.
PLAIN = 1 << 45
#: Values of a decimal(38).
WIDEST = 10**38


class State(NamedTuple):
    """Of some vectors: count, sums (whole numbers of any size, or doubles) and centred scatter."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and rest; of whole numbers neither is rounded but once."""
        base = self.total // self.n
        return base, ((self.total - base * self.n) / self.n).astype(float)


def state_of(x: np.ndarray) -> State:
    """The state of the rows of ``x``: whole numbers or doubles."""
    total = x.sum(axis=0) if x.dtype == float else x.sum(axis=0).astype(object)
    base, rest = State(len(x), total, None).mean()
    centred = (x - base.astype(x.dtype)).astype(float) - rest
    return State(len(x), total, centred.T @ centred)


def merged(a: State, b: State) -> State:
    """Chan's formula."""
    (base, rest), (other, more) = a.mean(), b.mean()
    apart = (other - base).astype(float) + (more - rest)
    return State(a.n + b.n, a.total + b.total, a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / (a.n + b.n)))


def both(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    """States by width, merged."""
    return a | {w: merged(a[w], s) if w in a else s for w, s in b.items()}


class Fit(NamedTuple):
    """Of the vectors of one width: their state's count and sums, components (columns, by falling eigenvalue), eigenvalues, trace."""

    n: int
    total: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float


def fit_of(state: State, components: int) -> Fit:
    """Eigenvectors of the covariance; the entry of largest magnitude of each is positive."""
    values, axes = np.linalg.eigh(state.scatter / state.n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    lead = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] if len(axes) else np.ones(0)
    return Fit(state.n, state.total, axes * np.where(lead < 0, -1.0, 1.0), values, float(np.trace(state.scatter)) / state.n)


def usable(vector: str) -> Column:
    """True where a vector takes part."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(F.coalesce(F.col(vector), F.array().cast("array<double>")), bad)


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, entries as doubles) for each width of the lists of ``column``."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        yield at, flat[starts[at][:, None] + np.arange(width)]


def whole(entries: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * entry) + offset: 64-bit numbers where all are small, else whole numbers of any size."""
    scaled = np.floor(scale * entries)
    if not scaled.size or np.abs(scaled).max() < PLAIN:
        return scaled.astype(np.int64) + offset
    big = [[(math.floor(v) if math.isfinite(v) else scale * int(e)) + offset for v, e in zip(x, y)] for x, y in zip(scaled.tolist(), entries.tolist())]
    return np.array(big, dtype=object).reshape(entries.shape)


def states(vectors: DataFrame, column: str, integral: bool) -> dict[int, State]:
    """The state of all lists in ``column``, by width. integral: scale and floor them first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, State] = {}
        for batch in batches:
            for _, entries in by_width(batch.column(0)):
                own = both(own, {entries.shape[1]: state_of(whole(entries) if integral else entries)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["state"])

    partials = vectors.select(column).mapInArrow(run, "state binary").rdd
    parts = partials.getNumPartitions()
    return partials.map(lambda r: pickle.loads(r["state"])).treeReduce(both, max(2, math.ceil(math.log(parts, FAN)))) if parts else {}


def projected(x: np.ndarray, fit: Fit) -> tuple[list[Decimal | None], np.ndarray]:
    """Exact squared deviations (sum of (n * x - total)^2; none beyond 38 digits) and whitened components of the rows of ``x``."""
    n, total = fit.n, fit.total
    most = n * max((abs(int(v)) for v in (x.max(), x.min())), default=0) + max(map(abs, total), default=0) if x.size else 0
    if most < 1 << 62:
        apart = n * x.astype(np.int64) - total.astype(np.int64)
        largest = int(np.abs(apart).max()) if apart.size else 0
        exact = apart if largest**2 * max(1, x.shape[1]) < 1 << 62 else apart.astype(object)
    else:
        apart = exact = n * x.astype(object) - total
    squares = [int(v) for v in (exact * exact).sum(axis=1)]
    kept = fit.values > RANK * max(fit.values, default=0)
    out = np.full((len(x), len(fit.values)), np.nan)
    out[:, kept] = (apart.astype(float) / n) @ fit.axes[:, kept] / np.sqrt(fit.values[kept])
    return [Decimal(s) if s < WIDEST else None for s in squares], out


RESULTS = {"n": "long", "deviation": "decimal(38,0)", "whitened": "array<double>", "explained": "array<double>"}


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``vectors`` that take part, with their columns (or those of ``keep``) and ``n`` (vectors of the fit), ``deviation`` (sum over
    dimensions of (n * x - sum)^2), ``whitened`` (components by falling eigenvalue), ``explained`` (each one's share of the variance) and ``identity_error`` (largest
    entry, in magnitude, of the covariance of ``whitened`` less the identity; one value)."""
    need(vectors, vector)
    kept = [c for c in (vectors.columns if keep is None else keep) if c not in (*RESULTS, "identity_error")]
    own = vectors.where(usable(vector))
    fits = {w: fit_of(s, components) for w, s in states(own, vector, True).items()}
    wide = T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in RESULTS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple | None] = [None] * batch.num_rows
            for at, entries in by_width(batch.column(len(kept))):
                fit = fits[entries.shape[1]]
                share = [float(v) / fit.trace if fit.trace > 0 else None for v in fit.values]
                squares, white = projected(whole(entries), fit)
                for i, square, x in zip(at.tolist(), squares, white.tolist()):
                    rows[i] = (fit.n, square, [None if v != v else v for v in x], share)
            columns = list(zip(*rows)) if rows else [()] * 4
            types = (pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*kept, *RESULTS])

    seen = own.select(*kept, F.col(vector).alias("__dn_vector"))
    out = written(seen.mapInArrow(run, T.StructType([*vectors.select(*kept).schema.fields, *wide.fields])), "whitened")
    return out.withColumn("identity_error", F.lit(identity_error(out)).cast("double"))


def identity_error(whitened: DataFrame) -> float | None:
    """Of the components that have variance."""
    real = whitened.select(F.filter("whitened", lambda x: x.isNotNull()).alias("x")).where(F.size("x") > 0)
    errors = [float(np.abs(s.scatter / s.n - np.eye(w)).max()) for w, s in states(real, "x", False).items()]
    return max(errors, default=None)
