"""Embedding whitening by a bidiagonal qd solver over a blockwise QR.

Entries become integers, floor(64 c) + 1,000,000, whose sums are exact.  Centred
rows are reduced block by block to triangular factors, which are stacked and
reduced again in groups until one is left; its singular values and right singular
vectors (module qd) are those of all centred rows, without a product of the rows
with themselves.  Whitened coordinates are projections over the root of the
eigenvalue; their covariance is measured over all rows.

Vectors that are null, empty or hold null or non-finite entries take no part, nor
do vectors of another dimension than the most common (of equally common ones, the
larger).  Null and repeated ids are kept, each row counts.  Entries beyond 2^46 are
taken as 2^46.  Components whose eigenvalue is zero to double precision are left
out, as nothing can be scaled to unit variance there: one row, equal rows or an
empty table give no rows.  Only the id and vector columns are read.

The driver holds one triangular factor, the square of the dimension.
"""

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.qd import singular_pairs
from ledgerline.plans.stage import write_stage

SCALE, OFFSET, MOST_ENTRY = 64.0, 1_000_000, 1 << 46
#: Rows held at once by a task, and factors stacked at once by a merging task.
BLOCK_ROWS, FAN_IN = 4096, 16
COMPONENTS = 32


@dataclasses.dataclass(frozen=True)
class Whitening:
    """n, exact sums per dimension, eigenvalues and explained shares (falling), components (columns), identity error."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    explained: np.ndarray
    components: np.ndarray
    identity_error: float


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(rows (vec_id, v) that take part, their dimension)."""
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0").where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("v") == dim), dim


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their integer entries), at most BLOCK_ROWS at once; the vectors are the last column."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(at, BLOCK_ROWS)
            c = np.asarray(batch.column(batch.num_columns - 1).flatten(), dtype=np.float64).reshape(-1, dim)
            yield batch, np.floor(np.clip(SCALE * c, -MOST_ENTRY, MOST_ENTRY)).astype(np.int64) + OFFSET


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they hold it, Python's otherwise."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    top = int(np.abs(y).max()) if y.size else 0
    if top * top * y.shape[1] < 1 << 62:
        return (y.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [int(s) for s in (y.astype(object) ** 2).sum(axis=1)]


def _merged(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], name: str) -> np.ndarray | None:
    """One array of the parts (id, values), merged in groups of FAN_IN round after round; each round is a written table."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        return pd.DataFrame({"id": [key[0]], "values": [merge([np.asarray(v) for v in group["values"]])]})

    while True:
        parts = write_stage(parts, name)
        most = parts.agg(F.max("id")).first()[0]
        if most is None:
            return None
        if most == 0:
            return np.asarray(parts.first()["values"])
        parts = parts.groupBy(F.floor(F.col("id") / FAN_IN).cast("int").alias("id")).applyInPandas(run, "id int, values array<double>")


def _sums(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch, x in _blocks(batches, dim):
            n, total = n + batch.num_rows, total + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dim)], pa.int32()), pa.array([str(n), *map(str, total)])], names=["i", "x"])

    got = rows.select("v").mapInArrow(run, "i int, x string").groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    found = {r["i"]: int(r["x"]) for r in got}
    return found.get(-1, 0), tuple(found.get(i, 0) for i in range(dim))


def _factor(rows: DataFrame, dim: int, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The triangular factor of all centred rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for _, x in _blocks(batches, dim):
            r = np.linalg.qr(np.vstack([r, _deviations(x, n, sums).astype(float) / n]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["id", "values"])

    stack = lambda rs: np.linalg.qr(np.vstack([r.reshape(-1, dim) for r in rs]), mode="r").ravel()
    r = _merged(rows.select("v").mapInArrow(run, "id int, values array<double>"), stack, "whitening-factors")
    r = np.zeros((0, dim)) if r is None else r.reshape(-1, dim)
    return np.vstack([r, np.zeros((dim - len(r), dim))])


def _project(x: np.ndarray, n: int, sums: tuple[int, ...], components: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = _deviations(x, n, sums)
    return y, (y.astype(float) / n) @ (components / np.sqrt(values))


def _identity_error(rows: DataFrame, dim: int, n: int, sums: tuple[int, ...], components: np.ndarray, values: np.ndarray) -> float:
    """Largest entry of whitened's covariance less the identity; blocks are centred on their means before they are multiplied."""
    k = len(values)

    def join(parts: list[np.ndarray]) -> np.ndarray:
        parts = [p for p in parts if p[0]]
        if not parts:
            return np.zeros(1 + k + k * k)
        count = sum(p[0] for p in parts)
        mean = sum(p[0] * p[1:k + 1] for p in parts) / count
        off = [p[1:k + 1] - mean for p in parts]
        return np.concatenate([[count], mean, sum(p[k + 1:] + p[0] * np.outer(o, o).ravel() for p, o in zip(parts, off))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch, x in _blocks(batches, dim):
            w = _project(x, n, sums, components, values)[1]
            mean = w.mean(axis=0)
            total = join([total, np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["id", "values"])

    total = _merged(rows.select("v").mapInArrow(run, "id int, values array<double>"), join, "whitening-identity")
    return float(np.abs(total[k + 1:].reshape(k, k) / n - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(rows that take part, the whitening learned from all of them)."""
    rows, dim = usable(vectors, id_column, vector_column)
    n, sums = _sums(rows, dim) if dim else (0, ())
    if not n:
        return rows, Whitening(0, sums, np.zeros(0), np.zeros(0), np.zeros((dim, 0)), 0.0)
    factor = _factor(rows, dim, n, sums)
    squares, directions = singular_pairs(factor, components)
    values = squares / n
    if not len(values):
        return rows, Whitening(n, sums, values, values, directions, 0.0)
    # centred rows are known to about the precision of their sums; what lies below is noise
    trace = float((factor ** 2).sum()) / n
    error = _identity_error(rows, dim, n, sums, directions, values)
    return rows, Whitening(n, sums, values, values / trace, directions, error)


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>): one row a vector; deviation is exact, null beyond 38 digits."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    dim, k, n, sums = len(model.sums), len(model.values), model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dim):
            y, w = _project(x, n, sums, model.components, model.values)
            white = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(str, _squares(y)), pa.string()), white], names=["vec_id", "deviation", "whitened"])

    if not k:
        return rows.limit(0).select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.col("v").alias("whitened"))
    told = rows.mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>")
    return told.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))
