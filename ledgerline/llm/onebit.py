"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, scaled to unit length, padded with zeros to CODE_BITS
dimensions (or its own, if more) and rotated at random; the signs of its coordinates
are its code, packed into bits.  With two correction scalars, the centred norm and
the code's inner product with the vector itself, the code estimates inner products
without bias, and the error is bounded with known probability.  A candidate whose
estimated distance less its bound is above the k-th smallest sum of estimate and
bound cannot be among the nearest, but for that probability; the rest are reranked
by exact distances in double precision.

Every vector is coded, and all queries meet all codes, in blocks of bounded size.
Only codes and scalars are copied to the blocks, whatever the vectors' width: a
vector is read again for the candidates that the bounds leave.  A first sweep over a
sample of the codes gives each query a limit, so that few are left in the others.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows with a null id.  Vectors of another dimension than the most common take
no part either.  Ids are of any type that has an order; queries are those whose
number is divisible, so ids that are no numbers are candidates only.  Ties go to
the smaller id; a repeated id counts once per row.  A query's row that stands twice
is asked once; rows with the query's own id are no candidates of it.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.plans.stage import write_stage

#: Rows of a block of candidates and of a block of queries.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 2048
#: Codes that set the queries' first limits.
LIMIT_SAMPLE = 65_536
#: Least bits of a code, and bits of a query's coordinate.
CODE_BITS, QUERY_BITS = 1024, 4
#: Width of the error bound in standard errors.
EPSILON = 3.0
SEED = 20240531
#: Vectors that set the centre.
CENTRE_SAMPLE = 10_000


def rotation(dim: int, bits: int | None = None, seed: int = SEED) -> np.ndarray:
    """(dim, bits): what a random rotation of bits dimensions does to the first dim of them."""
    bits = bits or max(CODE_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, whatever their dimension."""
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_column).alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
            .where(fine).where(F.exists("v", lambda x: x != 0.0)))


def codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, centred norms, inner products of the unit vectors with their codes)."""
    r = (x - centre) @ turn
    norm = np.sqrt((r * r).sum(axis=1))
    unit = r / np.where(norm == 0, 1, norm)[:, None]
    own = np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(unit > 0, axis=1, bitorder="little"), norm, np.where(own == 0, 1, own)


class Asked(NamedTuple):
    """Queries in bit planes: the inner product with a sign code is a weighted count of common bits."""

    planes: np.ndarray  # queries x QUERY_BITS x bytes
    low: np.ndarray
    step: np.ndarray
    norm: np.ndarray
    total: np.ndarray


def ask(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Asked:
    q = (x - centre) @ turn
    norm = np.sqrt((q * q).sum(axis=1))
    unit = q / np.where(norm == 0, 1, norm)[:, None]
    low, top = unit.min(axis=1, initial=0), (1 << QUERY_BITS) - 1
    step = np.maximum((unit.max(axis=1, initial=0) - low) / top, 1e-12)
    levels = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits(levels >> p & 1, axis=1, bitorder="little") for p in range(QUERY_BITS)], axis=1)
    return Asked(planes, low, step, norm, levels.sum(axis=1) * step + turn.shape[1] * low)


def estimates(code: np.ndarray, ones: np.ndarray, norm: np.ndarray, own: np.ndarray, asked: Asked, i: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimated squared distance, its bound) of query i to every code (rows x words)."""
    bits = code.shape[1] * 64
    common = np.zeros(len(code))
    for p in range(QUERY_BITS):
        common += np.bitwise_count(code & asked.planes[i, p].view(np.uint64)[None, :]).sum(axis=1) * float(1 << p)
    dot = (2 * (common * asked.step[i] + ones * asked.low[i]) - asked.total[i]) / np.sqrt(bits)
    scale = 2 * norm * asked.norm[i]
    spread = epsilon * (np.sqrt(np.maximum(1 - own * own, 0)) / np.sqrt(bits - 1) + asked.step[i] / np.sqrt(12)) / own
    return norm**2 + asked.norm[i] ** 2 - scale * dot / own, scale * spread


def smallest(values: np.ndarray, k: int) -> float:
    """The k-th smallest value, infinite if there are fewer."""
    return float(np.partition(values, k - 1)[k - 1]) if len(values) >= k else np.inf


def index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(table of row, vec_id, v, code, norm, own), the centre and the rotation; row is a number of its own for every row."""
    rows = usable(vectors, id_column, vector_column)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"row long, vec_id {kind}, v array<double>, code binary, norm double, own double"
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], schema), np.zeros(1), np.eye(1)
    dim = sizes[0]["d"]
    rows = rows.where(F.size("v") == dim)
    one_in = max(1, sizes[0]["count"] // CENTRE_SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(one_in)) == 0)
    means = sample.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect() or []
    centre = np.zeros(dim)
    for r in means:
        centre[r["i"]] = r["m"]
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            code, norm, own = codes(np.asarray(batch.column(1).flatten()).reshape(-1, dim), centre, turn)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(norm))), *batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(own)],
                                             names=["row", "vec_id", "v", "code", "norm", "own"])
            at += len(norm)

    return write_stage(rows.mapInArrow(run, schema), "one-bit-codes"), centre, turn


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q or to its rows, summed coordinate by coordinate in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - q[..., j]
        total += d * d
    return np.sqrt(total)


def survivors(rows: np.ndarray, own_id: np.ndarray, code: np.ndarray, norm: np.ndarray, own: np.ndarray, query_ids: np.ndarray, asked: Asked,
              limits: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[list[np.ndarray], np.ndarray]:
    """(rows left of each query, its limit): the limit is lowered by the k-th smallest sum of estimate and bound of this block."""
    packed = np.ascontiguousarray(code).view(np.uint64)
    ones = np.bitwise_count(packed).sum(axis=1).astype(float)
    left, lowered = [], np.array(limits, float)
    for i in range(len(query_ids)):
        estimate, bound = estimates(packed, ones, norm, own, asked, i, epsilon)
        others = own_id != query_ids[i]
        lowered[i] = min(lowered[i], smallest((estimate + bound)[others], k))
        left.append(rows[others & (estimate - bound <= lowered[i] + 1e-9)])
    return left, lowered


_QUERY = "q long, q_id long, planes binary, low double, step double, q_norm double, total double"


def _met(rows: pa.Table, queries: pa.Table, k: int, epsilon: float, limits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    fixed = lambda t, c: np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    asked = Asked(fixed(queries, "planes").reshape(queries.num_rows, QUERY_BITS, -1), *[np.asarray(queries[c]) for c in ("low", "step", "q_norm", "total")])
    return survivors(np.asarray(rows["row"]), np.asarray(rows["own_id"]), fixed(rows, "code"), np.asarray(rows["norm"]), np.asarray(rows["own"]),
                     np.asarray(queries["q_id"]), asked, limits, k, epsilon)


def search(vectors: DataFrame, every: int, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each vector whose id is divisible by every, itself left out."""
    table, centre, turn = index(vectors, id_column, vector_column)
    dim, kind = len(centre), table.schema["vec_id"].dataType.simpleString()
    asks = F.coalesce(F.pmod(F.col("vec_id").try_cast("long"), F.lit(every)) == 0, F.lit(False))
    n, m = table.agg(F.count("*"), F.count_if(asks)).first()
    if not m:
        return table.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("norm").alias("score"))
    row_blocks, query_blocks = -(-n // BLOCK_ROWS), -(-m // BLOCK_QUERIES)
    deal = lambda c, blocks: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(blocks)).cast("int")
    copies = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = ask(np.asarray(batch.column(2).flatten()).reshape(-1, dim), centre, turn)
            planes = pa.array([p.tobytes() for p in a.planes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), planes, *map(pa.array, (a.low, a.step, a.norm, a.total))],
                                             names=["q", "q_id", "planes", "low", "step", "q_norm", "total"])

    first = table.where(asks).groupBy("vec_id", "v").agg(F.min("row").alias("row"))  # the same query, asked once
    queries = write_stage(first.select("row", F.xxhash64("vec_id").alias("q_id"), "v").mapInArrow(prepare, _QUERY), "one-bit-queries")
    rows = table.select("row", F.xxhash64("vec_id").alias("own_id"), "code", "norm", "own")
    side = queries.withColumn("qb", deal("q", query_blocks))

    def limit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        q = right["q"].combine_chunks()
        found = _met(left, right, k, epsilon, np.full(len(q), np.inf))[1] if left.num_rows and len(q) else np.full(len(q), np.inf)
        return pa.table({"q": q, "limit": pa.array(found, pa.float64())})

    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // LIMIT_SAMPLE))) == 0).withColumn("qb", copies(query_blocks))
    limits = write_stage(sample.groupBy("qb").cogroup(side.groupBy("qb")).applyInArrow(limit, "q long, limit double"), "one-bit-limits")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"q": pa.array([], pa.int64()), "row": pa.array([], pa.int64())})
        near = _met(left, right, k, epsilon, np.asarray(right["limit"]))[0]
        q = np.repeat(np.asarray(right["q"]), [len(x) for x in near])
        return pa.table({"q": pa.array(q, pa.int64()), "row": pa.array(np.concatenate(near), pa.int64())})

    blocks = rows.withColumn("rb", deal("row", row_blocks)).withColumn("qb", copies(query_blocks))
    asked = side.join(limits, "q").withColumn("rb", copies(row_blocks))
    pairs = blocks.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInArrow(meet, "q long, row long")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = lambda c: np.asarray(c.flatten()).reshape(-1, dim)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(distances(wide(b.column(2)), wide(b.column(3))))], names=["query_id", "vec_id", "score"])

    asking = first.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("q_v"))
    both = pairs.join(table.select("row", "vec_id", "v"), "row").join(asking, "q").where("vec_id <> query_id")
    found = both.select("query_id", "vec_id", "v", "q_v").mapInArrow(rerank, f"query_id {kind}, vec_id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
