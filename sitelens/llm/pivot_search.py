"""Exact search by inner product with a table of pivot distances.

A component x becomes floor(64 x). With d the Euclidean distance,
``<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2``, and the triangle inequality gives
``d(q, x) >= max over pivots p of |d(q, p) - d(x, p)|``. So the table of distances to
PIVOTS pivots bounds every inner product from above without reading the vector. The
origin is one of the pivots, which brings in the bound |q| |x|.

1. Pivots are picked far from each other from SAMPLE rows at most (those of least
   hash); they decide how much work is saved, never what is found.
2. Rows with their distances are ordered by their nearest pivot and the distance to
   it, and packed into blocks of about BLOCK_ROWS. A block knows the least and the
   greatest distance to each pivot and its greatest norm. Queries make blocks of
   their own in the same way.
3. Every block of queries first meets the block of rows that its box allows most. The
   k-th score of a query found there is its limit.
4. It meets another block only if their boxes allow a score that reaches the least
   limit of its queries. Inside, each query takes the rows in the order of their
   bounds and stops exactly when the bound is below its k-th score.
5. Each meeting gives k rows per query at most; the first k of them all are the result.

Blocks are dealt out by Spark's joins, many to a task and each of bounded size; boxes
are small rows (one for BLOCK_ROWS vectors), and only pairs of boxes are compared all
with all. Bounds are floats with a margin for rounding; scores are exact integers.

Defined results: vectors that are null or hold null, NaN or infinite components take no
part, nor do rows without an id. Shorter vectors count as padded with zeros; an empty
one scores 0. Components whose 64-fold leaves 64 bits saturate, and so do scores. Equal
vectors and repeated ids are rows like others: a row is left out of its own list only.
Ties go to the smaller id. Other columns are not read. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import written

FACTOR, TOP = 64, 20
PIVOTS, SAMPLE = 12, 2000
BLOCK_ROWS, BLOCK_NUMBERS, STEP = 4096, 1 << 21, 256  # rows and components of a block; rows that are scored at once
EXACT = ((2.0**23, np.float32), (2.0**52, np.float64), (2.0**62, np.int64))  # sums below are exact in these numbers
MOST = np.finfo(np.float64).max
BLOCK = ("block bigint, n bigint, dims int, ids binary, rows binary, vectors binary, distances binary, "
         "near array<double>, far array<double>, norm double")
HIT = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v, query) of the rows that take part; ``v`` are integers, ``row`` tells rows apart."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"), finite.alias("finite")).filter(
        "vec_id IS NOT NULL AND finite")
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id",
                       F.transform("x", lambda c: F.floor(c * FACTOR)).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros to ``dims`` columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def pick_pivots(rows: DataFrame, dims: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """The origin, and rows of a sample that lie far from all pivots before them."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).select("v").toArrow()["v"]
    points = matrix(some, dims).astype(np.float64)
    chosen = np.zeros((1, dims))
    nearest = distances(points, chosen)[:, 0]
    while len(chosen) < pivots and len(points) and nearest.max() > 0:
        chosen = np.vstack([chosen, points[nearest.argmax()]])
        nearest = np.minimum(nearest, distances(points, chosen[-1:])[:, 0])
    return chosen


def placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their distances to all pivots, the nearest pivot and the distance to that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("v"), pivots.shape[1]), pivots)
            table = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, table, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))],
                                  names=[*batch.schema.names, "d", "cell", "reach"])

    return rows.mapInArrow(run, "row bigint, vec_id bigint, v array<bigint>, d array<double>, cell int, reach double")


def packed(placed_rows: DataFrame, dims: int, parts: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows that lie beside each other, with their boxes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                part = batch.slice(lo, block_rows)
                x = matrix(part.column("v"), dims)
                d = np.stack(part.column("d").to_numpy(zero_copy_only=False))
                values = [number, len(x), dims, part.column("vec_id").to_numpy().tobytes(), part.column("row").to_numpy().tobytes(),
                          x.tobytes(), d.tobytes(), d.min(axis=0).tolist(), d.max(axis=0).tolist(), float(d[:, 0].max())]
                yield pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in BLOCK.split(", ")), values, strict=True))], schema=SCHEMA)
                number += 1

    # a block is part of an Arrow batch; batches of sorted partitions hold rows that lie beside each other
    return placed_rows.repartitionByRange(max(1, parts), "cell", "reach", "row").sortWithinPartitions("cell", "reach", "row").mapInArrow(run, BLOCK)


SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("dims", pa.int32()), *[(c, pa.binary()) for c in ("ids", "rows", "vectors", "distances")],
                    ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64())), ("norm", pa.float64())])


def margin(square: np.ndarray) -> np.ndarray:
    """More than rounding can take from a bound: a distance is off by 1e-8 of the norms at most, twice a gap times that counts."""
    return 1e-6 * square + 1e-6


def bounds(q_norm: np.ndarray, norms: np.ndarray, gap: np.ndarray) -> np.ndarray:
    square = q_norm * q_norm + norms * norms
    return (square - gap * gap) / 2 + margin(square)


class Products:
    """Exact inner products of the rows of a block, in the cheapest numbers that hold them."""

    def __init__(self, x: np.ndarray, q: np.ndarray) -> None:
        # the sum of |x| of a row times the greatest |q| bounds every partial sum
        most = np.abs(x).sum(axis=1, dtype=np.float64).max(initial=0) * np.abs(q.astype(np.float64)).max(initial=0)
        kind = next((k for limit, k in EXACT if most < limit), object)
        self.x, self.q = x.astype(kind), q.astype(kind)

    def of(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Scores of query ``i`` with ``rows``; of many it is cheaper to take all than to gather them."""
        scores = (self.x @ self.q[i])[rows] if 4 * len(rows) > len(self.x) else self.x[rows] @ self.q[i]
        if scores.dtype == object:
            return np.array([min(max(int(s), 1 - 2**63), 2**63 - 1) for s in scores], np.int64)
        return scores.astype(np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((rows, ids, -scores))[:top]


def search(q: dict, c: dict, limits: np.ndarray, top: int) -> Iterator[tuple]:
    """For each query of a block: its first rows of the other block that reach its limit.

    Rows are scored in the order of their bounds, in steps that grow; none is left out
    whose bound reaches the k-th score so far.
    """
    products, norms = Products(c["vectors"], q["vectors"]), c["distances"][:, 0]
    table = np.ascontiguousarray(c["distances"].T)
    for i in range(len(q["ids"])):
        gap = np.abs(table[0] - q["distances"][i, 0])
        for pivot in range(1, len(table)):
            np.maximum(gap, np.abs(table[pivot] - q["distances"][i, pivot]), out=gap)
        bound = bounds(q["distances"][i, 0], norms, gap)
        bound[c["rows"] == q["rows"][i]] = -np.inf
        scores, at, least, step = np.empty(0, np.int64), np.empty(0, np.int64), limits[i], STEP
        able = np.flatnonzero(bound >= max(least, -MOST))
        while len(able):
            if len(able) > step:
                order = np.argpartition(-bound[able], step)
                able, later = able[order[:step]], able[order[step:]]
            else:
                later = able[:0]
            new = products.of(i, able)
            good = new >= least
            scores, at = np.r_[scores, new[good]], np.r_[at, able[good]]
            best = first_of(scores, c["ids"][at], c["rows"][at], top)
            scores, at = scores[best], at[best]
            if len(scores) == top:
                least = max(least, float(scores[-1]))
            able, step = later[bound[later] >= least], 4 * step
        yield i, c["ids"][at], scores


def opened(batch: pa.RecordBatch, side: str, k: int) -> dict:
    get = lambda c: batch.column(f"{side}_{c}")[k]
    raw = {c: np.frombuffer(get(c).as_buffer(), np.float64 if c == "distances" else np.int64) for c in ("ids", "rows", "vectors", "distances")}
    n = get("n").as_py()
    return raw | {"vectors": raw["vectors"].reshape(n, get("dims").as_py()), "distances": raw["distances"].reshape(n, -1)}


def met(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, top: int) -> DataFrame:
    """What the pairs of blocks (query_block, block[, limits]) give: HIT rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q, c = opened(batch, "q", k), opened(batch, "c", k)
                limits = np.full(len(q["ids"]), -np.inf)
                if batch.column("limits")[k].is_valid:
                    limits = np.array(batch.column("limits")[k].as_py(), np.float64)
                out = [(np.full(len(s), q["rows"][i]), np.full(len(s), q["ids"][i]), ids, s) for i, ids, s in search(q, c, limits, top)]
                columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
                yield pa.record_batch([pa.array(x) for x in columns], names=[f.split()[0] for f in HIT.split(", ")])

    side = lambda frame, s: frame.select(*[F.col(x).alias(f"{s}_{x}") for x in ("block", "n", "dims", "ids", "rows", "vectors", "distances")])
    joined = pairs.join(side(queries, "q"), F.col("query_block") == F.col("q_block")).join(
        side(blocks, "c"), F.col("block") == F.col("c_block")).drop("q_block", "c_block", "query_block", "block")
    return joined.mapInArrow(run, HIT)


def box_bound() -> F.Column:
    """The greatest inner product that the boxes (near, far, norm) of two blocks allow."""
    gap = F.greatest(F.lit(0.0), F.array_max(F.zip_with(
        F.zip_with("q_near", "far", lambda a, b: a - b), F.zip_with("near", "q_far", lambda a, b: a - b),
        lambda a, b: F.greatest(a, b))))
    square = F.col("q_norm") * F.col("q_norm") + F.col("norm") * F.col("norm")
    return (F.least(F.col("q_norm") * F.col("norm"), (square - gap * gap) / 2) + 1e-6 * square + 1e-6).alias("bound")


def top_k(vectors: DataFrame, is_query: str | F.Column, top: int = TOP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of the greatest inner product for every row with ``is_query``.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = written(usable(vectors), "rows")
    dims, number = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.lit(1))).first()
    dims = max(dims, 1)
    pivots = pick_pivots(rows, dims)
    table = written(placed(rows, pivots), "table")
    block_rows = max(64, min(block_rows, BLOCK_NUMBERS // dims))
    blocks = written(packed(table, dims, -(-number // block_rows), block_rows), "blocks")
    asked = table.filter(is_query)
    queries = written(packed(asked, dims, -(-asked.count() // block_rows), block_rows // 4), "queries")
    q_box = queries.select(F.col("block").alias("query_block"), F.col("near").alias("q_near"), F.col("far").alias("q_far"), F.col("norm").alias("q_norm"))
    boxes = written(q_box.crossJoin(blocks.select("block", "n", "near", "far", "norm")).select("query_block", "block", "n", box_bound()), "boxes")
    # one seed for each block of queries: of the blocks with enough rows the one whose box allows most
    seeds = boxes.groupBy("query_block").agg(F.max_by("block", F.struct(F.col("n") > top, "bound", "block")).alias("block"))
    seeds = written(seeds, "seeds")
    first = written(met(seeds.withColumn("limits", F.lit(None).cast("array<double>")), queries, blocks, top), "first")
    # the k-th score of each query so far, in the order of its block
    limit = first.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= top, F.min("score").cast("double")).alias("limit"))
    limits = limits_of(queries).join(limit, "query_row", "left").groupBy("query_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("limit", F.lit(float("-inf"))).alias("limit")))),
                    lambda s: s["limit"]).alias("limits"))
    limits = written(limits, "limits")
    rest = boxes.join(seeds, ["query_block", "block"], "left_anti").join(limits, "query_block").filter(
        F.col("bound") >= F.array_min("limits")).select("query_block", "block", "limits")
    found = first.unionByName(written(met(rest, queries, blocks, top), "rest"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def limits_of(queries: DataFrame) -> DataFrame:
    """(query_block, place, query_row) of every query, by its place in its block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(rows.as_buffer(), np.int64)
                yield pa.record_batch([pa.array(np.full(len(rows), block)), pa.array(np.arange(len(rows))), pa.array(rows)],
                                      names=["query_block", "place", "query_row"])

    return queries.select("block", "rows").mapInArrow(run, "query_block bigint, place bigint, query_row bigint")
