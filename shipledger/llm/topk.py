"""Exact top-k inner products over vectors of integers, the longest vectors first.

Vectors lie in blocks of descending length (Euclidean norm). The search is exact:

1. The block of the longest vectors is searched by every query; its k-th best score is a lower
   bound of what a result must reach.
2. A block whose longest vector cannot reach the bound of any query of a query block, by
   |q| * |x| >= q.x (Cauchy-Schwarz), is not paired with that query block at all.
3. Inside a pair of blocks all vectors are rotated by the singular vectors of the table, which puts
   most of a product into the leading components. Products are summed over growing leading
   parts, and a pair of vectors is dropped as soon as its partial sum plus the product of the
   residual lengths (Cauchy-Schwarz on the rest) is below the bound.
4. What is left gets its integer product from the unrotated vectors.

Query blocks and vector blocks have a fixed number of rows; all pairs that may matter are dealt to
tasks by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipledger.llm.work import slices, written

SCALE = 1024


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector array<double>, dim, norm): floor(scale * x) of every component x.

    Rows with a null vec_id, a null or empty vector, or a null or non-finite component take no part.
    """
    usable = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    return (
        vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
        .where(F.coalesce(usable, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
        .select("vec_id", "vector", F.size("vector").alias("dim"), F.sqrt(squares).alias("norm"))
    )


#: Components in a block at most: 2 MiB of doubles.
BLOCK_VALUES = 1 << 18
#: Dimensions up to which their first blocks are broadcast: 32 MiB at most.
BROADCAST_HEADS = 16
BLOCK = "block long, dim int, longest double, ids binary, data binary"


def _to_blocks(rows_per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        have, most, now, longest = 0, rows_per_block, None, 0.0

        def block() -> pa.RecordBatch:
            row = {
                "block": [number],
                "dim": [now],
                "longest": [longest],
                "ids": [np.concatenate(ids).astype("<i8").tobytes()],
                "data": [np.concatenate(vectors).astype("<f8").tobytes()],
            }
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            dims = batch.column(2).to_numpy()
            norms = batch.column(3).to_numpy()
            values, offsets = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            offsets = offsets - offsets[0]
            names = batch.column(0).to_numpy()
            at = 0
            while at < batch.num_rows:
                if have and (dims[at] != now or have >= most):
                    yield block()
                    number, have, ids, vectors = number + 1, 0, [], []
                if not have:
                    now, longest = int(dims[at]), float(norms[at])
                    most = max(1, min(rows_per_block, BLOCK_VALUES // now))
                other = np.flatnonzero(dims[at:] != now)
                end = min(at + most - have, at + int(other[0]) if len(other) else batch.num_rows)
                ids.append(names[at:end])
                vectors.append(values[offsets[at] : offsets[end]].reshape(end - at, now))
                have, at = have + end - at, end
        if have:
            yield block()

    return run


def length_blocks(vectors: DataFrame, rows_per_block: int) -> DataFrame:
    """Blocks of vectors of one dimension, by descending norm (ties by vec_id), written to the workspace."""
    order = [F.col("dim").asc(), F.col("norm").desc(), F.col("vec_id").asc()]
    spread = vectors.repartitionByRange(slices(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return written(spread.mapInArrow(_to_blocks(rows_per_block), BLOCK), "vector-blocks")


def rotations(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of all vectors of a dimension, the strongest first.

    Tasks sum the dim * dim second moments of their blocks; the driver gets one matrix per dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data, dtype="<f8").reshape(-1, dim)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array(np.full(dim * dim, dim), pa.int32()),
                    "cell": pa.array(np.arange(dim * dim), pa.int32()),
                    "value": pa.array(total.ravel(), pa.float64()),
                }
            )

    cells = blocks.select("dim", "data").mapInArrow(run, "dim int, cell int, value double")
    found: dict[int, np.ndarray] = {}
    for row in cells.groupBy("dim", "cell").agg(F.sum("value").alias("value")).toLocalIterator():
        dim = row["dim"]
        found.setdefault(dim, np.zeros(dim * dim))[row["cell"]] = row["value"]
    rotated = {}
    for dim, moments in found.items():
        moments = np.nan_to_num(moments.reshape(dim, dim))
        _, axes = np.linalg.eigh(moments / max(1.0, np.abs(moments).max()))
        rotated[dim] = axes[:, ::-1].copy()
    return rotated


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; in doubles while every sum is exact."""
    high = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if high < 1 << 53:
        return (queries @ data.T).astype(np.int64)
    if high < 1 << 63:
        return queries.astype(np.int64) @ data.astype(np.int64).T
    raise OverflowError("an inner product does not fit a long")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def survivors(queries: np.ndarray, data: np.ndarray, bounds: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, data rows) of the pairs that partial sums and residual lengths cannot exclude."""
    dim = queries.shape[1]
    # Rounding of a partial sum is far below this share of the product of the lengths.
    lengths = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(data, axis=1))
    slack = 1e-9 * lengths + 1e-6
    alive_q, alive_x = np.nonzero(lengths + slack >= bounds[:, None])
    if not len(alive_q):
        return alive_q, alive_x
    q, x = queries @ axes, data @ axes
    q_rest, x_rest = (q * q).sum(axis=1), (x * x).sum(axis=1)
    sums = np.zeros(len(alive_q))
    start = 0
    for end in sorted({max(1, dim // 4), max(1, dim // 2), max(1, 3 * dim // 4)}):
        part_q, part_x = q[:, start:end], x[:, start:end]
        q_rest = np.maximum(0, q_rest - (part_q * part_q).sum(axis=1))
        x_rest = np.maximum(0, x_rest - (part_x * part_x).sum(axis=1))
        if len(alive_q) * 8 > queries.shape[0] * data.shape[0]:
            sums = sums + (part_q @ part_x.T)[alive_q, alive_x]
        else:
            sums = sums + np.einsum("ij,ij->i", part_q[alive_q], part_x[alive_x])
        most = sums + np.sqrt(q_rest)[alive_q] * np.sqrt(x_rest)[alive_x] + slack[alive_q, alive_x]
        keep = most >= bounds[alive_q]
        alive_q, alive_x, sums = alive_q[keep], alive_x[keep], sums[keep]
        start = end
    return alive_q, alive_x


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(-1, dim)


def _bound_rows(k: int):
    """Bounds of every query of a block from the block of the longest vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                queries = _matrix(row["data"], row["dim"])
                own = np.frombuffer(row["ids"], dtype="<i8")
                bounds = np.full(len(own), -np.inf)
                if row["head_data"] is not None:
                    data, ids = _matrix(row["head_data"], row["dim"]), np.frombuffer(row["head_ids"], dtype="<i8")
                    scores = _products(queries, data)
                    for j in range(len(own)):
                        others = scores[j][ids != own[j]]
                        if len(others) >= k:
                            bounds[j] = np.partition(others, len(others) - k)[len(others) - k]
                lengths = np.linalg.norm(queries, axis=1)
                need = np.where(lengths > 0, bounds / np.maximum(lengths, 1e-300), np.where(bounds <= 0, -np.inf, np.inf))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([row["block"]], pa.int64()),
                        "bounds": pa.array([bounds.tobytes()], pa.binary()),
                        "need": pa.array([float(need.min())], pa.float64()),
                    }
                )

    return run


FOUND = "query_block long, query_row int, query_id long, vec_id long, score long"


def _search_rows(k: int, axes: dict[int, np.ndarray]):
    schema = pa.schema(
        [("query_block", pa.int64()), ("query_row", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                dim = row["dim"]
                queries, data = _matrix(row["q_data"], dim), _matrix(row["data"], dim)
                own, ids = np.frombuffer(row["q_ids"], dtype="<i8"), np.frombuffer(row["ids"], dtype="<i8")
                at_q, at_x = survivors(queries, data, np.frombuffer(row["bounds"], dtype="<f8"), axes[dim])
                if len(at_q) * 8 > len(own) * len(ids):
                    scores = _products(queries, data)[at_q, at_x]
                else:
                    scores = np.zeros(len(at_q), dtype=np.int64)
                    for j in np.unique(at_q):
                        mine = at_q == j
                        scores[mine] = _products(queries[j : j + 1], data[at_x[mine]])[0]
                out: list[list] = [[], [], [], [], []]
                order = np.argsort(at_q, kind="stable")
                edges = np.flatnonzero(np.diff(at_q[order])) + 1
                for group in np.split(order, edges) if len(order) else []:
                    j = int(at_q[group[0]])
                    group = group[ids[at_x[group]] != own[j]]
                    best = group[_best(scores[group], ids[at_x[group]], k)]
                    for column, values in zip(out, ([row["q_block"]] * len(best), [j] * len(best), [own[j]] * len(best), ids[at_x[best]], scores[best])):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return run


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = SCALE,
    block_rows: int = 4096,
    query_rows: int = 256,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query, exactly.

    ``vectors`` and ``queries`` have vec_id and embedding. A query does not meet vectors of its own
    vec_id, nor vectors of another dimension; ties go to the smaller vec_id. Fewer than k results
    come out when there are fewer vectors. Repeated rows count each. An empty table gives no rows.
    """
    blocks = length_blocks(integer_vectors(vectors, scale), block_rows)
    query_blocks = length_blocks(integer_vectors(queries, scale), query_rows)
    axes = rotations(blocks)
    head = blocks.groupBy("dim").agg(F.min("block").alias("block"))  # blocks are numbered in their order
    heads = blocks.join(head, ["dim", "block"]).select(
        "dim", F.col("ids").alias("head_ids"), F.col("data").alias("head_data")
    )
    few = F.broadcast(heads) if head.count() <= BROADCAST_HEADS else heads
    bounded = written(
        query_blocks.join(few, "dim", "left").mapInArrow(_bound_rows(k), "block long, bounds binary, need double"),
        "query-bounds",
    )
    q = query_blocks.join(bounded, "block").select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "bounds"
    )
    # Pairs of block numbers: both sides hold one short row per block, dealt by a part of the number.
    parts = slices(vectors.sparkSession)
    needs = query_blocks.select("block", "dim").join(bounded.select("block", "need"), "block").select(
        F.col("block").alias("q_block"), "dim", "need", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    )
    has = blocks.select("block", "dim", "longest", F.pmod(F.hash("block"), F.lit(parts)).alias("part"))
    pairs = needs.join(has, ["dim", "part"]).where(
        F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("need")
    ).select("q_block", "block")
    rows = pairs.join(q, "q_block").join(blocks, "block").select(
        "dim", "ids", "data", "q_block", "q_ids", "q_data", "bounds"
    )
    found = rows.mapInArrow(_search_rows(k, axes), FOUND)
    best = Window.partitionBy("query_block", "query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
