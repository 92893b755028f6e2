"""Nearest neighbours by cosine as a block matrix join.

Vectors are packed into blocks of int8 codes with one scale per vector. A tile, one query block by one vector block, is
a matrix product of codes: it gives every cosine up to a bound made of the two quantisation errors, which are known
exactly. Pairs whose upper bound reaches the k-th best lower bound of their query survive and are recomputed in double
precision; heaps keep the k best. A task carries the heaps of a query block, and so the bar, from tile to tile, and gives
out what is in them at the end. Nothing is approximate in the result.

A tile's memory is bounded by the block sizes, that of the heaps by the number of query blocks a task keeps. Query blocks meet vector blocks by an equal key, dealt over groups.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import written

QUERY_BLOCK, VECTOR_BLOCK = 512, 2_048
#: Survivors recomputed at a time.
_PAIRS = 16_384
#: Query blocks whose heaps a task carries; those of the block that was longest unused are given out first.
_CARRIED = 32
_BLOCK = "dim int, block long, wide boolean, ids binary, named binary, codes binary, scales binary, errors binary, vectors binary"


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the places of its usable vectors, and the vectors."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        rows = values[starts[at][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.linalg.norm(rows.astype(np.float64), axis=1)
        good = np.isfinite(norms) & (norms > 0)
        if good.any():
            yield at[good], rows[good]


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, and the lengths of what the codes miss."""
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def _packed(size: int):
    """Blocks of at most ``size`` vectors of one dimension, in order of arrival."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        made = 0

        def block(ids: np.ndarray, named: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            codes, scales, errors = quantised(vectors)
            name = (TaskContext.get().partitionId() << 32) + made
            made += 1
            data = [x.tobytes() for x in (ids, named, codes, scales, errors, vectors)]
            return pa.RecordBatch.from_arrays(
                [pa.array([vectors.shape[1]], pa.int32()), pa.array([name], pa.int64()), pa.array([vectors.itemsize == 8]),
                 *(pa.array([x], pa.binary()) for x in data)],
                ["dim", "block", "wide", "ids", "named", "codes", "scales", "errors", "vectors"],
            )

        for batch in batches:
            for at, rows in _matrices(batch.column(1)):
                ids = batch.column(0).take(pa.array(at))
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                held.setdefault(rows.shape[1], []).append((ids.fill_null(0).to_numpy(), named, rows))
            for dim, parts in held.items():
                if sum(len(x) for x, _, _ in parts) >= size:
                    whole = [np.concatenate(x) for x in zip(*parts)]
                    full = len(whole[0]) - len(whole[0]) % size
                    for i in range(0, full, size):
                        yield block(*(x[i : i + size] for x in whole))
                    held[dim] = [tuple(x[full:] for x in whole)]
        for parts in held.values():
            whole = [np.concatenate(x) for x in zip(*parts)]
            if len(whole[0]):
                yield block(*whole)

    return run


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    q, v = q.astype(np.float64), v.astype(np.float64)
    return np.einsum("ij,ij->i", q, v) / (np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1))


#: A candidate: its score, whether it has an id, and the id with its sign turned. The greater one is nearer.
Entry = tuple[float, bool, int]


def search_tile(q: dict, v: dict, k: int, heaps: list[list[Entry]]) -> int:
    """Puts into each query's heap, its worst entry first, what the tile has among the k best so far.

    A query's own id is left out. Returns how many pairs were recomputed.
    """
    # Sums of products of codes are whole numbers; float keeps them exact up to 2**24, double beyond.
    kind = np.float32 if q["codes"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (q["codes"].astype(kind) @ v["codes"].astype(kind).T) * (q["scales"][:, None] * v["scales"][None, :])
    slack = q["errors"][:, None] + v["errors"][None, :] + q["errors"][:, None] * v["errors"][None, :] + 1e-5
    near[(q["ids"][:, None] == v["ids"][None, :]) & v["named"][None, :]] = -np.inf
    low = near - slack
    bar = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
    bar = np.maximum(bar, [heap[0][0] - 1e-9 if len(heap) == k else -np.inf for heap in heaps])
    rows, columns = np.nonzero((near + slack >= bar[:, None]) & np.isfinite(near))
    for i in range(0, len(rows), _PAIRS):
        r, c = rows[i : i + _PAIRS], columns[i : i + _PAIRS]
        scores = _exact(q["vectors"][r], v["vectors"][c])
        for query, entry in zip(r.tolist(), zip(scores.tolist(), v["named"][c].tolist(), (-v["ids"][c]).tolist())):
            heap = heaps[query]
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return len(rows)


def _block(row: dict, side: str) -> dict:
    dim = row["dim"]
    return {
        "ids": np.frombuffer(row[f"{side}ids"], np.int64), "named": np.frombuffer(row[f"{side}named"], bool),
        "codes": np.frombuffer(row[f"{side}codes"], np.int8).reshape(-1, dim),
        "scales": np.frombuffer(row[f"{side}scales"]), "errors": np.frombuffer(row[f"{side}errors"]),
        "vectors": np.frombuffer(row[f"{side}vectors"], np.float64 if row[f"{side}wide"] else np.float32).reshape(-1, dim),
    }


def _tiles(k: int):
    def given_out(block: int, ids: np.ndarray, heaps: list[list[Entry]]) -> pa.RecordBatch:
        found = [(place, *entry) for place, heap in enumerate(heaps) for entry in heap]
        place = [p for p, _, _, _ in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(found), pa.int64()), pa.array(place, pa.int32()), pa.array(ids[place], pa.int64()),
             pa.array([-i if named else None for _, _, named, i in found], pa.int64()),
             pa.array([score for _, score, _, _ in found], pa.float64())],
            ["block", "place", "query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: OrderedDict[int, tuple[np.ndarray, list[list[Entry]]]] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                q, block = _block(row, "q_"), row["q_block"]
                if block not in carried:
                    carried[block] = q["ids"], [[] for _ in q["ids"]]
                    if len(carried) > _CARRIED:
                        oldest, kept = carried.popitem(last=False)
                        yield given_out(oldest, *kept)
                carried.move_to_end(block)
                search_tile(q, _block(row, ""), k, carried[block][1])
        for block, kept in carried.items():
            yield given_out(block, *kept)

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest cosines of each query row, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null, NaN or infinite components take no part, on either side. Only
    vectors of one dimension are compared. Candidates are all rows with another id or with none; of equal scores, those
    without id come last. Rows without id are no queries. Repeated rows are each a candidate and each a query. A query
    with fewer than k candidates gets all; with none, no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    rows = rows.where("v is not null")
    blocks = written(rows.select("id", "v").mapInArrow(_packed(vector_block), _BLOCK), "vectors")
    queries = rows.where("asks and id is not null").select("id", "v").mapInArrow(_packed(query_block), _BLOCK)
    groups = max(1, min(blocks.select("block").count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = queries.select("dim", *(F.col(c).alias(f"q_{c}") for c in queries.columns if c != "dim"))
    dealt = dealt.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    blocks = blocks.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    tiles = dealt.join(blocks, ["dim", "deal"]).drop("deal", "block")
    found = tiles.mapInArrow(_tiles(k), "block long, place int, query_id long, vec_id long, score double")
    order = Window.partitionBy("block", "place", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
