"""Exact inner-product search with block-at-a-time pruning.

Rows are kept in blocks of consecutive ids with the largest and smallest value of every component. Per query the blocks
are taken in order of their bound (per component the better of query x maximum and query x minimum, summed) and scored
through the block's own matrix until the bound falls below the k-th score. Queries, a stated part of the rows, come in
groups; a cell is one group against one bucket of blocks, so a task holds a few megabytes at any input size. A block
crosses the shuffle once per group, so groups are large; inside a cell queries are scored by slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnloom.sources.sinks import staged

BLOCK_ROWS = 512
GROUP_ROWS = 2048
#: Queries of a group that are scored together, which bounds the scores held.
SLICE_ROWS = 256
BUCKET_BLOCKS = 16


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector is null or holds a null or non-finite component."""
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(part, number, dim, ids, matrix, high, low) from (id, v): blocks of ``size`` consecutive ids of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int]]]] = {}
        number = 0

        def cut(dim: int) -> pa.RecordBatch:
            ids = np.array([i for i, _ in held[dim]], np.int64)
            m = np.array([v for _, v in held.pop(dim)], np.int64).reshape(len(ids), dim)
            cells = [ids, m, m.max(axis=0), m.min(axis=0)]
            return pa.record_batch([pa.array([number]), pa.array([dim]), *(pa.array([x.tobytes()]) for x in cells)], ["number", "dim", "ids", "matrix", "high", "low"])

        for batch in batches:
            for ident, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                held.setdefault(len(v), []).append((ident, v))
                if len(held[len(v)]) >= size:
                    yield cut(len(v))
                    number += 1
        for dim in list(held):
            yield cut(dim)
            number += 1

    cut = rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "number long, dim long, ids binary, matrix binary, high binary, low binary")
    return cut.withColumn("part", F.spark_partition_id())


def _numbers(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles while every sum stays below 2 ** 53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def _search(queries: pa.Table, index: pa.Table, k: int) -> pa.Table:
    found: list[np.ndarray] = []
    by_dim: dict[int, list[dict]] = {}
    for r in index.to_pylist():
        by_dim.setdefault(r["dim"], []).append(r)
    for q in queries.to_pylist():
        dim = q["dim"]
        mine = by_dim.get(dim)
        if not mine:
            continue
        qid, qm = np.frombuffer(q["ids"], np.int64), _numbers(q["matrix"], dim) if dim else np.zeros((len(q["ids"]) // 8, 0), np.int64)
        found += [_slice(qid[i : i + SLICE_ROWS], qm[i : i + SLICE_ROWS], mine, dim, k) for i in range(0, len(qid), SLICE_ROWS)]
    out = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return pa.table([pa.array(c) for c in out], ["query_id", "vec_id", "score"])


def _slice(qid: np.ndarray, qm: np.ndarray, mine: list[dict], dim: int, k: int) -> np.ndarray:
    """(query, row, score) of the ``k`` best rows of these blocks for each query, blocks in order of their bound."""
    high, low = (np.concatenate([_numbers(r[c], dim) for r in mine]) if dim else np.zeros((len(mine), 0), np.int64) for c in ("high", "low"))
    bound = _product(np.maximum(qm, 0), high) + _product(np.minimum(qm, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(qid), k), np.iinfo(np.int64).min)
    ids = np.full((len(qid), k), np.iinfo(np.int64).max)
    have = np.zeros(len(qid), np.int64)
    for turn in range(len(mine)):
        block = order[:, turn]
        alive = (have < k) | (np.take_along_axis(bound, block[:, None], 1)[:, 0] >= score[:, -1])
        if not alive.any():
            break
        for b in np.unique(block[alive]):
            at = np.flatnonzero(alive & (block == b))
            own = np.frombuffer(mine[b]["ids"], np.int64)
            s = _product(qm[at], _numbers(mine[b]["matrix"], dim) if dim else np.zeros((len(own), 0), np.int64))
            other = own[None, :] != qid[at][:, None]
            s = np.concatenate([score[at], np.where(other, s, np.iinfo(np.int64).min)], axis=1)
            i = np.concatenate([ids[at], np.where(other, own[None, :], np.iinfo(np.int64).max)], axis=1)
            best = np.lexsort((i, -np.maximum(s, np.iinfo(np.int64).min + 1)), axis=1)[:, :k]
            score[at], ids[at] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            have[at] = (ids[at] != np.iinfo(np.int64).max).sum(axis=1)
    rows, cols = np.nonzero(ids != np.iinfo(np.int64).max)
    return np.stack([qid[rows], ids[rows, cols], score[rows, cols]])


def top_k(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5,
    block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, bucket_blocks: int = BUCKET_BLOCKS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every row whose id is divisible by ``every``.

    Ties go to the smaller id. A row is not a candidate of a query with its own id, nor of one of another length. Null
    ids and unusable vectors take no part; a repeated query id is searched once per distinct vector of it.
    """
    usable = rows.select(F.col(id_col).cast("long").alias("id"), integers(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    index = staged(blocks(usable, block_rows), "blocks")
    asked = staged(blocks(usable.where(F.pmod("id", F.lit(every)) == 0).distinct(), group_rows), "queries")
    buckets, groups = max(1, -(-index.count() // bucket_blocks)), asked.count()
    if not groups:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Only the names of the groups, one narrow row each, are numbered in one task; the queries meet their number in a join.
    names = asked.select("part", "number").withColumn("g", F.row_number().over(Window.orderBy("part", "number")).cast("long") - 1)
    wanted = asked.join(names, ["part", "number"]).drop("part", "number").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    stored = index.withColumn("b", F.pmod(F.xxhash64("part", "number"), F.lit(buckets))).drop("part", "number").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    cells = wanted.groupBy("g", "b").cogroup(stored.groupBy("g", "b")).applyInArrow(lambda q, i: _search(q, i, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
