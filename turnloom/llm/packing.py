"""Packing of token pieces into sequences: first-fit decreasing with a tournament tree, per random group of documents.

Documents are tokenized where they lie. A document of at least ``capacity`` ids is cut into full pieces, which are whole
sequences, and a remainder; only one narrow row per piece (no ids, no text) is shuffled, by a random group. Groups hold
about ``group_docs`` documents at every input size, so bins, tree and work per group are bounded, and a group's own ids
number its sequences: no global counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnloom.llm.arrow import splits
from turnloom.llm.bpe import encoder

CAPACITY = 2048
GROUP_DOCS = 4096
#: Text that is cut into pieces at once.
SLICE_BYTES = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class BinTree:
    """A tournament tree over bins: every inner node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with ``size`` free, whose capacity is then reduced."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        bin_ = at - self.leaves
        free[at] -= size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return bin_


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal lengths keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = BinTree(max(1, len(lengths)), capacity), {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        b = tree.place(size)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + size
    return bins, offsets


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, with the unsigned crc32 of its little-endian 32-bit ids.

    A document is the ids of its whole text and ``end_id``; a null text is empty, so every row has a piece.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in splits(batches, "text", SLICE_BYTES):
            out: list[tuple] = []
            ids, starts = encode.batch(batch.column("text"))
            for ident, begin, stop in zip(batch.column("id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                size = stop - begin + 1
                for a in range(0, size, capacity):
                    length = min(capacity, size - a)
                    crc = zlib.crc32(ids[begin + a : min(begin + a + capacity, stop)])
                    out.append((ident, a, length, zlib.crc32(end, crc) if a + length == size else crc, size))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def packed(parts: DataFrame, documents: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 11) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``documents`` (the number of documents) sets the number of groups. The group is drawn from the row itself, so a
    repeated or null id, or one document with very many pieces, spreads as well. Full pieces are sequences of their own.
    """
    groups = max(1, -(-documents // group_docs))
    draw = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.when(F.col("doc_id").isNull() | (F.col("length") == capacity), F.monotonically_increasing_id()))
    grouped = parts.withColumn("g", F.pmod(draw, F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = np.asarray(batch.column("g"))
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column("g")[-1].as_py() != int(g[a]):
                    yield _pack(held, capacity)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield _pack(held, capacity)

    ordered = grouped.repartition("g").sortWithinPartitions("g", "doc_id", "start")
    return ordered.mapInArrow(run, PLACED)


def _pack(batches: list[pa.RecordBatch], capacity: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    bins, offsets = first_fit_decreasing(np.asarray(rows.column("length")), capacity)
    sequence = (np.asarray(rows.column("g")) << 32) + bins
    table = rows.drop_columns(["g"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))
    return table.combine_chunks().to_batches()[0]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Tokenize and pack whole documents. Empty and null texts are one end id; an empty table gives no row; rows that
    repeat an id are packed each; other columns are not read."""
    documents = docs.count()
    return packed(pieces(docs, path, id_col, text_col, capacity, end_id), documents, capacity)
