"""Token-id files: whole documents in id order, in range-coded blocks that are reset and checksummed one by one.

A file is a run of blocks. A block is ``TLB1``, the length of its header, the header's crc32, the body's crc32 and
length, then the header (ids in the block, alphabet, lanes, documents, whether the first document goes on from the
block before; document ids and their numbers of ids here; words per lane) and the body (16-bit words, lane by lane).
All numbers are little-endian. A block can be read without any other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from turnloom.llm import rangecoder
from turnloom.llm.arrow import splits
from turnloom.llm.bpe import encoder
from turnloom.llm.shared import attempt_name, open_folder
from turnloom.sources.sinks import staged, work_dir

MAGIC = b"TLB1"
BLOCK_IDS = 1 << 22
#: Text that is cut into pieces at once; the pieces known so far are hashed once for all of it.
SLICE_BYTES = 1 << 22
_FIXED, _HEADER = "<4sIIIQ", "<QIIQB"
_NULL = -(1 << 63)


def write_block(out: BinaryIO, ids: np.ndarray, documents: np.ndarray, lengths: np.ndarray, goes_on: bool) -> None:
    alphabet = int(ids.max()) + 1 if len(ids) else 1
    words, per_lane = rangecoder.encode(ids, alphabet)
    body = words.astype("<u2").tobytes()
    header = struct.pack(_HEADER, len(ids), alphabet, len(per_lane), len(documents), goes_on) + documents.astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + per_lane.astype("<u4").tobytes()
    out.write(struct.pack(_FIXED, MAGIC, len(header), zlib.crc32(header), zlib.crc32(body), len(body)))
    out.write(header)
    out.write(body)


def read_blocks(source: BinaryIO) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(ids, documents, lengths, goes on) of each block; a damaged block is an error."""
    while fixed := source.read(struct.calcsize(_FIXED)):
        magic, size, header_crc, body_crc, body_size = struct.unpack(_FIXED, fixed)
        header, body = source.read(size), source.read(body_size)
        if magic != MAGIC or zlib.crc32(header) != header_crc or zlib.crc32(body) != body_crc:
            raise ValueError("damaged block")
        count, alphabet, lanes, documents, goes_on = struct.unpack_from(_HEADER, header)
        at = struct.calcsize(_HEADER)
        names = np.frombuffer(header, "<i8", documents, at)
        lengths = np.frombuffer(header, "<u8", documents, at + 8 * documents).astype(np.int64)
        per_lane = np.frombuffer(header, "<u4", lanes, at + 16 * documents).astype(np.int64)
        yield rangecoder.decode(np.frombuffer(body, "<u2"), per_lane, count, alphabet), names, lengths, bool(goes_on)


class BlockWriter:
    """Cuts a stream of documents into blocks; a long document runs over several."""

    def __init__(self, out: BinaryIO, block_ids: int):
        self.out, self.limit, self.total = out, block_ids, 0
        self._fresh(False)

    def _fresh(self, goes_on: bool) -> None:
        self.parts, self.names, self.lengths, self.held, self.goes_on = [], [], [], 0, goes_on

    def add(self, name: int, ids: bytes) -> None:
        rest, first = memoryview(ids), True
        while first or len(rest):
            part = rest[: 4 * (self.limit - self.held)]
            rest = rest[len(part) :]
            self.parts.append(part)
            self.names.append(name)
            self.lengths.append(len(part) // 4)
            self.held, first = self.held + len(part) // 4, False
            if self.held >= self.limit:
                self.flush(goes_on=bool(len(rest)))
        self.total += len(ids) // 4

    def flush(self, goes_on: bool = False) -> None:
        if self.names:
            write_block(self.out, np.frombuffer(b"".join(self.parts), "<u4"), np.array(self.names), np.array(self.lengths), self.goes_on)
        self._fresh(goes_on)


def write_token_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write documents in ascending id order, nulls first (texts in order of their hash where an id repeats).

    Returns the manifest (part, file, documents, ids), one row per file, in id order of parts. A null text is empty and
    leaves only its end id. A range partition by id is one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        encode, end, name = encoder(path), struct.pack("<I", end_id), attempt_name("ids")
        documents, writer = 0, None
        with system.open_output_stream(f"{root}/{name}") as out:
            writer = BlockWriter(out, block_ids)
            for batch in splits(batches, "text", SLICE_BYTES):
                documents += batch.num_rows
                ids, starts = encode.batch(batch.column("text"))
                for ident, a, b in zip(batch.column("id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                    writer.add(_NULL if ident is None else ident, ids[a:b].tobytes() + end)
            writer.flush()
        yield pa.record_batch([pa.array([x], t) for x, t in ((TaskContext.get().partitionId(), pa.int64()), (name, pa.string()), (documents, pa.int64()), (writer.total, pa.int64()))], ["part", "file", "documents", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", F.xxhash64("text"))
    return staged(ordered.mapInArrow(run, "part long, file string, documents long, ids long").where("documents > 0"), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document from the files; ``start`` counts all ids of documents before it.

    One task reads one file, block by block; the manifest has a row per file, so its running total is small.
    """
    from_start = F.sum("ids").over(Window.orderBy("part")) - F.col("ids")
    files = manifest.count()
    placed = manifest.select("part", "file", from_start.alias("base")).repartitionByRange(max(1, files), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with system.open_input_stream(f"{root}/{name}") as source:
                    yield from _documents(source, base)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(source: BinaryIO, at: int) -> Iterator[pa.RecordBatch]:
    """Rows of one file; the last document of a block is held back until it is known to have ended."""
    held: tuple[int, int, int, int] | None = None
    for ids, names, lengths, goes_on in read_blocks(source):
        data = memoryview(ids.astype("<u4").tobytes())
        rows, place = ([] if goes_on or held is None else [held]), 0
        for i, (name, size) in enumerate(zip(names.tolist(), lengths.tolist())):
            part = data[4 * place : 4 * (place + size)]
            place += size
            if i == 0 and goes_on:
                rows.append((held[0], held[1], held[2] + size, zlib.crc32(part, held[3])))
            else:
                rows.append((name, at, size, zlib.crc32(part)))
            at += size
        held = rows.pop()
        yield _batch(rows)
    if held is not None:
        yield _batch([held])


def _batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    names, *rest = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array([None if n == _NULL else n for n in names], pa.int64()), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the files and read them back; an empty table gives no file and no row."""
    folder = work_dir(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, path, folder, id_col, text_col, end_id, block_ids), folder)
