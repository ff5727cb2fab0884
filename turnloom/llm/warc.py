"""WARC archives through a table of record chunks.

A payload is never handled whole outside its own row: the JVM cuts it into chunk rows (record, chunk number, bytes),
the writer streams those into gzip members, and the reader gives chunk rows again, each with the SHA-1 of the payload
up to its end. Equal payloads are found by digest and length before writing; all but the smallest id become revisits.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnloom.llm.shared import attempt_name, open_folder
from turnloom.sources.sinks import staged, work_dir

CHUNK = 1 << 16
#: An archive file is closed after the record that takes it past this size.
FILE_BYTES = 1 << 26
CHUNKS = "record_id long, null_id boolean, record_type string, refers_to long, uri string, payload_digest string, chunk long, chunk_bytes long, end_byte long, last boolean, sha1_so_far string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def revisits(pages: DataFrame, id_col: str, body: str, least: int) -> DataFrame:
    """(id, refers_to): rows whose payload of at least ``least`` bytes also belongs to a smaller id.

    Only ids, lengths and digests are shuffled; the smallest id combines on the map side and only payloads held by
    several ids come back to the rows, from a file, so a payload with very many copies can be split.
    """
    payload = F.coalesce(F.encode(body, "UTF-8"), F.lit(b""))
    heads = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size")).where(F.col("id").isNotNull() & (F.col("size") >= least))
    owners = heads.groupBy("sha", "size").agg(F.min("id").alias("refers_to"), F.max("id").alias("top")).where("refers_to != top").drop("top")
    return heads.join(staged(owners, "owners"), ["sha", "size"]).where("id != refers_to").select("id", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", least: int = 0, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One record per row (null body: empty); returns the manifest (file, bytes).

    Rows that share an id and a payload are each a record of the same type. A null id is a record of its own, always a
    response. Other columns are not read.
    """
    again = staged(revisits(pages, id_col, body_col, least), "revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b"")).alias("payload")).alias("p")
    rows = rows.join(again.alias("r"), F.col("p.id") == F.col("r.id"), "left").select("p.*", "refers_to")
    size = F.octet_length("payload")
    kept = F.when(F.col("refers_to").isNull(), size).otherwise(0)
    numbered = rows.select("*", size.cast("long").alias("size"), F.unhex(F.sha1("payload")).alias("sha"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(kept / chunk) - 1, F.lit(0)).cast("int"))).alias("chunk"))
    parts = numbered.select("id", "uri", "refers_to", "size", "sha", "chunk", F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b"")).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        name, out, gz = "", None, None
        files: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    if gz is not None:
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    if out is not None and out.tell() >= file_bytes:
                        files.append((name, out.tell()))
                        out.close()
                        out = None
                    if out is None:
                        name = attempt_name("archive") + ".warc.gz"
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out.write(gz.compress(_header(row)))
                out.write(gz.compress(row["data"]))
        if out is not None:
            out.write(gz.compress(b"\r\n\r\n") + gz.flush())
            files.append((name, out.tell()))
            out.close()
        yield pa.record_batch([pa.array([f for f, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], ["file", "bytes"])

    return staged(parts.mapInArrow(run, "file string, bytes long"), "manifest")


def _name(ident: int | None) -> str:
    return "urn:page:" + ("null" if ident is None else str(ident))


def _header(row: dict) -> bytes:
    """Header of one record; the target URI is percent-encoded where it could break a line."""
    revisit = row["refers_to"] is not None
    uri = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in row["uri"] or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(row['id'])}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if uri else []), f"WARC-Payload-Digest: sha1:{base32(row['sha'])}", f"WARC-Payload-Length: {row['size']}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(row['refers_to'])}>"] if revisit else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else row['size']}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class _Inflated:
    """Reads the gzip members of a file one after the other with a bounded buffer."""

    def __init__(self, source: BinaryIO, step: int):
        self.source, self.step, self.raw, self.gz, self.buffer = source, step, b"", None, bytearray()

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.step)
            if not self.raw:
                return False
        if self.gz is None:
            self.gz = zlib.decompressobj(31)
        self.buffer += self.gz.decompress(self.raw, self.step)
        self.raw = self.gz.unconsumed_tail or self.gz.unused_data
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, None
        return True

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out

    def header(self) -> dict[str, str] | None:
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("archive ends inside a header")
                return None
        first, *lines = self.take(end + 4)[:-4].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        return dict(line.split(": ", 1) for line in lines)


def read_chunks(manifest: DataFrame, folder: str, chunk: int = CHUNK, data: bool = False) -> DataFrame:
    """The chunk table of the archives: a row per chunk of a record (one empty chunk where there is no payload), with the
    SHA-1 of the payload up to its end, and its bytes if ``data``. One task reads a file in steps of ``chunk`` bytes."""
    files = manifest.count()
    schema = CHUNKS + (", data binary" if data else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as source:
                    held, size = [], 0
                    for row in _records(_Inflated(source, chunk), chunk, data):
                        held.append(row)
                        size += row[7] + 200
                        if size > 1 << 22:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                            held, size = [], 0
                    if held:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return manifest.select("file").repartitionByRange(max(1, files), "file").mapInArrow(run, schema)


def _records(source: _Inflated, chunk: int, data: bool) -> Iterator[tuple]:
    while (head := source.header()) is not None:
        ident = head["WARC-Record-ID"][1:-1].removeprefix("urn:page:")
        refers = head.get("WARC-Refers-To", "<>")[1:-1].removeprefix("urn:page:")
        left, done, number, sha = int(head["Content-Length"]), 0, 0, hashlib.sha1()
        while True:
            part = source.take(min(chunk, left))
            left, done = left - len(part), done + len(part)
            sha.update(part)
            row = (None if ident == "null" else int(ident), ident == "null", head["WARC-Type"], int(refers) if refers else None, head.get("WARC-Target-URI"), head["WARC-Payload-Digest"].removeprefix("sha1:"), number, len(part), int(head["WARC-Payload-Length"]) if refers else done, left == 0, base32(sha.digest()))
            yield (*row, part) if data else row
            number += 1
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("record length does not fit")


def records(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the last chunk of each record.

    Of a response the digest is the one computed while reading, and it must be the header's; a revisit states that of
    the payload it refers to.
    """
    response = F.col("record_type") == "response"
    wrong = response & (F.col("sha1_so_far") != F.col("payload_digest"))
    digest = F.when(wrong, F.raise_error(F.lit("payload does not fit its digest"))).when(response, F.col("sha1_so_far")).otherwise(F.col("payload_digest"))
    return chunks.where("last").select(F.col("record_id").alias("page_id"), F.col("end_byte").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    folder = work_dir(pages.sparkSession, "archives")
    return records(read_chunks(write_archives(pages, folder, least=least, **columns), folder))
