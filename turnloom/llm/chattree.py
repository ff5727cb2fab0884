"""Conversations as prefix trees: shared initial turns are emitted once, depth first.

A turn's node is the hash of its role, text and the node before it. A node belongs to the smallest conversation that
passes through it, so each conversation owns one run of nodes: its own end. Children of a node are ordered with the
owner's own continuation first, then by branch depth and conversation; that order is a sort key of 12 bytes per branch,
so the depth-first layout is one range sort and no tree is ever held anywhere. Position ids count from the root of the
tree; the attention of a run is its own interval and one interval of each run above it.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. In texts and roles ``<`` and the backslashes after it get one
more backslash where a bar follows, so no control string survives inside; in roles backslashes and line ends are
escaped as well. Both are undone exactly.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnloom.llm.bpe import encoder
from turnloom.sources.sinks import staged

START, END = "<|im_start|>", "<|im_end|>"
_NULL = -(1 << 63)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn, and where its text begins and ends in it."""
    head = START + escaped(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escaped(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse_turn(turn: str) -> tuple[str, str]:
    head, body = turn[len(START) : -len(END) - 1].split("\n", 1)
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(head))
    return role, unescaped(body)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _chunked(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weigh=lambda row: 64) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > 1 << 21:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def nodes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, depth, node, role, text): turns of each conversation in order (equal turn numbers by role and text, nulls
    first), with the hash of the path to each. Turns are streamed; only the hash so far is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last, depth, chain = None, 0, b""
            for batch in batches:
                for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("c", "role", "text"))):
                    if c != last:
                        last, depth, chain = c, 0, b""
                    name = role.encode("utf-8", "surrogatepass")
                    chain = hashlib.blake2b(chain + struct.pack("<I", len(name)) + name + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    yield c, depth, chain, role, text
                    depth += 1

        yield from _chunked(rows(), ["c", "depth", "node", "role", "text"], [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()], lambda r: 64 + len(r[4]))

    rows = turns.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(_NULL)).alias("c"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.repartition("c").sortWithinPartitions("c", "turn", "role", "text").mapInArrow(run, "c long, depth long, node binary, role string, text string")


def _step(depth: int, owner: int) -> bytes:
    """Later branches first, then smaller owners, as unsigned bytes."""
    return struct.pack(">IQ", 0xFFFFFFFF - depth, owner + (1 << 63))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (c, depth, node, owner, size): the nodes that ``c`` owns, with layout key, position id and the runs above
    as (owner, first position, end position)."""

    def rows():
        last, key, position, runs, owner = None, b"", 0, [], None
        for batch in batches:
            for c, depth, node, own, size in zip(*(batch.column(n).to_pylist() for n in ("c", "depth", "node", "owner", "size"))):
                if c != last:
                    last, key, position, runs, owner = c, b"", 0, [], None
                if own != owner:
                    if owner is not None:
                        runs.append((owner, start, position))
                    key, start, owner = key + _step(depth, own), position, own
                if own == c:
                    first = position == start
                    yield c, depth, node, key, position, size, first, [dict(zip(("run", "first", "end"), r)) for r in runs] if first else None
                position += size

    above = pa.list_(pa.struct([("run", pa.int64()), ("first", pa.int64()), ("end", pa.int64())]))
    yield from _chunked(rows(), ["c", "depth", "node", "key", "position", "size", "first", "above"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), above])


def _formatted(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for c, depth, node, role, text in zip(*(batch.column(n).to_pylist() for n in ("c", "depth", "node", "role", "text"))):
                    turn, a, b = format_turn(role, text)
                    ids = encoder(path)(turn) if path else None
                    loss = role == "assistant"
                    yield c, depth, node, turn, ids, len(ids) // 4 if path else len(turn), a if loss else None, b if loss else None

        yield from _chunked(rows(), ["c", "depth", "node", "turn", "ids", "size", "loss_from", "loss_to"], [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary(), *[pa.int64()] * 3], lambda r: 64 + len(r[3]))

    return run


def prefix_trees(turns: DataFrame, tokenizer: str | None = None, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, runs, paths).

    * segments: every distinct node once, depth first: ``place`` (offset in the whole layout), ``position`` (id of its
      first unit), ``size``, the formatted ``turn``, ``ids`` if a tokenizer file is given, ``loss_from``/``loss_to`` in
      characters of an assistant's text. Units are ids, or code points without a tokenizer.
    * runs: per conversation that owns nodes its interval ``[place, ...)`` and ``attends``: the intervals of the layout
      that lie above it, root first.
    * paths: (c, depth, node) of every conversation.

    A null conversation id is one conversation of its own; null roles and texts are empty; repeated rows are turns.
    """
    own = staged(nodes(turns, **columns), "nodes")
    formatted = staged(own.mapInArrow(_formatted(tokenizer), "c long, depth long, node binary, turn string, ids binary, size long, loss_from long, loss_to long"), "formatted")
    paths = formatted.select("c", "depth", "node", "size")
    shared = staged(paths.groupBy("node").agg(F.min("c").alias("owner"), F.max("c").alias("top")).where("owner != top").drop("top"), "shared")
    owned = paths.join(shared, "node", "left").withColumn("owner", F.coalesce("owner", "c"))
    ordered = owned.repartition("c").sortWithinPartitions("c", "depth").select("c", "depth", "node", "owner", "size")
    placed = staged(ordered.mapInArrow(_placed, "c long, depth long, node binary, key binary, position long, size long, first boolean, above array<struct<run:long,first:long,end:long>>"), "placed")
    rows = placed.join(formatted.select("c", "depth", "turn", "ids", "loss_from", "loss_to"), ["c", "depth"])
    layout = staged(rows.repartitionByRange("key", "depth").sortWithinPartitions("key", "depth").withColumn("shard", F.spark_partition_id()), "layout")
    # Totals per shard are few; inside a shard the sort order of the file gives the offsets.
    totals = layout.groupBy("shard").agg(F.sum("size").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("shard").orderBy("key", "depth").rowsBetween(Window.unboundedPreceding, -1))
    segments = staged(layout.withColumn("inside", F.coalesce(inside, F.lit(0))).join(bases, "shard").withColumn("place", F.col("base") + F.col("inside")).drop("inside", "base", "shard"), "segments")
    starts = staged(segments.where("first").select("c", "place", "position", "above"), "starts")
    above = starts.select("c", F.posexplode("above").alias("n", "a")).select("c", "n", F.col("a.run").alias("run"), F.col("a.first").alias("first"), F.col("a.end").alias("end"))
    spans = above.join(starts.select(F.col("c").alias("run"), F.col("place").alias("at")), "run").select("c", F.struct("n", F.col("at").alias("start"), (F.col("at") + F.col("end") - F.col("first")).alias("end")).alias("span"))
    attends = staged(spans.groupBy("c").agg(F.array_sort(F.collect_list("span")).alias("spans")), "attends")
    runs = starts.select("c", "place", "position").join(attends, "c", "left").select("c", "place", "position", F.transform(F.coalesce("spans", F.array().cast("array<struct<n:int,start:long,end:long>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("attends"))
    return segments.select("node", "place", "position", "size", "turn", "ids", "loss_from", "loss_to"), runs, paths


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (c, depth, turn, loss_from, loss_to): digests of each conversation, streamed."""

    def rows():
        last = state = None
        for batch in batches:
            for c, turn, a, b in zip(*(batch.column(n).to_pylist() for n in ("c", "turn", "loss_from", "loss_to"))):
                if last is None or c != last:
                    if state:
                        yield _digest_row(last, state)
                    last, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(turn)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    part = unescaped(turn[a:b])
                    state[2] += len(part)
                    state[3].update(part.encode("utf-8", "surrogatepass"))
                state[4] += len(turn)
        if state:
            yield _digest_row(last, state)

    yield from _chunked(rows(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])


def _digest_row(c: int, state: list) -> tuple:
    return None if c == _NULL else c, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def read_back(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Digest columns of every conversation, from its nodes' segments. A node that very many conversations share comes
    from a file and meets them in a join that can be split."""
    rows = paths.select("c", "depth", "node").join(segments.select("node", "turn", "loss_from", "loss_to"), "node")
    ordered = rows.repartition("c").sortWithinPartitions("c", "depth").select("c", "turn", "loss_from", "loss_to")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_layout(digests: DataFrame, runs: DataFrame) -> DataFrame:
    """Digests with where each conversation's own run lies: ``run_place`` in the layout, ``run_position`` (position id of
    its first unit) and ``attends``, the intervals above it as ``start-end`` parted by blanks. All three are null for a
    conversation whose every turn belongs to others."""
    spans = F.array_join(F.transform("attends", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    own = runs.select(F.when(F.col("c") != _NULL, F.col("c")).alias("_c"), F.col("place").alias("run_place"), F.col("position").alias("run_position"), spans.alias("attends"))
    return digests.join(own, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
