"""Structured Streaming twins of batch operators."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from turnloom.config import Budget
from turnloom.functions.schedule import Schedule
from turnloom.functions.tokens import Dictionary, Vocabulary
from turnloom.operators.folds import interp_schedule
from turnloom.operators.sampling import CAPACITY
from turnloom.operators.template import GENERIC, Template
from turnloom.operators.windows import DEFAULT_WIDTH, expand_nested
from turnloom.sources.sinks import work_dir

#: Steps of a run that are put in order together, and buckets that the blocks of all runs are dealt to.
BLOCK = 512
BUCKETS = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain what has arrived into a Parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    out, state = work_dir(spark, label), work_dir(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def expand_stream(
    stream: DataFrame,
    keys: list[str],
    budget: Budget,
    template: Template = GENERIC,
    vocab: Vocabulary | Dictionary | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Sample expansion of arriving nested conversations: stateless, no shuffle."""
    return expand_nested(stream, keys, budget, template, vocab, width)


class _KeepLatest(StatefulProcessor):
    """Newest rows of one (shard, salt), at most ``capacity`` of them; passes on what came in and what went out."""

    schema = StructType([StructField("step", LongType()), StructField("item", LongType())])

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {tuple(r) for r in self.kept.get()} if self.kept.exists() else set()
        newest = before
        for chunk in rows:
            newest = newest.union(zip(chunk["step"].tolist(), chunk["item"].tolist()))
            if len(newest) > self.capacity:
                newest = set(heapq.nlargest(self.capacity, newest))
        if newest != before:
            self.kept.put(sorted(newest, reverse=True))
        changes = [(*r, 1) for r in newest - before] + [(*r, -1) for r in before - newest]
        frame = pd.DataFrame(changes, columns=["step", "item", "change"], dtype="int64")
        frame.insert(0, "salt", int(key[1]))
        frame.insert(0, "shard", int(key[0]))
        yield frame

    def close(self) -> None:
        pass


def replay_stream(stream: DataFrame, capacity: int = CAPACITY, salts: int = 8) -> DataFrame:
    """Bounded newest-N buffer per shard over a stream of (shard, step, item).

    A shard is spread over ``salts`` keys, each with its own bounded buffer, so a busy shard
    does not end up in one task. Every micro-batch emits only how it changed the buffers:
    ``change`` is 1 for a row that came in and -1 for one that went out. A row that came and
    went in one batch is not emitted; a repeated (step, item) counts once.
    :func:`replay_result` reads the current shard buffer out of the emitted rows.
    """
    salted = stream.select("shard", "step", "item", F.pmod(F.xxhash64("item"), F.lit(salts)).alias("salt"))
    return salted.groupBy("shard", "salt").transformWithStateInPandas(
        _KeepLatest(capacity), "shard long, salt long, step long, item long, change long", "Append", "None"
    )


def replay_result(emitted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Newest rows per shard, of those that came into a salted buffer and have not left it."""
    from turnloom.operators.sampling import replay_keep

    held = emitted.groupBy("shard", "step", "item").agg(F.sum("change").alias("n")).where("n > 0").drop("n")
    return replay_keep(held, ["step", "item"], capacity, shard="shard")


#: Rows of a bucket that are settled at once.
_SETTLED = 1 << 18
_WAITING = np.dtype([("run", "<i8"), ("block", "<i8"), ("place", "<i8"), ("step", "<i8"), ("total", "<f8"), ("loss", "<f8")])


class _InOrder(StatefulProcessor):
    """Lets the steps of each (run, block) of a bucket pass in order: ``front`` is the next place, ``held`` what came too early.

    A bucket holds many (run, block), so that frames, sorts and emitted batches are shared by them; state is read and
    written for those that got rows only. A bucket of any size is settled some rows at a time.
    """

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        of = StructType([StructField("run", LongType()), StructField("block", LongType())])
        self.state = handle.getMapState("state", of, StructType([StructField("front", LongType()), StructField("held", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts: list[np.ndarray] = []
        for chunk in rows:
            part = np.empty(len(chunk), _WAITING)
            for name in _WAITING.names:
                part[name] = chunk[name].to_numpy()
            parts.append(part)
            if sum(map(len, parts)) >= _SETTLED:
                yield self._settle(np.concatenate(parts))
                parts = []
        if parts:
            yield self._settle(np.concatenate(parts))

    def _settle(self, came: np.ndarray) -> pd.DataFrame:
        keys = list(map(tuple, np.unique(came[["run", "block"]]).tolist()))
        known = [self.state.getValue(k) or (max(0, k[1] * self.width), b"") for k in keys]
        # What waited comes before what is new: of equal places the first row counts.
        seen = np.concatenate([np.frombuffer(b"".join(bytes(held) for _, held in known), _WAITING), came])
        seen = seen[np.lexsort((seen["place"], seen["block"], seen["run"]))]
        run, block, place = seen["run"], seen["block"], seen["place"]
        opens = np.concatenate([[True], (run[1:] != run[:-1]) | (block[1:] != block[:-1])])
        group = np.cumsum(opens) - 1
        front = np.array([f for f, _ in known], np.int64)
        late = (place < front[group]) | (~opens & np.concatenate([[False], place[1:] == place[:-1]]))
        good = np.cumsum(~late)
        # Places only rise, so the good ones that follow each other from the front are a prefix of their group.
        ready = ~late & (place == front[group] + good - 1 - (good - ~late)[opens][group])
        front += np.bincount(group[ready], minlength=len(keys))
        early = ~late & ~ready
        ends = np.searchsorted(group[early], np.arange(len(keys) + 1))
        held = seen[early]
        for i, (k, was) in enumerate(zip(keys, known)):
            now = (int(front[i]), held[ends[i] : ends[i + 1]].tobytes())
            if now != (was[0], bytes(was[1])):
                self.state.updateValue(k, now)
        out = seen[ready | late]
        total = out["total"]
        return pd.DataFrame({
            "run": out["run"], "step": out["step"], "total": total if np.isnan(total).any() else total.astype("int64"),
            "loss": out["loss"], "late": late[ready | late],
        })

    def close(self) -> None:
        pass


def _place(first: int, stride: int) -> Column:
    return ((F.col("step") - first) / stride).cast("long")


def schedule_stream(stream: DataFrame, first: int = 0, stride: int = 1, width: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """The steps of runs in order, from a stream of (run, step, total, loss) in any order and any micro-batches.

    The steps of a run are ``first``, ``first + stride``, ... . They are dealt to blocks of ``width``; what came before an
    earlier step of its block is held back, at most ``width`` rows a block. Blocks are dealt to ``buckets`` state keys, so
    a busy run is spread over many keys and many short runs share one. A step that came before is reported as late and not
    passed on again, as is one off that grid. :func:`schedule_result` folds what was passed on.
    """
    off = (F.col("step") < first) | ((F.col("step") - first) % stride != 0)
    place = F.when(off, -1).otherwise(_place(first, stride))
    rows = stream.select(F.col("run").cast("long").alias("run"), F.floor(place / width).cast("long").alias("block"), place.alias("place"), F.col("step").cast("long").alias("step"), F.col("total").cast("long").alias("total"), F.col("loss").cast("double").alias("loss"))
    # What is off the grid goes to block -1, whose front is beyond it.
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("run", "block"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        _InOrder(width), "run long, step long, total long, loss double, late boolean", "Append", "None"
    )


def schedule_result(emitted: DataFrame, plan: Schedule = Schedule(), first: int = 0, stride: int = 1, width: int = BLOCK) -> DataFrame:
    """(run, step, t, momentum, late): the schedule of each run up to its first missing step, and the late steps.

    The blocks of a run count as far as all blocks before them are whole, which one narrow row per block tells; the fold
    is that of :func:`turnloom.operators.folds.interp_schedule`.
    """
    passed = emitted.where("NOT late").withColumn("block", F.floor(_place(first, stride) / width).cast("long"))
    sizes = passed.groupBy("run", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.coalesce(F.min((F.col("size") == width).cast("int")).over(before), F.lit(1)) == 1
    gapless = F.coalesce(F.count("*").over(before), F.lit(0)) == F.col("block")
    fronts = sizes.select("run", "block", (whole & gapless).alias("counts")).where("counts").drop("counts")
    folded = interp_schedule(
        passed.join(fronts, ["run", "block"]), t_start=plan.t_start, t_end=plan.t_end, alpha=plan.alpha, beta=plan.beta, adaptive=plan.adaptive
    )
    late = emitted.where("late").select("run", "step", *(F.lit(None).cast("double").alias(c) for c in ("t", "momentum")), "late")
    return folded.select("run", "step", "t", "momentum", F.lit(False).alias("late")).unionByName(late)
