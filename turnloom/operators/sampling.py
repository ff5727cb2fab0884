"""Replay buffer and per-step choice of where a training batch comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnloom.operators.batches import seeded_hash, unit_hash
from turnloom.operators.folds import WIDTH, running

CAPACITY = 1000
MIXED_ALPHA = 0.5


def replay_ratio(threshold: Column, kind: str, step: Column, total: Column) -> Column:
    """Share of steps that generate afresh, by schedule."""
    if kind == "constant":
        return threshold * F.lit(0.5)
    if kind == "increasing":
        return threshold * step / total
    if kind == "decreasing":
        return threshold * (F.lit(1.0) - step / total)
    raise ValueError(f"unknown replay ratio {kind!r}")


def sample_route(
    df: DataFrame,
    key: str = "run",
    step: str = "step",
    total: str = "total",
    draw: str = "r",
    threshold: Column | float = 0.0,
    sampling: str = "adaptive",
    ratio: str = "decreasing",
    batch_size: int = 8,
    capacity: int = CAPACITY,
    alpha: float = MIXED_ALPHA,
    training: Column | None = None,
    multimodal: Column | None = None,
    model_ratio: float | None = None,
    teacher_draw: str | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Add ``route`` and ``stored`` (buffer rows before the step).

    Routes: data, fresh (generated now), replay (from the buffer), mixed (generated, stored,
    then drawn from the buffer), teacher. Until the buffer is full every step under the
    threshold adds a batch, so its fill level is a running count.
    """
    if sampling not in ("adaptive", "mixed"):
        raise ValueError(f"unknown sampling type {sampling!r}")
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    active = F.lit(True) if training is None else training
    vision = F.lit(False) if multimodal is None else multimodal
    r = F.col(draw)
    hit = r < (limit if sampling == "adaptive" else F.lit(float(alpha)))
    adds = (active & ~vision & hit).cast("long")
    counted = running(df, key, step, sums={"_adds": adds}, width=width)
    stored = F.least(F.lit(capacity), F.col("_adds") * batch_size)
    base = F.when(~active, "data").when(vision & hit, "fresh")
    if sampling == "mixed":
        route = base.when(hit, "mixed")
    else:
        below = r < replay_ratio(limit, ratio, F.col(step), F.col(total))
        route = base.when(below | (hit & (stored < capacity)), "fresh").when(hit, "replay")
    if model_ratio is not None:
        route = route.when(F.col(teacher_draw) < F.lit(float(model_ratio)), "teacher")
    return counted.select(*df.columns, stored.alias("stored"), route.otherwise("data").alias("route"))


def replay_keep(df: DataFrame, order: list[str], capacity: int = CAPACITY, shard: str | None = None) -> DataFrame:
    """Newest ``capacity`` rows, overall or per shard.

    Both forms keep at most ``capacity`` rows per task (and shard) before the shuffle.
    """
    newest = [F.desc(c) for c in order]
    if shard is None:
        return df.orderBy(*newest).limit(capacity)
    place = F.row_number().over(Window.partitionBy(shard).orderBy(*newest))
    return df.withColumn("_place", place).where(F.col("_place") <= capacity).drop("_place")


def replay_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, the same ones for the same seed."""
    return df.orderBy(seeded_hash(seed, F.col(key)), key).limit(k)


def teacher_swap(data: DataFrame, teacher: DataFrame, model_ratio: float, seed: int = 0, payload: str = "response") -> DataFrame:
    """Replace a batch's samples by the teacher's with probability ``model_ratio`` per batch."""
    swap = unit_hash(seed, F.col("batch_id")) < F.lit(float(model_ratio))
    other = teacher.select("sample_id", F.col(payload).alias("_teacher"), F.lit(True).alias("_has"))
    return (
        data.join(other, "sample_id", "left")
        .withColumn("from_teacher", swap & F.coalesce("_has", F.lit(False)))
        .withColumn(payload, F.when(F.col("from_teacher"), F.col("_teacher")).otherwise(F.col(payload)))
        .drop("_teacher", "_has")
    )
