"""Order-dependent run statistics without putting a whole run into one task.

A run is cut into blocks of consecutive steps. Running sums and maxima add a block's own
window to the totals of earlier blocks. For the schedule a block is first composed to one
small summary, the summaries of a run are walked in order, and each block then starts from
the state its predecessors leave behind.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnloom.functions.schedule import Schedule
from turnloom.sources.sinks import staged

WIDTH = 16_384


def _block(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def running(
    df: DataFrame,
    key: str,
    order: str,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Add running sums/maxima over the *preceding* rows of the key (0 / null for the first)."""
    sums, maxes = sums or {}, maxes or {}
    vals = df.select("*", _block(order, width).alias("_b"), *[c.alias(f"_v_{n}") for n, c in {**sums, **maxes}.items()])
    totals = vals.groupBy(key, "_b").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes]
    )
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        key, "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxes],
    )
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = vals.select(
        "*",
        *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_n_{n}") for n in sums],
        *[F.max(f"_v_{n}").over(inside).alias(f"_n_{n}") for n in maxes],
    )
    return near.join(carried, [key, "_b"]).select(
        *df.columns,
        *[(F.col(f"_n_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_n_{n}", f"_c_{n}").alias(n) for n in maxes],
    )


def _rows(values, fields: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.Array:
    """Tuples as one Arrow struct per row, or one list of structs when a row holds several."""
    kind = pa.struct(list(zip(fields, kinds)))

    def named(t: tuple) -> dict:
        return dict(zip(fields, t))

    if values and isinstance(values[0], list):
        return pa.array([[named(t) for t in row] for row in values], pa.list_(kind))
    return pa.array([named(t) for t in values], kind)


def interp_schedule(
    df: DataFrame,
    key: str = "run",
    step: str = "step",
    loss: str = "loss",
    total: str = "total",
    t_start: float = 0.4,
    t_end: float = 1.0,
    alpha: float = 5e-4,
    beta: float = 0.99,
    adaptive: bool = True,
    width: int = WIDTH,
) -> DataFrame:
    """Interpolation weight t, momentum and delta after each logged loss of a run.

    The first loss (and any loss after an infinite one) only seeds the comparison. Spark
    groups the rows of a block and the few summaries of a run; the recursion inside a group
    is a short loop.
    """
    plan = Schedule(t_start, t_end, alpha, beta, adaptive)
    f64, i64 = pa.float64(), pa.int64()

    @F.arrow_udf("struct<first:double,last:double,factor:double,addend:double>")
    def summarise(losses: pa.Array) -> pa.Array:
        return _rows([plan.momentum_summary(x) for x in losses.to_pylist()], ("first", "last", "factor", "addend"), (f64,) * 4)

    @F.arrow_udf("array<struct<b:bigint,prev:double,m0:double>>")
    def enter_momentum(blocks: pa.Array) -> pa.Array:
        return _rows([plan.entering_momenta(x) for x in blocks.to_pylist()], ("b", "prev", "m0"), (i64, f64, f64))

    @F.arrow_udf("struct<c:double,d:double,lo:double,hi:double>")
    def block_map(losses: pa.Array, targets: pa.Array, prev: pa.Array, m0: pa.Array) -> pa.Array:
        args = zip(losses.to_pylist(), targets.to_pylist(), prev.to_pylist(), m0.to_pylist())
        return _rows([plan.block_map(*x) for x in args], ("c", "d", "lo", "hi"), (f64,) * 4)

    @F.arrow_udf("array<struct<b:bigint,t0:double>>")
    def enter_t(blocks: pa.Array) -> pa.Array:
        return _rows([plan.entering_t(x) for x in blocks.to_pylist()], ("b", "t0"), (i64, f64))

    @F.arrow_udf("array<struct<t:double,momentum:double,delta_t:double>>")
    def walk(losses: pa.Array, targets: pa.Array, prev: pa.Array, m0: pa.Array, t0: pa.Array) -> pa.Array:
        args = zip(losses.to_pylist(), targets.to_pylist(), prev.to_pylist(), m0.to_pylist(), t0.to_pylist())
        return _rows([list(plan.walk(*x)) for x in args], ("t", "momentum", "delta_t"), (f64,) * 3)

    goal = F.lit(t_start) + F.lit(t_end - t_start) * F.col(step) / F.col(total)
    item = F.struct(
        F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss"), goal.cast("double").alias("target")
    )
    blocks = (
        df.groupBy(key, _block(step, width).alias("b"))
        .agg(F.array_sort(F.collect_list(item)).alias("r"))
        .select(key, "b", F.col("r.step").alias("steps"), F.col("r.loss").alias("losses"), F.col("r.target").alias("targets"))
    )

    def in_order(rows: DataFrame, summary: Column) -> DataFrame:
        flat = rows.select(key, "b", summary.alias("e")).select(key, F.struct("b", "e.*").alias("e"))
        return flat.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es"))

    handed = in_order(blocks, summarise("losses")).select(key, F.inline_outer(enter_momentum("es")))
    ready = blocks.join(handed, [key, "b"])
    entered = in_order(ready, block_map("losses", "targets", "prev", "m0")).select(key, F.inline_outer(enter_t("es")))
    walked = ready.join(entered, [key, "b"]).select(
        key, "steps", walk("losses", "targets", "prev", "m0", "t0").alias("w")
    )
    rows = walked.select(key, F.inline_outer(F.arrays_zip("steps", "w")))
    return rows.select(key, F.col("steps").alias(step), "w.t", "w.momentum", "w.delta_t")


def cosine_curriculum(epoch: Column, lambda_max: float = 1.0, lambda_min: float = 0.0, num_loops: int = 10) -> Column:
    clamped = F.least(F.greatest(epoch, F.lit(0)), F.lit(num_loops)).cast("double")
    wave = (F.cos(clamped * F.pi() / num_loops) + 1.0) * 0.5
    return wave * F.lit(float(lambda_max - lambda_min)) + F.lit(float(lambda_min))


def _marks(records: DataFrame, key: str, eps: float, most: int) -> DataFrame:
    """(key, k): the rows of (key, k, v) that reach the mark, which is the value of the last row that did, plus ``eps``.

    The first row sets the first mark. One round finds the next such row of every key by a minimum that is formed in each
    task before the shuffle, so no key's rows are gathered. ``most`` rounds, fewer if no key goes on.
    """
    row = F.min(F.struct("k", "v")).alias("m")
    last = staged(records.groupBy(key).agg(row).select(key, "m.k", "m.v"), "mark")
    found = last.select(key, "k").where("false")
    for _ in range(most):
        marks = last.select(key, F.col("k").alias("after"), (F.col("v") + F.lit(float(eps))).alias("mark"))
        reached = records.join(marks, key).where((F.col("k") > F.col("after")) & (F.col("v") >= F.col("mark")))
        last = staged(reached.groupBy(key).agg(row).select(key, "m.k", "m.v"), "mark")
        if last.isEmpty():
            break
        found = found.unionByName(last.select(key, "k"))
    return found


def threshold_update(
    df: DataFrame, key: str, step: str, loss: str, start: float = 0.0, eps: float = 0.0, width: int = WIDTH
) -> DataFrame:
    """(key, step, loss, threshold): grows by 0.1 up to 1 whenever the loss has not improved.

    With eps = 0 the compared loss is the running maximum. With eps > 0 only a new strict
    maximum can reach the next mark. As the threshold is full after at most ten growths, the
    rows that reach a mark are found one growth at a time (:func:`_marks`).
    """
    seen = running(df.select(key, step, loss), key, step, maxes={"peak": F.col(loss)}, width=width)
    if eps == 0.0:
        hits = seen.withColumn("hit", F.coalesce((F.col(loss) >= F.col("peak")).cast("int"), F.lit(0)))
    else:
        seen = staged(seen, "peaks")
        records = seen.where(F.col(loss).isNotNull() & (F.col("peak").isNull() | (F.col(loss) > F.col("peak"))))
        narrow = records.select(key, F.col(step).cast("long").alias("k"), F.col(loss).cast("double").alias("v"))
        chosen = _marks(narrow, key, eps, max(0, int(10 * (1.0 - start))) + 1)
        hits = seen.join(chosen.withColumnRenamed("k", step).withColumn("hit", F.lit(1)), [key, step], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    counted = running(hits.select(key, step, loss, "hit"), key, step, sums={"before": F.col("hit")}, width=width)
    grown = F.least(F.lit(1.0), F.lit(float(start)) + F.lit(0.1) * (F.col("before") + F.col("hit")))
    return counted.select(key, step, loss, grown.alias("threshold"))
