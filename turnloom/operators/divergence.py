"""Teacher/student divergences over a table of recorded logits.

Input row: ``sample_id, pos, student array, teacher array, label``. A position is scored by
itself and only the resulting numbers are aggregated, with partial sums before
the shuffle. Pairing a position with the label after it is an equi-join on the unique key
(sample_id, pos), so one very long sample is no hot spot; for measures that do not look at
the label, the join happens after scoring and no logit vector is ever shuffled. For those that
do, :func:`record` stores the table once with the label next to its position, and every
measure then reads it in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from turnloom.config import LABEL_IGNORE
from turnloom.functions import logit as L
from turnloom.functions.logit_batches import scorer
from turnloom.sources.sinks import work_dir

# Defaults of the measures.
JS_BETA = 0.1
SKEW_BETA = 0.1
HEAD_THRESHOLD = 0.5
DKD_ALPHA = 1.0
DKD_BETA = 0.5
TEMP_START = 1.0
TEMP_END = 20.0
TARGET_SHIFT = 1000.0

LABEL_FREE = ("fkl", "rkl", "tvd", "js", "adaptive_kl", "sfkl", "srkl", "ctkd", "interp")
LABELLED = ("lm", "dkd")
KINDS = LABEL_FREE + LABELLED


def default_temperature(g: float = 1.0) -> float:
    """Temperature for a (learned elsewhere) global value g."""
    import math

    return TEMP_START + TEMP_END / (1.0 + math.exp(-g))


def next_labels(df: DataFrame) -> DataFrame:
    """(sample_id, pos, next_label, mask): what position ``pos`` is scored against."""
    return df.select(
        "sample_id",
        (F.col("pos") - 1).alias("pos"),
        F.col("label").alias("next_label"),
        (F.col("label") != LABEL_IGNORE).cast("int").alias("mask"),
    )


def align(df: DataFrame) -> DataFrame:
    """Attach the label of the following position; the last position of a sample drops out.

    A table of :func:`record` is aligned already.
    """
    if "next_label" in df.columns:
        return df
    return df.join(next_labels(df), ["sample_id", "pos"])


def _hand_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the label of the row behind them, where that is the next position of the same sample.

    The last row of a batch waits for the next batch, so one row is held. ``open`` rows have met no such row.
    """

    def paired(rows: pa.RecordBatch, behind: pa.RecordBatch) -> pa.RecordBatch:
        follows = pc.and_(
            pc.equal(behind["sample_id"], rows["sample_id"]), pc.equal(behind["pos"], pc.add(rows["pos"], pa.scalar(1, rows["pos"].type)))
        )
        follows = pc.fill_null(follows, False)
        label = pc.if_else(follows, behind["label"].cast(pa.int64()), pa.scalar(None, pa.int64()))
        return rows.append_column("next_label", label).append_column("open", pc.invert(follows))

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield paired(held, batch.slice(0, 1))
        if batch.num_rows > 1:
            yield paired(batch.slice(0, batch.num_rows - 1), batch.slice(1))
        # A copy, so that the batch itself is not kept for one row.
        held = batch.take(pa.array([batch.num_rows - 1]))
    if held is not None:
        yield held.append_column("next_label", pa.nulls(1, pa.int64())).append_column("open", pa.array([True]))


def record(df: DataFrame, label: str = "logits") -> DataFrame:
    """The logit table stored with ``next_label`` and ``mask``, for measures that look at the label.

    Rows that are written in the order of the positions, as runs log them, meet the label of the next row inside their
    task. Only rows without such a neighbour (the last of a task or sample, or rows out of order) are joined by
    (sample_id, pos); the vectors of all others are never shuffled, neither here nor by any measure afterwards. The last
    position of a sample drops out, as does a row whose sample_id or pos is null.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, label)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    df.mapInArrow(_hand_over, f"{fields}, next_label bigint, open boolean").write.partitionBy("open").parquet(f"{path}/rows")
    plain = f"{fields}, next_label bigint"
    rows = spark.read.schema(f"{plain}, open boolean").parquet(f"{path}/rows")
    labels = next_labels(rows.select("sample_id", "pos", "label")).select("sample_id", "pos", F.col("next_label").cast("long").alias("next_label"))
    late = rows.where("open").drop("open", "next_label").join(labels, ["sample_id", "pos"])
    late.select(*df.columns, "next_label").write.parquet(f"{path}/joined")
    both = rows.where("NOT open").drop("open").unionByName(spark.read.schema(plain).parquet(f"{path}/joined"))
    return both.withColumn("mask", (F.col("next_label") != LABEL_IGNORE).cast("int"))


def with_distributions(df: DataFrame, student: str = "student", teacher: str = "teacher") -> DataFrame:
    """Double logits, log-softmax and softmax of both sides, each worked out once per row."""
    return (
        df.withColumn("zs", F.col(student).cast("array<double>"))
        .withColumn("zt", F.col(teacher).cast("array<double>"))
        .withColumn("ls", L.log_softmax(F.col("zs")))
        .withColumn("lt", L.log_softmax(F.col("zt")))
        .withColumn("s", L.softmax(F.col("ls")))
        .withColumn("t", L.softmax(F.col("lt")))
    )


def _masked(values: Column, *logits: str) -> Column:
    """Elements whose logit is infinite count as zero."""
    for name in logits:
        values = F.zip_with(values, name, lambda v, z: F.when(L.is_inf(z), 0.0).otherwise(v))
    return values


def _product(p: Column | str, q: Column | str, *inf_of: str) -> Column:
    return L.total(_masked(F.zip_with(p, q, lambda a, b: a * b), *inf_of))


def fkl(t: str = "t", ls: str = "ls", zs: str = "zs") -> Column:
    return -_product(t, ls, zs)


def rkl() -> Column:
    return _product("s", "ls", "zs", "zt") - _product("s", "lt", "zs", "zt")


def tvd() -> Column:
    return F.lit(0.5) * L.total(_masked(F.zip_with("s", "t", lambda a, b: F.abs(b - a)), "zs", "zt"))


def _log_mix(weight_teacher: float) -> Column:
    return F.transform(L.mix(F.col("t"), F.col("s"), weight_teacher), lambda m: F.ln(m))


def js(beta: float = JS_BETA) -> Column:
    lm = _log_mix(beta)
    inf = ("zs", "zt")
    reverse = _product("s", "ls", *inf) - _product("s", lm, *inf)
    forward = _product("t", "lt", *inf) - _product("t", lm, *inf)
    return F.lit(1.0 - beta) * reverse + F.lit(float(beta)) * forward


def skew_fkl(weight: float = SKEW_BETA) -> Column:
    return -_product("t", _log_mix(weight), "zs", "zt")


def skew_rkl(weight: float = SKEW_BETA) -> Column:
    return _product("s", "ls", "zs", "zt") - _product("s", _log_mix(1.0 - weight), "zs", "zt")


def head_gap(threshold: float = HEAD_THRESHOLD, corrected: bool = False) -> Column:
    """(head, tail) sums of |t - s|.

    The head is the part of the ascending teacher distribution whose running total has
    reached the threshold. As in the measure's usual code the resulting places are applied
    to the *unsorted* gaps; ``corrected`` applies them to the sorted ones.
    """
    gap = F.zip_with("t", "s", lambda a, b: F.abs(a - b))
    pairs = F.array_sort(F.zip_with("t", gap, lambda p, g: F.struct(p.alias("p"), g.alias("g"))))
    below = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            (a["cum"] + x["p"]).alias("cum"),
            (a["n"] + F.when(a["cum"] + x["p"] >= F.lit(float(threshold)), 0).otherwise(1)).alias("n"),
        ),
        lambda a: a["n"],
    )
    ordered = F.transform(pairs, lambda x: x["g"]) if corrected else gap

    def part(keep) -> Column:
        return lambda n: L.total(F.transform(ordered, lambda g, i: F.when(keep(i, n), g).otherwise(0.0)))

    return F.get(
        F.transform(
            F.array(below),
            lambda n: F.struct(
                part(lambda i, m: i >= m)(n).alias("head"), part(lambda i, m: i < m)(n).alias("tail")
            ),
        ),
        F.lit(0),
    )


def adaptive(threshold: float = HEAD_THRESHOLD, corrected: bool = False) -> Column:
    return F.get(
        F.transform(
            F.array(head_gap(threshold, corrected)),
            # No gap at all gives no weights: not a number, as in plain float arithmetic.
            lambda g: F.when(g["head"] + g["tail"] == 0, F.lit(float("nan"))).otherwise(
                (g["head"] * fkl() + g["tail"] * rkl()) / (g["head"] + g["tail"])
            ),
        ),
        F.lit(0),
    )


def at_temperature(tau: float) -> Column:
    """Forward measure on logits divided by tau, times tau squared."""
    ls = L.log_softmax(L.scale(F.col("zs"), 1.0 / tau))
    t = L.softmax(L.log_softmax(L.scale(F.col("zt"), 1.0 / tau)))
    return F.lit(-float(tau) * float(tau)) * _product(t, ls, "zs")


def interpolated(t: float) -> Column:
    """Forward measure against softmax((1-t)*student + t*teacher)."""
    target = L.softmax(L.log_softmax(L.mix(F.col("zt"), F.col("zs"), t)))
    return -_product(target, "ls", "zs")


def lm_loss() -> Column:
    """Next-token cross-entropy of the student; null where the label is ignored."""
    return F.when(F.col("mask") == 1, -F.get("ls", F.col("next_label")))


def decoupled(
    alpha: float = DKD_ALPHA, beta: float = DKD_BETA, tau: float = 1.0, pad_id: int = 0, standardize: bool = False
) -> Column:
    """alpha * KL(target vs rest) + beta * KL(within the rest), times tau squared, times mask."""
    target = F.when(F.col("mask") == 1, F.col("next_label")).otherwise(F.lit(pad_id))

    def shaped(z: str) -> Column:
        raw = L.standardize(F.col(z)) if standardize else F.col(z)
        return L.scale(raw, 1.0 / tau)

    def without_target(z: Column) -> Column:
        return F.transform(z, lambda x, i: F.when(i == target, x - TARGET_SHIFT).otherwise(x))

    def kl(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * (F.ln(p) - F.ln(q))).otherwise(0.0)

    def two(z: Column) -> Column:
        """(target probability, probability of everything else)."""
        p = L.softmax(L.log_softmax(z))
        rest = L.total(F.transform(p, lambda x, i: F.when(i == target, 0.0).otherwise(x)))
        return F.struct(F.get(p, target).alias("hit"), rest.alias("rest"))

    zs, zt = shaped("zs"), shaped("zt")
    binary = F.get(
        F.zip_with(
            F.array(two(zt)), F.array(two(zs)),
            lambda t, s: kl(t["hit"], s["hit"]) + kl(t["rest"], s["rest"]),
        ),
        F.lit(0),
    )
    log_t, log_s = L.log_softmax(without_target(zt)), L.log_softmax(without_target(zs))
    among_rest = L.total(
        F.zip_with(log_t, log_s, lambda a, b: F.when(F.exp(a) > 0, F.exp(a) * (a - b)).otherwise(0.0))
    )
    return F.lit(float(tau) ** 2) * (F.lit(float(alpha)) * binary + F.lit(float(beta)) * among_rest) * F.col("mask")


def position_score(kind: str, **params) -> Column:
    """Score of one position by measure name; unknown names are an error."""
    if kind == "ctkd":
        return at_temperature(params.get("tau", default_temperature()))
    table = {
        "fkl": fkl, "rkl": rkl, "tvd": tvd, "js": js, "adaptive_kl": adaptive, "sfkl": skew_fkl,
        "srkl": skew_rkl, "interp": interpolated, "lm": lm_loss, "dkd": decoupled,
    }
    if kind not in table:
        raise NotImplementedError(kind)
    if kind == "interp":
        params = {"t": 0.4, **params}
    return table[kind](**params)


def masked_mean(value: Column, mask: Column) -> Column:
    """sum(value*mask)/sum(mask); null when nothing is unmasked."""
    return F.try_divide(F.sum(F.when(mask == 1, value).otherwise(0.0)), F.sum(mask).cast("double"))


def summary(kind: str, value: Column, mask: Column) -> Column:
    """How a measure's positions become one number."""
    if kind == "dkd":
        return F.sum(value) / F.count("*")
    if kind == "lm":
        return F.avg(value)
    return masked_mean(value, mask)


def _scores(kinds: dict[str, dict], labelled: bool, engine: str) -> list[Column]:
    for kind in kinds:
        if kind not in KINDS:
            raise NotImplementedError(kind)
    if engine == "expression":
        return [position_score(k, **p).alias(k) for k, p in kinds.items()]
    if engine != "arrow":
        raise ValueError(f"unknown engine {engine!r}")
    params = {k: ({"tau": default_temperature(), **p} if k == "ctkd" else p) for k, p in kinds.items()}
    fn = scorer(params)
    result = "struct<" + ",".join(f"{k}:double" for k in params) + ">"
    if labelled:

        @F.arrow_udf(result)
        def score(student: pa.Array, teacher: pa.Array, label: pa.Array, mask: pa.Array) -> pa.Array:
            return fn(student, teacher, label, mask)

        packed = score("student", "teacher", "next_label", "mask")
    else:

        @F.arrow_udf(result)
        def score(student: pa.Array, teacher: pa.Array) -> pa.Array:
            return fn(student, teacher)

        packed = score("student", "teacher")
    return [packed[k].alias(k) for k in params]


def score_positions(df: DataFrame, kinds: dict[str, dict], keep: tuple[str, ...] = (), engine: str = "arrow") -> DataFrame:
    """(keep, sample_id, pos, mask, one column per measure).

    Labels are joined before scoring only when a labelled measure is asked for, and not at all
    where :func:`record` has put them beside their positions. ``engine`` is ``arrow`` (matrix arithmetic over Arrow batches) or ``expression`` (array expressions
    in the JVM); both give the same numbers.
    """
    aligned = "next_label" in df.columns
    labelled = any(k in LABELLED for k in kinds)
    base = ["sample_id", "pos", *keep]
    prepared = with_distributions if engine == "expression" else (lambda d: d)
    scores = _scores(kinds, labelled, engine)
    if labelled or aligned:
        return prepared(align(df)).select(*base, "mask", *scores)
    narrow = prepared(df).select(*base, *scores)
    return narrow.join(next_labels(df).select("sample_id", "pos", "mask"), ["sample_id", "pos"])


def divergence(df: DataFrame, kind: str, by: tuple[str, ...] = (), engine: str = "arrow", **params) -> DataFrame:
    """One measure as a masked mean, over everything or per ``by`` group."""
    if kind == "sft":
        kind = "lm"
    scored = score_positions(df, {kind: params}, tuple(c for c in by if c != "sample_id"), engine)
    return scored.groupBy(*by).agg(summary(kind, F.col(kind), F.col("mask")).alias("value"))


def divergence_all(
    df: DataFrame, by: tuple[str, ...] = (), params: dict[str, dict] | None = None, engine: str = "arrow"
) -> DataFrame:
    """Every measure from one scan of the logits."""
    params = params or {}
    kinds = {k: params.get(k, {}) for k in KINDS}
    scored = score_positions(df, kinds, tuple(c for c in by if c != "sample_id"), engine)
    return scored.groupBy(*by).agg(*[summary(k, F.col(k), F.col("mask")).alias(k) for k in KINDS])


def combine(
    df: DataFrame, kind: str, ratio: float = 1.0, by: tuple[str, ...] = (), engine: str = "arrow", **params
) -> DataFrame:
    """lm_loss, distil_loss and loss = (1-ratio)*lm + ratio*distil. ``sft`` has no distil part."""
    groups = tuple(c for c in by if c != "sample_id")
    if kind == "sft":
        lm = divergence(df, "lm", by, engine).withColumnRenamed("value", "lm_loss")
        return lm.withColumn("distil_loss", F.lit(None).cast("double")).withColumn("loss", F.col("lm_loss"))
    scored = score_positions(df, {"lm": {}, kind: params}, groups, engine)
    agg = scored.groupBy(*by).agg(
        summary("lm", F.col("lm"), F.col("mask")).alias("lm_loss"),
        summary(kind, F.col(kind), F.col("mask")).alias("distil_loss"),
    )
    return agg.withColumn(
        "loss", F.lit(1.0 - ratio) * F.col("lm_loss") + F.lit(float(ratio)) * F.col("distil_loss")
    )
