"""Array expressions over logit vectors. Everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def is_inf(x: Column) -> Column:
    return (x == F.lit(INF)) | (x == F.lit(-INF))


def log_softmax(logits: Column) -> Column:
    peak = F.array_max(logits)
    norm = F.aggregate(
        logits,
        F.struct(peak.alias("m"), F.lit(0.0).alias("s")),
        lambda acc, x: F.struct(acc["m"].alias("m"), (acc["s"] + F.exp(x - acc["m"])).alias("s")),
        lambda acc: acc["m"] + F.log(acc["s"]),
    )
    # The normaliser is the fold's start value, so it is worked out once per row and not per element.
    return F.flatten(F.transform(F.array(norm), lambda n: F.transform(logits, lambda x: x - n)))


def softmax(log_probs: Column) -> Column:
    return F.transform(log_probs, lambda x: F.exp(x))


def scale(logits: Column, factor: float) -> Column:
    return F.transform(logits, lambda x: x * F.lit(float(factor)))


def standardize(logits: Column) -> Column:
    """(x - mean) / (1e-7 + sample standard deviation)."""
    moments = F.aggregate(
        logits,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda a, x: F.struct(
            (a["n"] + 1).alias("n"),
            (a["mean"] + (x - a["mean"]) / (a["n"] + 1)).alias("mean"),
            (a["m2"] + (x - a["mean"]) * (x - a["mean"]) * a["n"] / (a["n"] + 1)).alias("m2"),
        ),
        lambda a: F.struct(a["mean"].alias("mean"), F.sqrt(F.try_divide(a["m2"], a["n"] - 1)).alias("std")),
    )
    return F.flatten(
        F.transform(
            F.array(moments),
            lambda m: F.transform(logits, lambda x: (x - m["mean"]) / (F.lit(1e-7) + m["std"])),
        )
    )


def mix(first: Column, second: Column, weight_first: float) -> Column:
    """weight * first + (1 - weight) * second, element by element."""
    w = float(weight_first)
    return F.zip_with(first, second, lambda a, b: a * F.lit(w) + b * F.lit(1.0 - w))
