"""Text metrics over (prediction, target) pairs and their aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnloom.functions import rouge as R
from turnloom.functions.text import norm_answer


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of [a-z0-9], before stemming."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pair_scores(preds: pa.Array, targets: pa.Array, stemmed: bool = True) -> pa.Array:
    """ROUGE-L of pairs of word lists. Words become Python objects one pair at a time: those of a whole batch would take
    several times the bytes of its texts."""

    def prepared(words: pa.Scalar) -> list[str]:
        return [R.stem(w) if stemmed and len(w) > 3 else w for w in words.as_py() or []]

    out = []
    for p, t in zip(preds, targets):
        p, t = prepared(p), prepared(t)
        out.append(R.f_measure(R.lcs_length(t, p), len(t), len(p)))
    return pa.array(out, pa.float64())


def rouge_l(pred: Column, target: Column, stemmed: bool = True) -> Column:
    """ROUGE-L F-measure of one pair. Words longer than three letters are stemmed."""

    @F.arrow_udf("double")
    def score(preds: pa.Array, targets: pa.Array) -> pa.Array:
        return pair_scores(preds, targets, stemmed)

    return score(rouge_tokens(pred), rouge_tokens(target))


def exact_match(pred: Column, target: Column) -> Column:
    """Share of pairs equal after normalisation."""
    return F.avg((norm_answer(pred) == norm_answer(target)).cast("double"))


def checked_pairs(df: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """Pairs must be complete: a prediction without target (or the other way round) fails the job."""
    whole = F.col(pred).isNotNull() & F.col(target).isNotNull()
    return df.withColumn(
        pred, F.when(whole, F.col(pred)).otherwise(F.raise_error(F.lit("prediction and target counts differ")))
    )


def eval_metrics(df: DataFrame, by: tuple[str, ...] = (), pred: str = "pred", target: str = "target") -> DataFrame:
    """exact_match and rougeL, both times 100."""
    return (
        checked_pairs(df, pred, target)
        .groupBy(*by)
        .agg(
            (F.lit(100.0) * exact_match(F.col(pred), F.col(target))).alias("exact_match"),
            (F.lit(100.0) * F.avg(rouge_l(F.col(pred), F.col(target)))).alias("rougeL"),
        )
    )


def eval_by_set(pairs: DataFrame, losses: DataFrame, by: str = "eval_set") -> DataFrame:
    """Per eval set: unweighted mean of batch losses and text metrics over all pairs, long form."""
    loss = losses.groupBy(by).agg(F.avg("loss").alias("loss"))
    wide = loss.join(eval_metrics(pairs, (by,)), by, "full")
    named = F.map_from_arrays(
        F.array(F.lit("loss"), F.lit("exact_match"), F.lit("rougeL")), F.array("loss", "exact_match", "rougeL")
    )
    return wide.select(by, F.explode(metric_names(named, F.concat(F.lit("val_"), F.col(by).cast("string")))).alias("name", "value"))


def metric_names(metrics: Column, step: Column, prefix: str = "") -> Column:
    """Keys become ``step/prefix+key``; null values drop out."""
    kept = F.map_filter(metrics, lambda k, v: v.isNotNull())
    return F.transform_keys(kept, lambda k, v: F.concat(step, F.lit("/"), F.lit(prefix), k))
