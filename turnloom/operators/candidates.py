"""Which windows were up for choice: the legal starts of every target and their lengths, from prefix sums of costs.

Expansion itself (:mod:`turnloom.operators.windows`) walks back and keeps the longest window; this gives the table behind
that choice. All of it is relational: running sums in blocks, and a join of targets to starts by slices of the running
cost, so a very long conversation is spread over many (conversation, slice) keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnloom.config import Budget
from turnloom.functions.text import PREFIX_ROLES, words
from turnloom.operators.folds import running
from turnloom.operators.template import GENERIC, ROLES, Template


def _costs(turns: DataFrame, key: str, template: Template) -> DataFrame:
    """Turns with word count, cost, cost of the turns before, legal starts up to here, and the head of the conversation.

    A conversation without a turn outside its head (system, developer) has no body and no rows here.
    """
    extra = F.element_at(F.create_map(*[F.lit(x) for r in ROLES for x in (r, template.cost(r))]), F.col("role"))
    counted = turns.select(key, "turn", "role", F.coalesce(F.size(words(F.col("text"))), F.lit(0)).alias("n"))
    counted = counted.withColumn("cost", F.col("n") + extra)
    answer = F.col("role") == "assistant"
    body = counted.where(~F.col("role").isin(*PREFIX_ROLES)).groupBy(key).agg(F.min("turn").alias("first"))
    sums = running(
        counted, key, "turn", sums={"before": F.col("cost"), "answers": answer.cast("int")}, maxes={"last_answer": F.when(answer, F.col("turn"))}
    )
    head = sums.join(body, key).where(F.col("turn") == F.col("first")).select(key, "first", F.col("before").alias("head"))
    return sums.join(head, key).where(F.col("turn") >= F.col("first"))


def candidate_windows(turns: DataFrame, budget: Budget, template: Template = GENERIC, key: str = "conv_id") -> DataFrame:
    """(key, turn, n_starts, start, n_prompt, n_full, fits) for the windows of every assistant turn.

    ``n_starts`` counts the legal starts: the first turn of the body and each turn after an earlier answer. Listed are all
    starts whose window fits and, if none does, the nearest one, which is the one that is cut. All other legal starts lie
    before the first listed one and are too long, as windows only grow backwards. The rows of a target are bounded by the
    budget. An answer over ``max_output`` fits nowhere. Turns without a text count no words.
    """
    if template.harmony:
        raise ValueError("lengths of the merged-prefix family do not add up per message")
    rows = _costs(turns, key, template)
    span = max(budget.max_input, 1)
    opening = len(template.generation_words)

    def slice_of(c: str) -> Column:
        return F.floor(F.col(c) / span)

    starts = rows.where((F.col("turn") == F.col("first")) | (F.col("last_answer") == F.col("turn") - 1)).select(
        key, F.col("turn").alias("start"), F.col("before").alias("skipped"), slice_of("before").alias("slice")
    )
    nearest = F.coalesce(F.col("last_answer") + 1, F.col("first"))
    targets = rows.where(F.col("role") == "assistant").select(
        key, "turn", "n", "cost", "head", "before", nearest.alias("nearest"), (F.col("answers") + 1).cast("long").alias("n_starts")
    )

    n_prompt = F.col("head") + F.col("before") - F.col("skipped") + opening
    n_full = F.col("head") + F.col("before") - F.col("skipped") + F.col("cost")
    fits = (n_prompt <= budget.max_input) & (n_full <= budget.max_length) & (F.col("n") <= budget.max_output)
    columns = [key, "turn", "n_starts", "start", *[c.cast("long").alias(a) for c, a in ((n_prompt, "n_prompt"), (n_full, "n_full"))]]

    # A fitting window costs at most max_input, so it starts in the target's slice of the running cost or in the one before.
    near = targets.withColumn("slice", F.explode(F.array(slice_of("before"), slice_of("before") - 1)))
    fitting = near.join(starts, [key, "slice"]).where((F.col("start") <= F.col("turn")) & fits)
    cut = targets.join(starts.withColumnRenamed("start", "nearest"), [key, "nearest"]).withColumn("start", F.col("nearest")).where(~fits)
    return fitting.select(*columns, F.lit(True).alias("fits")).unionByName(cut.select(*columns, F.lit(False).alias("fits")))
