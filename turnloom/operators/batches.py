"""Exact splits, seeded shuffles, batches and collation.

Everything random is an md5 of seed and key, so a re-run (or a lost executor) gives the same
rows. Global positions are ranks of the keys alone (:mod:`turnloom.operators.ranks`), joined back
to the wide rows once. A split needs less: hash buckets are counted, and only the one on the cut
is ranked. No step sorts or numbers the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnloom.config import LABEL_IGNORE, BatchSpec
from turnloom.functions import arrays as A
from turnloom.operators.ranks import with_rank

HASH_DIGITS = 3
# What may come with the ids of a sample. The first kind runs along the ids, the second is joined over a batch.
SIDE = ("attention_mask", "mm_token_type_ids")
MEDIA = ("pixel_values", "pixel_values_videos", "image_grid_thw", "video_grid_thw")
#: Leads the names of side columns of the prompt.
PROMPT = "prompt_"


def seeded_hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def unit_hash(seed: int, key: Column) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _offsets(df: DataFrame) -> DataFrame:
    """Per bucket: rows in it, rows before it and rows of the whole table.

    There are at most 16**HASH_DIGITS buckets, so one task sees no more than that many rows.
    """
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        df.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select(
            "_bucket", "_size", (F.sum("_size").over(running) - F.col("_size")).alias("_before"),
            F.sum("_size").over(everything).alias("_total"),
        )
    )


def _bucketed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_h", seeded_hash(seed, F.col(key))).withColumn(
        "_bucket", F.substring("_h", 1, HASH_DIGITS)
    )


def shuffled_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add ``rank``, the row's 0-based place in the seeded order, and ``_total``. ``key`` must be unique."""
    return with_rank(df, key, seeded_hash(seed, F.col(key)), key)


def ordered_rank(df: DataFrame, key: str) -> DataFrame:
    """Add ``rank`` in ascending order of a unique key, and ``_total``."""
    return with_rank(df, key, key)


def eval_size(n: Column, size: int, ratio: float) -> Column:
    """Evaluation rows out of ``n``: the fixed size capped at n-1; the ratio only if size <= 0."""
    most = F.greatest(F.lit(1), n - 1)
    fixed = F.least(F.lit(size), most)
    by_ratio = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(float(ratio)))), most)
    return F.when(n < 2, F.raise_error(F.lit("need at least 2 rows to derive an evaluation split"))).when(
        fixed > 0, fixed
    ).otherwise(by_ratio).cast("long")


def split_exact(df: DataFrame, key: str, size: int, ratio: float = 0.02, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly eval_size(n) rows are ``test``, the rest ``train``.

    Only the key column is counted. Rows of a bucket wholly before or after the cut are
    decided by the bucket alone; the one bucket on the cut is ranked to find the last test
    key. The wide rows are read once and never shuffled.
    """
    keys = _bucketed(df.select(key), key, seed)
    buckets = _offsets(keys).withColumn("_k", eval_size(F.col("_total"), size, ratio))
    edge = buckets.where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_size") > F.col("_k")))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
    last = (
        keys.join(F.broadcast(edge.select("_bucket", "_before", "_k")), "_bucket")
        .withColumn("_place", place)
        .where(F.col("_before") + F.col("_place") == F.col("_k"))
        .select("_bucket", F.struct("_h", F.col(key)).alias("_last"))
    )
    plan = buckets.join(F.broadcast(last), "_bucket", "left").select(
        "_bucket", (F.col("_before") + F.col("_size") <= F.col("_k")).alias("_inside"), "_last"
    )
    in_test = F.col("_inside") | F.coalesce(F.struct("_h", F.col(key)) <= F.col("_last"), F.lit(False))
    return (
        _bucketed(df, key, seed)
        .join(F.broadcast(plan), "_bucket")
        .withColumn("split", F.when(in_test, "test").otherwise("train"))
        .drop("_h", "_bucket", "_inside", "_last")
    )


def split_given(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Two given sources as one table with a ``split`` column."""
    return train.withColumn("split", F.lit("train")).unionByName(
        evaluation.withColumn("split", F.lit("test")), allowMissingColumns=True
    )


def batch_ids(df: DataFrame, key: str, batch_size: int, seed: int | None = 42, drop_last: bool = True) -> DataFrame:
    """Add ``batch_id`` and ``slot``; a seed shuffles, None keeps key order.

    With ``drop_last`` the rows of a short last batch are left out.
    """
    ranked = ordered_rank(df, key) if seed is None else shuffled_rank(df, key, seed)
    if drop_last:
        ranked = ranked.where(F.col("rank") < F.col("_total") - F.col("_total") % batch_size)
    return ranked.select(
        "*", F.floor(F.col("rank") / batch_size).alias("batch_id"), (F.col("rank") % batch_size).cast("int").alias("slot")
    ).drop("rank", "_total")


def limit_batches(df: DataFrame, limit: float) -> DataFrame:
    """First batches: a value up to 1.0 is a fraction of all batches (cut down), above a count."""
    if limit > 1.0:
        return df.where(F.col("batch_id") < int(limit))
    batches = df.agg((F.max("batch_id") + 1).alias("n")).scalar()
    return df.where(F.col("batch_id") < F.floor(batches * F.lit(float(limit))))


def padded(df: DataFrame, spec: BatchSpec) -> DataFrame:
    """Per sample: right-padded inputs with mask and labels, left-padded prompts with mask."""
    ids = A.pad_right(F.col("input_ids"), spec.max_length, spec.pad_id)
    prompt = A.pad_left(F.col("prompt_ids"), spec.max_input, spec.pad_id)
    return df.withColumns(
        {
            "input_ids": ids,
            "attention_mask": A.attention_mask(ids, spec.pad_id),
            "labels": A.pad_right(F.col("labels"), spec.max_length, LABEL_IGNORE),
            "prompt_ids": prompt,
            "prompt_mask": A.attention_mask(prompt, spec.pad_id),
        }
    )


def collate(df: DataFrame, spec: BatchSpec) -> DataFrame:
    """One row per batch with lists in slot order. Unpadded rows are shuffled, padding comes after.

    Needs batch_id, slot, input_ids, labels, prompt_ids, response. Of the optional columns, those that ``df`` has are used:
    ``attention_mask`` and ``mm_token_type_ids`` (of input_ids) and ``prompt_attention_mask`` and
    ``prompt_mm_token_type_ids`` (of prompt_ids) are padded with zeros like their ids, and a given mask takes the place of
    the one told from the pad id. Media columns (:data:`MEDIA`, lists with one entry per patch or picture) are joined over
    the batch into one list, with ``<name>_offsets``: sample ``slot`` owns the entries from ``offsets[slot]`` up to
    ``offsets[slot + 1]``. A null mask or type list counts as zeros and a null media list as no entries.
    """
    given = [c for c in (*SIDE, *(PROMPT + c for c in SIDE), *MEDIA) if c in df.columns]
    fields = ["slot", "input_ids", "labels", "prompt_ids", "response", *given]
    # Ordered by the slot alone: it is unique in a batch, and media need not be comparable.
    by_slot = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: (a["slot"] - b["slot"]).cast("int"))
    rows = df.groupBy("batch_id").agg(by_slot.alias("rows"))

    def column(fn) -> Column:
        return F.transform("rows", fn)

    def zeros(r: Column, name: str) -> Column:
        return F.coalesce(r[name], F.array().cast(df.schema[name].dataType))

    def sides(pad, length: int, ids: str, lead: str = "") -> list[Column]:
        told = F.transform(ids, lambda x: A.attention_mask(x, spec.pad_id))
        padded = {c: column(lambda r: pad(zeros(r, lead + c), length, 0)) for c in SIDE if lead + c in given}
        return [v.alias(c) for c, v in {SIDE[0]: told, **padded}.items()]

    def media(name: str) -> list[Column]:
        sizes = column(lambda r: F.greatest(F.coalesce(F.size(r[name]), F.lit(0)), F.lit(0)))
        offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return [F.flatten(column(lambda r: zeros(r, name))).alias(name), offsets.alias(f"{name}_offsets")]

    ids = column(lambda r: A.pad_right(r["input_ids"], spec.max_length, spec.pad_id))
    prompts = column(lambda r: A.pad_left(r["prompt_ids"], spec.max_input, spec.pad_id))
    return rows.select("batch_id", "rows", ids.alias("i"), prompts.alias("p")).select(
        "batch_id",
        F.struct(
            F.col("i").alias("input_ids"),
            *sides(A.pad_right, spec.max_length, "i"),
            column(lambda r: A.pad_right(r["labels"], spec.max_length, LABEL_IGNORE)).alias("labels"),
            *[c for name in MEDIA if name in given for c in media(name)],
        ).alias("model_inputs"),
        F.struct(
            F.col("p").alias("input_ids"),
            *sides(A.pad_left, spec.max_input, "p", PROMPT),
            column(lambda r: r["response"]).alias("response"),
        ).alias("model_inputs_gen"),
    )


def best_step(df: DataFrame, run: str, step: str, score: str) -> DataFrame:
    """Per run the row with the highest score; the earliest step on a tie."""
    return df.groupBy(run).agg(
        F.max_by(F.struct(step, score), F.struct(F.col(score), -F.col(step))).alias("b")
    ).select(run, f"b.{step}", f"b.{score}")
