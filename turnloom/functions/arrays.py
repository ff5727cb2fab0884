"""Column expressions over token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnloom.config import LABEL_IGNORE


def tail(ids: Column, k: Column | int) -> Column:
    """Last k items; the whole array when it is shorter."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(ids, F.greatest(F.size(ids) - k, F.lit(0)) + 1, F.greatest(k, F.lit(0)))


def repeat(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(times, F.lit(0)).cast("int"))


def pad_right(ids: Column, length: int, fill: int) -> Column:
    return F.concat(F.slice(ids, 1, length), repeat(fill, F.lit(length) - F.size(ids)))


def pad_left(ids: Column, length: int, fill: int) -> Column:
    return F.concat(repeat(fill, F.lit(length) - F.size(ids)), F.slice(ids, 1, length))


def attention_mask(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def drop_pad(ids: Column, pad_id: int) -> Column:
    return F.filter(ids, lambda x: x != pad_id)


def count_tokens(ids: Column, pad_id: int) -> Column:
    return F.size(drop_pad(ids, pad_id))


def cut_generated(ids: Column, input_len: Column) -> Column:
    return F.slice(ids, input_len + 1, F.greatest(F.size(ids) - input_len, F.lit(0)))


def pack_generated(prompt: Column, response: Column, length: int, pad_id: int) -> Column:
    """Prompt and generated ids without padding, packed into one right-padded row.

    Labels cover the response only. Token types keep the prompt's zeros and are zero on
    the response, so a text row is all zeros.
    """
    p, r = drop_pad(prompt, pad_id), drop_pad(response, pad_id)
    labels = F.concat(repeat(LABEL_IGNORE, F.size(p)), r)
    ids = pad_right(F.concat(p, r), length, pad_id)
    return F.struct(
        ids.alias("input_ids"),
        attention_mask(ids, pad_id).alias("attention_mask"),
        pad_right(labels, length, LABEL_IGNORE).alias("labels"),
    )


def pack_token_types(prompt: Column, prompt_types: Column, response: Column, length: int, pad_id: int) -> Column:
    """Token-type row that goes with :func:`pack_generated`."""
    kept = F.transform(
        F.filter(F.arrays_zip(prompt.alias("i"), prompt_types.alias("t")), lambda z: z["i"] != pad_id),
        lambda z: z["t"],
    )
    return pad_right(F.concat(kept, repeat(0, F.size(drop_pad(response, pad_id)))), length, 0)
