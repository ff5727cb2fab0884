"""Whole preparation jobs: source rows -> split -> messages -> samples -> store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from turnloom.config import PrepConfig
from turnloom.functions.tokens import Dictionary, Vocabulary
from turnloom.operators import normalize as N
from turnloom.operators.batches import split_exact, split_given
from turnloom.operators.exact import Encode, expand_tokenized
from turnloom.operators.template import GENERIC, Template
from turnloom.operators.windows import expand_exact, expand_exact_words, expand_nested
from turnloom.sources import sinks


def expand_messages(
    df: DataFrame,
    keys: list[str],
    cfg: PrepConfig,
    vocab: Vocabulary | Dictionary | None = None,
    encode: Callable[[Column], Column] | None = None,
    template: Template = GENERIC,
    max_token_bytes: int | None = None,
    load: Callable[[], Encode] | None = None,
    slack: int = 1,
    min_message_tokens: int = 1,
) -> DataFrame:
    """Canonical messages -> samples.

    The word tokenizer takes the additive path. A tokenizer that tasks ``load`` themselves is
    tried near the limit only. A plug-in column function ``encode``, or think-span removal
    (which looks at the rendered text as a whole), takes the path that tries every start.
    """
    if load is not None:
        if cfg.enable_thinking == "false":
            raise ValueError("removal of think spans needs encode instead of load")
        return expand_tokenized(df, keys, cfg.budget, load, template, slack, min_message_tokens)
    if encode is None and cfg.enable_thinking != "false":
        return expand_nested(df, keys, cfg.budget, template, vocab, cfg=cfg)
    if encode is None:
        return expand_exact_words(df, keys, cfg.budget, vocab, template, cfg, template.min_cost)
    return expand_exact(df, keys, cfg.budget, encode, template, cfg, max_token_bytes)


def prepare(
    source: DataFrame,
    key: str,
    cfg: PrepConfig,
    vocab: Vocabulary | Dictionary | None = None,
    encode: Callable[[Column], Column] | None = None,
    evaluation: DataFrame | None = None,
    template: Template = GENERIC,
    level: str = "conversation",
    max_token_bytes: int | None = None,
    load: Callable[[], Encode] | None = None,
    slack: int = 1,
    min_message_tokens: int = 1,
) -> DataFrame:
    """Samples with their ``split``.

    ``level`` says what is split when no evaluation source is given: whole conversations,
    or single samples as the fixed preset does.
    """
    if level not in ("conversation", "sample"):
        raise ValueError(f"unknown split level {level!r}")

    def samples(df: DataFrame, keys: list[str]) -> DataFrame:
        messages = N.normalize(df, cfg, keep=keys)
        if cfg.on_error == "quarantine":
            messages = messages.where(F.col("error").isNull()).drop("error")
        out = expand_messages(messages, keys, cfg, vocab, encode, template, max_token_bytes, load, slack, min_message_tokens)
        return out.withColumn("sample_id", F.concat_ws("-", F.col(key).cast("string"), F.col("turn").cast("string")))

    if evaluation is not None:
        return samples(split_given(source, evaluation), [key, "split"])
    if level == "conversation":
        return samples(split_exact(source, key, cfg.eval_size, cfg.eval_ratio, cfg.seed), [key, "split"])
    expanded = sinks.staged(samples(source, [key]), "expanded")
    return split_exact(expanded, "sample_id", cfg.eval_size, cfg.eval_ratio, cfg.seed)


def store(samples: DataFrame, path: str, chunk_bytes: int | str = sinks.CHUNK_BYTES) -> None:
    sinks.write_chunks(
        samples.select("sample_id", "split", "input_ids", "labels", "prompt_ids", "response"), path, chunk_bytes
    )
