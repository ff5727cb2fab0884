"""Bring every supported corpus layout to one ``messages`` column.

Canonical message: ``struct<role string, text string, parts array<part>>``; ``parts`` is
null unless content is kept as a list (preserve mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DataType, MapType, NumericType, StringType, StructType, VariantType,
)

from turnloom.config import PrepConfig
from turnloom.functions import content as C
from turnloom.functions import text as X

MESSAGES_TYPE = f"array<struct<role:string,text:string,parts:array<{C.PART_TYPE}>>>"


def detect_format(columns: list[str], cfg: PrepConfig) -> str:
    """Layout of a source, decided once from its column names."""
    if cfg.input_format != "auto":
        return cfg.input_format
    have = set(columns)
    named = (
        (cfg.messages_column, "messages"),
        (cfg.chosen_column, "chosen"),
        (cfg.conversations_column, "sharegpt"),
        (cfg.output_column, "alpaca"),
        (cfg.response_column, "prompt-response"),
    )
    usual = (
        ([{"messages"}], "messages"),
        ([{"chosen"}], "chosen"),
        ([{"conversations"}, {"conversation"}], "sharegpt"),
        ([{"instruction", "output"}], "alpaca"),
        (
            [{"prompt", "response"}, {"prompt", "completion"}, {"question", "answer"}, {"question", "response"}],
            "prompt-response",
        ),
    )
    for column, layout in named:
        if column and column in have:
            return layout
    for alternatives, layout in usual:
        if any(need <= have for need in alternatives):
            return layout
    raise ValueError("cannot tell the input format; set input_format and the matching column names")


def _mixed(value: Column, dtype: DataType) -> tuple[Column, DataType]:
    """Typed lists of parts or texts, and objects, as the VARIANT they stand for; fields without a value are null members."""
    if isinstance(dtype, StructType) or (
        isinstance(dtype, ArrayType) and isinstance(dtype.elementType, (StructType, StringType))
    ):
        return F.to_variant_object(value), VariantType()
    if isinstance(dtype, (ArrayType, MapType, BinaryType)):
        raise TypeError(f"message content cannot be {dtype.simpleString()}")
    return value, dtype


def _given(value: Column, dtype: DataType) -> Column:
    """Whether a raw value counts as present: not null, empty, zero or false."""
    value, dtype = _mixed(value, dtype)
    if isinstance(dtype, VariantType):
        return F.coalesce(~F.to_json(value).isin('""', "[]", "{}", "0", "0.0", "false", "null"), F.lit(False))
    if isinstance(dtype, BooleanType):
        return F.coalesce(value, F.lit(False))
    return F.coalesce(value != (F.lit(0) if isinstance(dtype, NumericType) else F.lit("")), F.lit(False))


def content_fields(value: Column, dtype: DataType, cfg: PrepConfig) -> tuple[Column, Column, Column]:
    """(text, parts, error) of one content value: a text, number, boolean, VARIANT, or typed list of parts or texts."""
    value, dtype = _mixed(value, dtype)
    mode = cfg.multimodal_mode
    wrap = cfg.use_processor and mode == "preserve"
    no_parts = F.lit(None).cast(f"array<{C.PART_TYPE}>")
    no_error = F.lit(None).cast("string")
    empty = F.array().cast(f"array<{C.PART_TYPE}>")
    if not isinstance(dtype, VariantType):
        own = value.cast("string")
        text = F.coalesce(F.initcap(own) if isinstance(dtype, BooleanType) else own, F.lit(""))
        parts = F.when(value.isNull(), empty).otherwise(C.text_part(text)) if wrap else no_parts
        return text, parts, no_error
    what = C.kind(value)
    items = C.parts_of(value)
    plain = F.when(what == "null", "").otherwise(C.scalar_text(value))
    text = F.when(what == "list", C.render_parts(items, mode)).otherwise(plain)
    error = F.when(what == "list", C.part_error(items, mode))
    if mode != "preserve":
        return text, no_parts, error
    scalar_parts = F.when(what == "null", empty).otherwise(C.text_part(plain)) if wrap else no_parts
    return text, F.when(what == "list", items).otherwise(scalar_parts), error


def _message(role: Column, value: Column, dtype: DataType, cfg: PrepConfig) -> Column:
    text, parts, error = content_fields(value, dtype, cfg)
    return F.struct(role.alias("role"), text.alias("text"), parts.alias("parts"), error.alias("error"))


def _from_list(df: DataFrame, column: str, role_field: str, content_field: str, cfg: PrepConfig) -> Column:
    dtype = df.schema[column].dataType
    if not (isinstance(dtype, ArrayType) and isinstance(dtype.elementType, StructType)):
        raise TypeError(f"column {column!r} must be a list of message objects, got {dtype.simpleString()}")
    fields = {f.name: f.dataType for f in dtype.elementType.fields}
    content_type = fields.get(content_field, StringType())

    def one(m: Column) -> Column:
        value = m[content_field] if content_field in fields else F.lit(None).cast("string")
        role = X.role_or_null(m[role_field], cfg.preserve_developer)
        known = _message(role, value, content_type, cfg)
        bad_role = F.when(role.isNull(), F.concat(F.lit("unsupported role: "), F.coalesce(m[role_field], F.lit("null"))))
        return known.withField("error", F.coalesce(bad_role, known["error"]))

    return F.transform(df[column], one)


def _pair(df: DataFrame, user: Column, user_type: DataType, answer: str, cfg: PrepConfig) -> Column:
    """[system] + user + assistant."""

    def value(name: str) -> tuple[Column, DataType]:
        if name in df.columns:
            return df[name], df.schema[name].dataType
        return F.lit(None).cast("string"), StringType()

    turns = []
    if cfg.system_column and cfg.system_column in df.columns:
        system, system_type = value(cfg.system_column)
        message = _message(F.lit("system"), system, system_type, cfg)
        turns.append(F.when(_given(system, system_type), message))
    turns.append(_message(F.lit("user"), user, user_type, cfg))
    turns.append(_message(F.lit("assistant"), *value(answer), cfg))
    return F.filter(F.array(*turns), lambda m: m.isNotNull())


def first_present(columns: list[str], *names: str) -> str:
    """First of the names that is a column; the last name when none is."""
    return next((n for n in names if n in columns), names[-1])


def messages_column(df: DataFrame, cfg: PrepConfig) -> Column:
    layout = detect_format(df.columns, cfg)
    cols = df.columns
    if layout == "messages":
        return _from_list(df, cfg.messages_column or "messages", cfg.role_field, cfg.content_field, cfg)
    if layout == "chosen":
        return _from_list(df, cfg.chosen_column or "chosen", cfg.role_field, cfg.content_field, cfg)
    if layout == "sharegpt":
        column = cfg.conversations_column or first_present(cols, "conversations", "conversation")
        return _from_list(df, column, cfg.sharegpt_role_field, cfg.sharegpt_content_field, cfg)
    if layout == "alpaca":
        prompt, extra = (
            df[name] if name in cols else F.lit(None)
            for name in (cfg.instruction_column or "instruction", cfg.input_column or "input")
        )
        return _pair(df, X.prompt_join(prompt, extra), StringType(), cfg.output_column or "output", cfg)
    prompt = cfg.prompt_column or first_present(cols, "prompt", "question")
    answer = cfg.response_column or first_present(cols, "response", "completion", "answer")
    user, user_type = (df[prompt], df.schema[prompt].dataType) if prompt in cols else (F.lit(None), StringType())
    return _pair(df, user, user_type, answer, cfg)


def normalize(df: DataFrame, cfg: PrepConfig, keep: list[str]) -> DataFrame:
    """Rows with the ``keep`` columns and canonical ``messages``; all other source columns go.

    With ``on_error='raise'`` a bad role or content item fails the job; with
    ``'quarantine'`` the row stays, with its reason in ``error``.
    """
    checked = df.select(*keep, messages_column(df, cfg).alias("m"))
    first_error = F.element_at(
        F.filter(F.transform("m", lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(1)
    )
    first_error = F.when(F.exists("m", lambda x: x["error"].isNotNull()), first_error)
    clean = F.transform("m", lambda x: F.struct(x["role"], x["text"], x["parts"])).cast(MESSAGES_TYPE)
    if cfg.on_error == "quarantine":
        return checked.select(*keep, clean.alias("messages"), first_error.alias("error"))
    return checked.select(
        *keep, F.when(first_error.isNotNull(), F.raise_error(first_error)).otherwise(clean).alias("messages")
    )


def ends_with_assistant(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False))


def has_assistant(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"] == "assistant")
