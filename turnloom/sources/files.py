"""Reading source corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType, VariantType

LOADERS = ("json", "jsonl", "parquet")


def file_list(value: str | None) -> list[str] | None:
    """Comma-separated file argument; blanks drop out."""
    if value is None:
        return None
    return [p.strip() for p in value.split(",") if p.strip()]


def variant_content(schema: StructType, content_fields: tuple[str, ...] = ("content", "value")) -> StructType:
    """The schema with message content (in lists of objects) as VARIANT, whatever was inferred."""

    def inner(t: DataType) -> DataType:
        if isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
            fields = [
                StructField(f.name, VariantType() if f.name in content_fields else f.dataType) for f in t.elementType.fields
            ]
            return ArrayType(StructType(fields))
        return t

    return StructType([StructField(f.name, inner(f.dataType)) for f in schema.fields])


def load_source(
    spark: SparkSession,
    loader: str,
    files: list[str] | str,
    schema: StructType | str | None = None,
    mixed_content: bool = False,
) -> DataFrame:
    """Rows of json/jsonl/parquet files.

    ``mixed_content`` keeps message content as VARIANT, so a text that looks like JSON and
    a real list stay different. Give a schema where one is known: without it JSON is read
    twice, once to infer it.
    """
    if loader not in LOADERS:
        raise ValueError(f"loader must be one of {LOADERS}, got {loader!r}")
    paths = [files] if isinstance(files, str) else list(files)
    if loader == "parquet":
        return spark.read.parquet(*paths)
    if mixed_content and schema is None:
        schema = variant_content(spark.read.json(paths).schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths)


def load_splits(
    spark: SparkSession, loader: str, train_files: str | None, eval_files: str | None = None, **kwargs
) -> DataFrame:
    """Train and evaluation file lists as one table with a ``split`` column."""
    splits = {"train": file_list(train_files), "validation": file_list(eval_files)}
    parts = [
        load_source(spark, loader, files, **kwargs).withColumn("split", F.lit(name)) for name, files in splits.items() if files
    ]
    if not parts:
        raise ValueError("no files given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def preset_column(columns: list[str]) -> str:
    """Fixed-corpus preset: ``messages`` when there, else ``chosen``."""
    return "messages" if "messages" in columns else "chosen"


def turns_to_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turn table -> (key, messages in turn order), one row per conversation.

    The nested layout holds a conversation in one row, however long it is. To expand a turn
    table use :func:`turnloom.operators.windows.expand_turns`, whose rows are bounded.
    """
    return (
        turns.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
        .select(
            key,
            F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"),
        )
    )
