"""Writing and reading the prepared store."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, FloatType, DoubleType, IntegerType, LongType, MapType, ShortType,
    StringType, StructType,
)

CHUNK_BYTES = 500_000_000
SPLITS = ("train", "test")
WIDTHS = {
    BooleanType(): 1, ByteType(): 1, ShortType(): 2, IntegerType(): 4, DateType(): 4, FloatType(): 4, LongType(): 8, DoubleType(): 8,
}


#: Fixed value: the characters a name may keep.
_NAME_CHARACTERS = "A-Za-z0-9._-"


def output_name(dataset: str, model_type: str | None = None, explicit: str | None = None) -> str:
    """Explicit name, else the dataset's last path part made safe, plus the model type."""
    if explicit:
        return explicit
    parts = [part for part in re.split(r"[/\\]", dataset) if part]
    safe = re.sub(f"[^{_NAME_CHARACTERS}]+", "-", parts[-1]) if parts else ""
    if not model_type:
        return safe or "prepared-data"
    return f"{safe}-{model_type}" if safe else model_type


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Only where none is configured (tests) one under the session's warehouse is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(
        spark.conf.get("spark.sql.warehouse.dir"), "turnloom-work"
    )
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def parse_bytes(size: int | str) -> int:
    """500_000_000, '500MB', '1.5GB', ..."""
    if isinstance(size, int):
        return size
    number, unit = re.fullmatch(r"\s*([\d.]+)\s*([KMGT]?B)\s*", size.upper()).groups()
    return int(float(number) * {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}[unit])


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write once to the shared folder and read back: costly input that is used several times."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(schema: StructType) -> Column:
    """Bytes of a row in memory, uncompressed: values and offsets of lists and texts; other nested values as JSON."""

    def of(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 4
        if isinstance(kind, ArrayType) and kind.elementType in WIDTHS:
            return F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)) * WIDTHS[kind.elementType] + 4
        if isinstance(kind, (ArrayType, StructType, MapType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 4
        return F.lit(WIDTHS.get(kind, 8))

    return sum((of(F.col(f.name), f.dataType) for f in schema.fields), F.lit(0)).cast("long")


def write_chunks(df: DataFrame, path: str, chunk_bytes: int | str = CHUNK_BYTES) -> None:
    """Write samples under ``path/split=.../`` in files of about ``chunk_bytes`` of uncompressed rows.

    The rows are produced once, into a staging folder. Their bytes per split give its number of files; rows are dealt to
    the files in turn, one task a file. So no session setting is touched, equal rows do not gather, and files of a split
    hold equally many rows; their bytes differ only as far as a few long rows do. A split without rows has no file.
    """
    chunk, staging = parse_bytes(chunk_bytes), work_dir(df.sparkSession, "chunks")
    # A folder per split there, so that the rows of a split are numbered without gaps in each file.
    df.write.partitionBy("split").parquet(staging)
    rows = df.sparkSession.read.schema(df.schema).parquet(staging)
    n = F.greatest(F.lit(1), F.ceil(F.sum("bytes") / chunk)).cast("long")
    plan = rows.select("split", row_bytes(df.schema).alias("bytes")).groupBy("split").agg(n.alias("n"))
    # One row per split; "first" numbers the files of all splits in one sequence.
    plan = staged(plan.withColumn("first", F.sum("n").over(Window.orderBy("split")) - F.col("n")), "chunk-plan")
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    turn = F.col("_metadata.row_index") + F.xxhash64(F.col("_metadata.file_path"))
    pairs = rows.withColumn("_turn", turn).alias("r").join(plan.alias("p"), F.col("r.split").eqNullSafe(F.col("p.split")))
    place = (F.col("p.first") + F.pmod(F.col("r._turn"), F.col("p.n"))).cast("int")
    dealt = pairs.select(*[F.col(f"r.{c}") for c in df.columns], place.alias("_place"))
    dealt.repartitionById(total, F.col("_place")).drop("_place").write.mode("overwrite").partitionBy("split").parquet(path)


def read_prepared(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The store, or one split of it (only that folder is listed and read)."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
