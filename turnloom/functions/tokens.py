"""Word tokens, vocabularies, dictionaries and plug-in tokenizers.

Splitting text into words stays in the JVM. Two fitted artefacts turn words into ids:

* a :class:`Vocabulary` of at most ``max_size`` words, looked up in whole Arrow batches; other words are ``<unk>``;
* a :class:`Dictionary` of every word. Its ids are ranks of a distributed sort and stay in a table; the most frequent
  words, a bounded number, are looked up like a vocabulary, and only the others are joined by word.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from turnloom.functions.text import words
from turnloom.operators.ranks import ranked
from turnloom.sources.sinks import staged

# Fixed ids of the tokens that are not words.
SPECIAL_TOKENS = (
    "<pad>",
    "<unk>",
    "<|system|>",
    "<|developer|>",
    "<|user|>",
    "<|assistant|>",
    "<|tool|>",
    "<|end|>",
)
PAD_ID = 0
UNK_ID = 1
DEFAULT_VOCAB_SIZE = 32_000
#: Words of a dictionary that are looked up on the workers (some megabytes), the most frequent first.
HOT_WORDS = 1 << 17


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Corpus frequency of every word that is not a special token."""
    return (
        df.select(F.explode(words(F.col(text))).alias("token"))
        .where(~F.col("token").isin(*SPECIAL_TOKENS))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def vocab_table(df: DataFrame, text: str = "text", max_size: int = DEFAULT_VOCAB_SIZE) -> DataFrame:
    """(token, n, id) of the most frequent words: ids follow frequency, ties the word itself.

    The top-k runs distributed; only the at most ``max_size`` kept words are numbered in
    one place.
    """
    from pyspark.sql import Window

    kept = word_counts(df, text).orderBy(F.desc("n"), "token").limit(max_size - len(SPECIAL_TOKENS))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return kept.select("token", "n", (rank - 1 + len(SPECIAL_TOKENS)).cast("int").alias("id"))


@dataclass(frozen=True)
class Vocabulary:
    """Words in id order, special tokens first."""

    tokens: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", max_size: int = DEFAULT_VOCAB_SIZE) -> Vocabulary:
        """Learn a vocabulary; at most ``max_size`` words reach the driver."""
        rows = vocab_table(df, text, max_size).orderBy("id").select("token").collect()
        return cls(SPECIAL_TOKENS + tuple(r["token"] for r in rows))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        rows = spark.read.parquet(path).orderBy("id").select("token").collect()
        return cls(tuple(r["token"] for r in rows))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(enumerate(self.tokens))
        spark.createDataFrame(rows, "id int, token string").coalesce(1).write.mode("overwrite").parquet(path)

    def encoder(self) -> Callable[[pa.Array], pa.Array]:
        value_set = pa.array(self.tokens, pa.string())

        def lookup(flat: pa.Array) -> pa.Array:
            return pc.fill_null(pc.index_in(flat, value_set=value_set), UNK_ID).cast(pa.int32())

        return lookup

    def id_of(self, word: str) -> int:
        return self.tokens.index(word) if word in self.tokens else UNK_ID

    def with_ids(self, df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
        """The rows with the ids of a column of word lists, or of lists of them."""
        nested = isinstance(df.schema[column].dataType.elementType, ArrayType)
        return df.withColumn(out, (self.nested_ids if nested else self.ids)(F.col(column)))

    def ids(self, word_lists: Column) -> Column:
        """array<string> -> array<int>."""
        lookup = self.encoder()

        @F.arrow_udf("array<int>")
        def encode(batch: pa.Array) -> pa.Array:
            return _relist(batch, lookup(batch.flatten()))

        return encode(word_lists)

    def nested_ids(self, word_lists: Column) -> Column:
        """array<array<string>> -> array<array<int>>."""
        lookup = self.encoder()

        @F.arrow_udf("array<array<int>>")
        def encode(batch: pa.Array) -> pa.Array:
            inner = batch.flatten()
            return _relist(batch, _relist(inner, lookup(inner.flatten())))

        return encode(word_lists)


def dictionary_table(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, id) of every word: ids follow frequency, ties the word itself.

    Words are counted in each task before the shuffle; ids are the ranks of a distributed sort.
    """
    numbered = ranked(word_counts(df, text), F.desc("n"), "token", name="place")
    return numbered.select("token", "n", (F.col("place") + len(SPECIAL_TOKENS)).cast("int").alias("id"))


@dataclass(frozen=True)
class Dictionary:
    """Every word of a corpus, as a stored table (token, n, id).

    ``hot`` are the most frequent words, special tokens first; ``complete`` says that the table has no others.
    """

    table: DataFrame
    hot: tuple[str, ...]
    complete: bool

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", hot_words: int = HOT_WORDS) -> Dictionary:
        """Number the words of a corpus. At most ``hot_words`` of them reach the driver."""
        return cls.of(staged(dictionary_table(df, text), "dictionary"), hot_words)

    @classmethod
    def load(cls, spark: SparkSession, path: str, hot_words: int = HOT_WORDS) -> Dictionary:
        return cls.of(spark.read.parquet(path), hot_words)

    @classmethod
    def of(cls, table: DataFrame, hot_words: int = HOT_WORDS) -> Dictionary:
        last = len(SPECIAL_TOKENS) + hot_words
        found = table.where(F.col("id") < last).orderBy("id").select("token").collect()
        complete = len(found) < hot_words or table.where(F.col("id") >= last).isEmpty()
        return cls(table, SPECIAL_TOKENS + tuple(r["token"] for r in found), complete)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    def id_of(self, word: str) -> int:
        """The id of one word, ``<unk>`` if the corpus had no such word."""
        if word in self.hot:
            return self.hot.index(word)
        found = None if self.complete else self.table.where(F.col("token") == word).select("id").first()
        return found["id"] if found else UNK_ID

    def with_ids(self, df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
        """The rows with the ids of a column of word lists, or of lists of them.

        ``keys`` tell the rows apart (a repeated key is an error where words are joined). Words that are not hot leave
        their rows, one by one, meet the table by word and come back by key; each of them is rarer than every hot word, so
        no word makes a join partition large. Words that the dictionary was not fitted on are ``<unk>``.
        """
        nested = isinstance(df.schema[column].dataType.elementType, ArrayType)
        kind = "array<array<int>>" if nested else "array<int>"
        known = pa.array(self.hot, pa.string())
        default = UNK_ID if self.complete else None

        @F.arrow_udf(kind)
        def look_up(batch: pa.Array) -> pa.Array:
            found = pc.index_in(batch.flatten().flatten() if nested else batch.flatten(), value_set=known)
            return _like(batch, found if default is None else pc.fill_null(found, default), nested)

        looked = df.withColumn(out, look_up(F.col(column)))
        if self.complete:
            return looked
        if df.isStreaming:
            raise ValueError("a stream takes a dictionary of hot words only, or a vocabulary")
        flat_words, flat_ids = (F.flatten(c) if nested else F.col(c) for c in (column, out))
        own = looked.select(*keys, flat_words.alias("_words"), flat_ids.alias("_ids"))
        rare = own.select(*keys, F.posexplode(F.filter("_words", lambda w, i: F.get(F.col("_ids"), i).isNull())).alias("_at", "token"))
        cold = self.table.where(F.col("id") >= len(self.hot)).select("token", F.col("id").alias("_id"))
        met = rare.join(cold, "token", "left").withColumn("_id", F.coalesce("_id", F.lit(UNK_ID)))
        back = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_id"))).alias("_found"))
        back = back.select(*(F.col(k).alias(f"_{k}") for k in keys), F.transform("_found", lambda x: x["_id"]).alias("_found"))

        @F.arrow_udf(kind)
        def fill(ids: pa.Array, found: pa.Array) -> pa.Array:
            flat = ids.flatten().flatten() if nested else ids.flatten()
            gaps = np.asarray(flat.is_null())
            ends = np.asarray(pc.cumulative_sum(pc.fill_null(pc.list_value_length(found), 0)))
            rows = _row_ends(ids, nested)
            if not np.array_equal(np.concatenate(([0], np.cumsum(gaps)))[rows], ends):
                raise ValueError(f"rows repeat a key of {keys}")
            values = np.asarray(pc.fill_null(flat, 0)).astype(np.int32)
            values[gaps] = np.asarray(found.flatten()).astype(np.int32)
            return _like(ids, pa.array(values, pa.int32()), nested)

        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return looked.join(back, same, "left").withColumn(out, fill(F.col(out), F.col("_found"))).select(*df.columns, out)


def _like(batch: pa.Array, flat: pa.Array, nested: bool) -> pa.Array:
    """Flat values in lists as long as those of ``batch``, one or two levels deep."""
    return _relist(batch, _relist(batch.flatten(), flat)) if nested else _relist(batch, flat)


def _row_ends(batch: pa.Array, nested: bool) -> np.ndarray:
    """For each row, the number of flat values up to its end."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch), 0)))
    if nested:
        inner = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.flatten()), 0)))))
        ends = inner[ends]
    return ends


def _relist(like: pa.Array, flat: pa.Array) -> pa.Array:
    """Wrap flat values into lists as long as those of ``like``."""
    lengths = pc.fill_null(pc.list_value_length(like), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(offsets, flat, mask=mask)


def text_encoder(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """Plug-in tokenizer: ``load`` runs once per Python worker and returns a batch encoder.

    The result maps array<string> (texts) to array<array<int>> (ids).
    """
    cache: dict[str, Callable] = {}

    @F.arrow_udf("array<array<int>>")
    def encode(batch: pa.Array) -> pa.Array:
        if "encode" not in cache:
            cache["encode"] = load()
        ids = cache["encode"](batch.flatten().to_pylist())
        return _relist(batch, pa.array(ids, pa.list_(pa.int32())))

    return encode


def tokenizer_file(path: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """Loader for a local ``tokenizers`` JSON file present on every worker."""

    def load() -> Callable[[list[str]], list[list[int]]]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in tok.encode_batch(texts)]

    return load
