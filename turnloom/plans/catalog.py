"""Registered queries: name -> (spark, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import VariantType

from turnloom.config import BatchSpec, Budget, PrepConfig
from turnloom.functions import arrays as A
from turnloom.functions import content as C
from turnloom.functions import text as X
from turnloom.functions.tokens import PAD_ID, Dictionary, dictionary_table
from turnloom.operators import batches as B
from turnloom.operators import candidates as G
from turnloom.operators import divergence as D
from turnloom.operators import evaluate as E
from turnloom.operators import exact as K
from turnloom.operators import folds as S
from turnloom.operators import normalize as N
from turnloom.operators import sampling as R
from turnloom.operators import template as T
from turnloom.operators import windows as W
from turnloom.plans import fixtures as fx
from turnloom.plans.prepare import prepare
from turnloom.sources import files, sinks
from turnloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BUDGET = Budget(320, 256)
SPEC = BatchSpec(max_input=64, max_output=256, pad_id=PAD_ID, batch_size=8)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(ids: Column | str) -> Column:
    """Ids as one blank-separated string."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(c.cast("array<string>"), " ")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r6(c: Column | str) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def wide6(c: Column | str) -> Column:
    """As :func:`r6`, but numbers too large to have six decimals stay as they are."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(x) < 1e9, r6(x)).otherwise(x)


def dictionary(spark: SparkSession, sf: str) -> Dictionary:
    return Dictionary.fit(fx.turns(spark, sf))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Expanded conversations with ids and a sample_id."""
    out = W.expand_turns(fx.turns(spark, sf), BUDGET, vocab=dictionary(spark, sf))
    sample_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return out.withColumn("sample_id", sample_id)


def stored_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples as batching meets them: a written table, not a plan to run again per use."""
    return sinks.staged(samples(spark, sf), "samples")


def each_message(df: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """(keys, i, role, text) of canonical messages."""
    return df.select(*keys, F.posexplode("messages").alias("i", "m")).select(
        *keys, long("i").alias("i"), F.col("m.role").alias("role"), F.col("m.text").alias("text")
    )


# --- sources and sinks ---------------------------------------------------------------

TURN_SCHEMA = "conv_id long, turn long, role string, text string"


@query
def src_files(spark, sf):
    folder = sinks.work_dir(spark, "src")
    fx.turns(spark, sf).write.json(folder)
    parts = [
        files.load_source(spark, "jsonl", folder, TURN_SCHEMA).withColumn("loader", F.lit("jsonl")),
        files.load_source(spark, "parquet", f"{sf}/conversations.parquet").withColumn("loader", F.lit("parquet")),
    ]
    return parts[0].unionByName(parts[1])


@query
def src_split_files(spark, sf):
    folder = sinks.work_dir(spark, "split")
    part = F.when(F.col("conv_id") % 5 == 0, "b").when(F.col("conv_id") % 5 == 1, "c").otherwise("a")
    fx.turns(spark, sf).withColumn("part", part).write.partitionBy("part").parquet(folder)
    return files.load_splits(
        spark, "parquet", f"{folder}/part=a, ,{folder}/part=c,", f" {folder}/part=b"
    ).select("conv_id", "turn", "split")


@query
def src_preset(spark, sf):
    parts = []
    for name, df in (("chosen", fx.chosen(spark, sf)), ("messages", fx.messages(spark, sf))):
        column = files.preset_column(df.columns)
        parts.append(df.select(F.lit(name).alias("fixture"), "conv_id", F.posexplode(column).alias("i", "m")))
    return parts[0].unionByName(parts[1]).select(
        "fixture", "conv_id", long("i").alias("i"), F.col("m.content").alias("text")
    )


@query
def src_turns_to_messages(spark, sf):
    m = files.turns_to_messages(fx.turns(spark, sf))
    texts = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return m.select("conv_id", long(F.size("messages")).alias("n"), F.md5(texts).alias("digest"))


def stored(spark, sf) -> tuple[DataFrame, str]:
    split = B.split_exact(stored_samples(spark, sf), "sample_id", 20)
    path = sinks.work_dir(spark, "store")
    cols = ["sample_id", "split", "input_ids", "labels", "prompt_ids", "response"]
    sinks.write_chunks(split.select(*cols), path, "64KB")
    return spark.read.parquet(path), path


@query
def sink_chunks(spark, sf):
    df, _ = stored(spark, sf)
    return df.groupBy("split").agg(F.count("*").alias("n"), F.sum(long(F.size("input_ids"))).alias("tokens"))


@query
def src_prepared(spark, sf):
    _, path = stored(spark, sf)
    return sinks.read_prepared(spark, path, "test").select(
        "sample_id", joined("input_ids").alias("input_ids"), joined("prompt_ids").alias("prompt_ids"), "response"
    )


# --- layouts -------------------------------------------------------------------------

SYSTEM = PrepConfig(system_column="system")
PAIR = ("conv_id", "turn")


@query
def detect_format(spark, sf):
    builders = (fx.messages, fx.chosen, fx.sharegpt, fx.alpaca, fx.prompt_response)
    parts = []
    for build in builders:
        df = build(spark, sf)
        layout = N.detect_format(df.columns, PrepConfig())
        parts.append(df.groupBy(F.lit(layout).alias("layout")).agg(F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def norm_messages(spark, sf):
    return each_message(N.normalize(fx.messages(spark, sf), PrepConfig(), ["conv_id"]))


@query
def norm_chosen(spark, sf):
    return each_message(N.normalize(fx.chosen(spark, sf), PrepConfig(), ["conv_id"]))


@query
def norm_sharegpt(spark, sf):
    return each_message(N.normalize(fx.sharegpt(spark, sf), PrepConfig(preserve_developer=True), ["conv_id"]))


@query
def norm_alpaca(spark, sf):
    return each_message(N.normalize(fx.alpaca(spark, sf), SYSTEM, list(PAIR)), PAIR)


@query
def norm_prompt_response(spark, sf):
    return each_message(N.normalize(fx.prompt_response(spark, sf), PrepConfig(system_column="sys"), list(PAIR)), PAIR)


@query
def prompt_join(spark, sf):
    text = X.prompt_join(F.col("instruction"), F.col("input"))
    return fx.alpaca(spark, sf).select(*PAIR, text.alias("prompt"))


@query
def system_prepend(spark, sf):
    m = N.normalize(fx.alpaca(spark, sf), SYSTEM, list(PAIR))
    return m.select(
        *PAIR, long(F.size("messages")).alias("n"), F.get("messages", F.lit(0))["role"].alias("first_role")
    )


@query
def role_canon(spark, sf):
    raw = fx.turns(spark, sf).select("conv_id", "turn", F.expr(fx.RAW_ROLE).alias("raw"))
    return raw.select(
        "conv_id", "turn", X.canonical_role(F.col("raw")).alias("role"),
        X.canonical_role(F.col("raw"), preserve_developer=True).alias("role_harmony"),
    )


@query
def last_is_assistant(spark, sf):
    last = F.max_by("role", "turn") == "assistant"
    return fx.turns(spark, sf).groupBy("conv_id").agg(last.alias("ends_with_assistant"))


@query
def drop_source_cols(spark, sf):
    return N.normalize(fx.alpaca(spark, sf), SYSTEM, list(PAIR)).select(
        *PAIR, F.md5(F.array_join(F.transform("messages", lambda m: m["text"]), "|")).alias("digest")
    )


@query
def assistant_free_drop(spark, sf):
    m = N.normalize(fx.messages(spark, sf), PrepConfig(), ["conv_id"]).where(N.has_assistant(F.col("messages")))
    return m.select("conv_id")


# --- content -------------------------------------------------------------------------


def content_of(spark, sf, mode: str, processor: bool = False) -> DataFrame:
    cfg = PrepConfig(multimodal_mode=mode, use_processor=processor)
    text, parts, error = N.content_fields(F.col("content"), VariantType(), cfg)
    return fx.contents(spark, sf).select("conv_id", "turn", text.alias("text"), parts.alias("parts"), error.alias("error"))


def item_rows(spark, sf) -> DataFrame:
    return fx.contents(spark, sf).select(
        "conv_id", "turn", F.posexplode(C.parts_of(F.col("content"))).alias("i", "p")
    )


@query
def part_modality(spark, sf):
    return item_rows(spark, sf).select("conv_id", "turn", long("i").alias("i"), F.col("p.modality").alias("modality"))


@query
def part_placeholder(spark, sf):
    mark = C.placeholder(F.col("p.modality"))
    return item_rows(spark, sf).select("conv_id", "turn", long("i").alias("i"), mark.alias("placeholder"))


@query
def content_placeholder(spark, sf):
    return content_of(spark, sf, "placeholder").select("conv_id", "turn", "text")


@query
def content_text_only(spark, sf):
    return content_of(spark, sf, "text-only").select("conv_id", "turn", "text")


@query
def content_strict(spark, sf):
    return content_of(spark, sf, "strict").select(
        "conv_id", "turn", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), F.col("text")).alias("text")
    )


@query
def content_preserve(spark, sf):
    kept = content_of(spark, sf, "preserve").where(F.col("error").isNull())
    return kept.select("conv_id", "turn", F.posexplode("parts").alias("i", "p")).select(
        "conv_id", "turn", long("i").alias("i"), F.col("p.modality").alias("modality"), F.col("p.text").alias("text")
    )


@query
def content_wrap(spark, sf):
    wrapped = content_of(spark, sf, "preserve", processor=True)
    return wrapped.select(
        "conv_id", "turn", long(F.size("parts")).alias("n_parts"),
        F.get("parts", F.lit(0))["modality"].alias("first_modality"), F.get("parts", F.lit(0))["text"].alias("first_text"),
    )


@query
def content_text_simple(spark, sf):
    c = fx.contents(spark, sf)
    text = F.when(C.kind(F.col("content")) == "list", C.text_simple(C.parts_of(F.col("content")))).when(
        C.kind(F.col("content")) == "string", C.scalar_text(F.col("content"))
    )
    return c.select("conv_id", "turn", text.alias("text"))


@query
def content_typed(spark, sf):
    """Typed lists of parts in all four modes."""
    df = fx.typed_contents(spark, sf)
    rows = None
    for mode in ("placeholder", "text-only", "strict", "preserve"):
        cfg = PrepConfig(multimodal_mode=mode, on_error="quarantine")
        m = F.get("messages", F.lit(0))
        one = N.normalize(df, cfg, ["conv_id", "turn"]).select(
            "conv_id", "turn", F.lit(mode).alias("mode"), F.col("error").isNull().alias("ok"), m["text"].alias("text"),
            F.when(m["parts"].isNotNull(), long(F.size(m["parts"]))).alias("n_parts"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query
def render_response(spark, sf):
    text = C.render_response(F.col("content"), "placeholder", "auto")
    return fx.contents(spark, sf).select("conv_id", "turn", text.alias("text"))


@query
def strip_thinking(spark, sf):
    t = F.col("text")
    return fx.thinking(spark, sf).select(
        "conv_id", "turn", X.apply_thinking(t, "false").alias("off"), F.length(X.apply_thinking(t, "true")).cast("long").alias("n_on")
    )


@query
def media_refs(spark, sf):
    cfg = PrepConfig(multimodal_mode="preserve", on_error="quarantine")
    one = fx.contents(spark, sf).select(
        "conv_id", "turn", F.array(F.struct("role", "content")).alias("messages")
    )
    m = N.normalize(one, cfg, ["conv_id", "turn"])
    return m.select(
        "conv_id", "turn", F.array_join(C.media_refs(F.col("messages"), "image"), "|").alias("images"),
        F.array_join(C.media_refs(F.col("messages"), "video"), "|").alias("videos"),
    )


# --- templates -----------------------------------------------------------------------


def canonical(spark, sf, harmony: bool = False) -> DataFrame:
    return N.normalize(fx.messages(spark, sf), PrepConfig(preserve_developer=harmony), ["conv_id"])


def up_to_last_assistant(messages: Column) -> Column:
    marks = F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i + 1).otherwise(0))
    return F.slice(messages, F.lit(1), F.array_max(marks))


@query
def prefix_split(spark, sf):
    head, body = T.prefix_split(F.col("messages"))
    return canonical(spark, sf).select(
        "conv_id", long(F.size(head)).alias("n_prefix"), long(F.size(body)).alias("n_body"),
        F.get(body, F.lit(0))["role"].alias("first_body_role"),
    )


@query
def prefix_merge(spark, sf):
    m = canonical(spark, sf, harmony=True).select("conv_id", T.merge_prefix(F.col("messages")).alias("messages"))
    return each_message(m)


@query
def render_template(spark, sf):
    cfg = PrepConfig(reasoning_effort="low")
    m = F.col("messages")
    return canonical(spark, sf).select(
        "conv_id", F.md5(T.render(m, T.GENERIC, PrepConfig(), True)).alias("with_prompt"),
        F.md5(T.render(m, T.GENERIC, PrepConfig(), False)).alias("without_prompt"),
        F.md5(T.render(m, T.HARMONY, cfg, True)).alias("low_effort"),
        F.md5(T.render(m, T.GENERIC, PrepConfig(enable_thinking="false"), True)).alias("no_thinking"),
    )


@query
def chat_pair(spark, sf):
    cut = canonical(spark, sf).where(N.has_assistant(F.col("messages"))).select(
        "conv_id", up_to_last_assistant(F.col("messages")).alias("messages")
    )
    prompt, full, answer = T.chat_pair(F.col("messages"), T.GENERIC, PrepConfig())
    return cut.select("conv_id", F.md5(prompt).alias("prompt"), F.md5(full).alias("full"), answer.alias("response"))


@query
def visible_text(spark, sf):
    return fx.transcripts(spark, sf).select("conv_id", "turn", X.visible_text(F.col("raw")).alias("text"))


@query
def clean_generated(spark, sf):
    padded = F.concat(F.lit(" \n\t"), "text", F.lit("\n "))
    return fx.thinking(spark, sf).select("conv_id", "turn", X.clean_generated(padded).alias("text"))


# --- tokens --------------------------------------------------------------------------


@query
def vocab_build(spark, sf):
    return dictionary_table(fx.turns(spark, sf)).select("token", "n", long("id").alias("id"))


@query
def tokenize(spark, sf):
    split = fx.turns(spark, sf).select("conv_id", "turn", X.words(F.col("text")).alias("words"))
    coded = dictionary(spark, sf).with_ids(split, ["conv_id", "turn"], "words", "ids")
    return coded.select("conv_id", "turn", joined("ids").alias("ids"))


@query
def token_len(spark, sf):
    return fx.turns(spark, sf).select("conv_id", "turn", long(F.size(X.words(F.col("text")))).alias("n"))


@query
def labels_copy(spark, sf):
    return samples(spark, sf).select("sample_id", joined("labels").alias("labels"))


@query
def pad_right(spark, sf):
    s = samples(spark, sf)
    return s.select(
        "sample_id", joined(A.pad_right(F.col("input_ids"), 200, PAD_ID)).alias("input_ids"),
        joined(A.pad_right(F.col("labels"), 200, -100)).alias("labels"),
    )


@query
def pad_left(spark, sf):
    return samples(spark, sf).select("sample_id", joined(A.pad_left(F.col("prompt_ids"), 48, PAD_ID)).alias("prompt_ids"))


@query
def attn_mask(spark, sf):
    padded = A.pad_left(F.col("prompt_ids"), 64, PAD_ID)
    return samples(spark, sf).select("sample_id", joined(A.attention_mask(padded, PAD_ID)).alias("mask"))


def generated(spark, sf) -> DataFrame:
    """Left-padded prompts and right-padded responses, the latter cut from the full ids.

    A response holds up to ``max_output`` ids of the answer and the end marker after them.
    """
    s = samples(spark, sf)
    answer = A.cut_generated(F.col("input_ids"), F.size("prompt_ids"))
    return s.select(
        "sample_id", A.pad_left(F.col("prompt_ids"), BUDGET.max_input, PAD_ID).alias("prompt"),
        A.pad_right(answer, BUDGET.max_output + 1, PAD_ID).alias("response"),
    )


@query
def pack_generated(spark, sf):
    packed = A.pack_generated(F.col("prompt"), F.col("response"), 320, PAD_ID)
    types = A.pack_token_types(
        F.col("prompt"), F.transform("prompt", lambda x: (x % 2).cast("int")), F.col("response"), 320, PAD_ID
    )
    return generated(spark, sf).select("sample_id", packed.alias("p"), types.alias("t")).select(
        "sample_id", joined("p.input_ids").alias("input_ids"), joined("p.attention_mask").alias("attention_mask"),
        joined("p.labels").alias("labels"), joined("t").alias("token_types"),
    )


@query
def cut_generated(spark, sf):
    return samples(spark, sf).select(
        "sample_id", joined(A.cut_generated(F.col("input_ids"), F.size("prompt_ids"))).alias("ids")
    )


@query
def count_tokens(spark, sf):
    batch = B.batch_ids(stored_samples(spark, sf), "sample_id", 8, drop_last=False)
    padded = A.pad_right(F.col("input_ids"), 320, PAD_ID)
    return batch.groupBy("batch_id").agg(F.sum(long(A.count_tokens(padded, PAD_ID))).alias("tokens"))


@query
def flatten_lists(spark, sf):
    lists = F.transform("messages", lambda m: X.words(m["content"]))
    flat = F.flatten(lists)
    return files.turns_to_messages(fx.turns(spark, sf)).select(
        "conv_id", long(F.size(flat)).alias("n"), F.md5(F.array_join(flat, " ")).alias("digest")
    )


# --- sample expansion ----------------------------------------------------------------


def windows(spark, sf) -> DataFrame:
    return W.expand_turns(fx.turns(spark, sf), BUDGET).select(
        "conv_id", "turn", "start", "kind", *[long(c).alias(c) for c in ("n_prompt", "n_full", "n_response")]
    )


@query
def flagship(spark, sf):
    return windows(spark, sf)


@query
def assistant_explode(spark, sf):
    return fx.turns(spark, sf).where(F.col("role") == "assistant").select("conv_id", "turn")


def with_costs(spark, sf) -> DataFrame:
    """Turns with word count, cost and totals over the turns before."""
    t = fx.turns(spark, sf).select("conv_id", "turn", "role", F.size(X.words(F.col("text"))).alias("n"))
    is_assistant = F.col("role") == "assistant"
    return S.running(
        t, "conv_id", "turn",
        sums={"before": F.col("n") + T.GENERIC.cost("user"), "answers": is_assistant.cast("int")},
        maxes={"last_answer": F.when(is_assistant, F.col("turn"))},
    )


@query
def start_candidates(spark, sf):
    """Number of legal starts and the nearest one, per assistant turn."""
    body = fx.turns(spark, sf).where(~F.col("role").isin(*X.PREFIX_ROLES)).groupBy("conv_id").agg(F.min("turn").alias("body"))
    rows = with_costs(spark, sf).where(F.col("role") == "assistant").join(body, "conv_id")
    return rows.select(
        "conv_id", "turn", (F.col("answers") + 1).cast("long").alias("n_starts"),
        F.coalesce(F.col("last_answer") + 1, F.col("body")).alias("last_start"),
    )


@query
def fits_budget(spark, sf):
    """Whether the whole history fits, from prefix sums."""
    prompt = F.col("before") + len(T.GENERIC.generation_words)
    full = F.col("before") + F.col("n") + T.GENERIC.cost("assistant")
    fits = (full <= BUDGET.max_length) & (prompt <= BUDGET.max_input) & (F.col("n") <= BUDGET.max_output)
    return with_costs(spark, sf).where(F.col("role") == "assistant").select("conv_id", "turn", fits.alias("fits"))


@query
def candidate_windows(spark, sf):
    """Every start that fits, or the nearest one, with the lengths of its window."""
    return G.candidate_windows(fx.turns(spark, sf), BUDGET)


@query
def window_first_fit(spark, sf):
    return windows(spark, sf).where(F.col("kind") != "trunc").select("conv_id", "turn", "start", "n_prompt")


@query
def truncate_fallback(spark, sf):
    return samples(spark, sf).where(F.col("kind") == "trunc").select(
        "sample_id", joined("prompt_ids").alias("prompt_ids"), joined("input_ids").alias("input_ids")
    )


@query
def drop_long_response(spark, sf):
    n = F.size(X.words(F.col("text")))
    kept = fx.turns(spark, sf).where((F.col("role") == "assistant") & (n <= BUDGET.max_output))
    return kept.select("conv_id", "turn", long(n).alias("n"))


def sample_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "conv_id", "turn", "start", "kind", joined("prompt_ids").alias("prompt_ids"), joined("input_ids").alias("input_ids"),
        joined("labels").alias("labels"), "response",
    )


@query
def expand_samples(spark, sf):
    return sample_rows(samples(spark, sf))


@query
def expand_samples_exact(spark, sf):
    """Rendered and tokenised candidates instead of summed lengths; same rows."""
    nested = canonical(spark, sf)
    return sample_rows(W.expand_exact_words(nested, ["conv_id"], BUDGET, dictionary(spark, sf), min_message_tokens=T.GENERIC.min_cost))


def byte_pairs() -> Callable[[], K.Encode]:
    """The byte-pair tokenizer of the queries, read by every task from its own copy."""
    import public_tokenizers

    return K.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json"))


@query
def expand_samples_tokenized(spark, sf):
    """Samples by the lengths of a byte-pair tokenizer; only windows near the limit are tokenised.

    The markers of a message alone are more than six of its ids, and a line end meets ``<|`` at every join.
    """
    found = K.expand_tokenized(canonical(spark, sf), ["conv_id"], Budget(2048, 512), byte_pairs(), slack=1, min_message_tokens=6)
    return sample_rows(found)


@query
def prepare_corpus(spark, sf):
    """Source rows to split samples in one job, quarantining nothing."""
    cfg = PrepConfig(eval_size=20, budget=BUDGET)
    return prepare(fx.sharegpt(spark, sf), "conv_id", cfg, vocab=dictionary(spark, sf)).select(
        "sample_id", "split", "kind", long("n_prompt").alias("n_prompt"), long("n_full").alias("n_full")
    )


# --- split, batches ------------------------------------------------------------------


@query
def eval_size(spark, sf):
    n = F.col("n")
    return fx.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).select(
        "lang", B.eval_size(n, 2000, 0.02).alias("default"), B.eval_size(n, 50, 0.02).alias("fifty"),
        B.eval_size(n, 0, 0.02).alias("by_ratio"),
    )


@query
def split_exact(spark, sf):
    return B.split_exact(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 123).select("doc_id", "split")


@query
def split_given(spark, sf):
    d, b = fx.table(spark, sf, "documents").select("text"), fx.table(spark, sf, "benchmark").select("text")
    return B.split_given(d, b).groupBy("split").agg(F.count("*").alias("n"), F.sum(long(F.length("text"))).alias("chars"))


@query
def shuffle_batches(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    train = B.batch_ids(d, "doc_id", 48, seed=42).withColumn("loader", F.lit("train"))
    val = B.batch_ids(d, "doc_id", 48, seed=None).withColumn("loader", F.lit("val"))
    return train.unionByName(val).select("loader", "doc_id", "batch_id", long("slot").alias("slot"))


@query
def collate(spark, sf):
    batch = B.collate(B.batch_ids(stored_samples(spark, sf), "sample_id", SPEC.batch_size), SPEC)
    rows = F.arrays_zip(
        F.col("model_inputs.input_ids").alias("a"), F.col("model_inputs.labels").alias("b"),
        F.col("model_inputs.attention_mask").alias("c"), F.col("model_inputs_gen.input_ids").alias("d"),
        F.col("model_inputs_gen.response").alias("e"),
    )
    return batch.select("batch_id", F.posexplode(rows).alias("slot", "r")).select(
        "batch_id", long("slot").alias("slot"), joined("r.a").alias("input_ids"), joined("r.b").alias("labels"),
        joined("r.c").alias("attention_mask"), joined("r.d").alias("prompt_ids"), F.col("r.e").alias("response"),
    )


def with_sides(df: DataFrame) -> DataFrame:
    """Samples with a given mask and token types, and with patches and a grid for some of them."""
    def types(ids: str) -> Column:
        return F.transform(ids, lambda x: (x % 3).cast("int"))

    def mask(ids: str) -> Column:
        return F.transform(ids, lambda x, i: (i % 5 != 4).cast("int"))

    patches = F.transform(F.filter("input_ids", lambda x: x % 7 == 0), lambda x: F.array((x % 5).cast("int"), (x % 2).cast("int")))
    grid = F.when(F.size(patches) > 0, F.array(F.array(F.lit(1), F.size(patches))))
    return df.withColumns({
        "attention_mask": mask("input_ids"), "mm_token_type_ids": types("input_ids"), "prompt_attention_mask": mask("prompt_ids"),
        "prompt_mm_token_type_ids": types("prompt_ids"), "pixel_values": patches, "image_grid_thw": grid,
    })


@query
def collate_sides(spark, sf):
    """Given masks and token types in padding, patches and grids joined over the batch."""
    batch = B.collate(B.batch_ids(with_sides(stored_samples(spark, sf)), "sample_id", SPEC.batch_size), SPEC)

    def lists(c: str) -> Column:
        return F.array_join(F.transform(c, joined), "|")

    m, g = "model_inputs.", "model_inputs_gen."
    return batch.select(
        "batch_id", lists(m + "attention_mask").alias("mask"), lists(m + "mm_token_type_ids").alias("types"),
        lists(g + "attention_mask").alias("prompt_mask"), lists(g + "mm_token_type_ids").alias("prompt_types"),
        lists(m + "pixel_values").alias("pixels"), joined(m + "pixel_values_offsets").alias("pixel_offsets"),
        lists(m + "image_grid_thw").alias("grids"), joined(m + "image_grid_thw_offsets").alias("grid_offsets"),
    )


@query
def limit_batches(spark, sf):
    batches = B.batch_ids(fx.table(spark, sf, "documents").select("doc_id"), "doc_id", 48)
    part = B.limit_batches(batches, 0.25).withColumn("limit", F.lit("quarter"))
    five = B.limit_batches(batches, 5).withColumn("limit", F.lit("five"))
    return part.unionByName(five).groupBy("limit").agg(F.count("*").alias("n"), F.max("batch_id").alias("last_batch"))


@query
def best_step(spark, sf):
    return B.best_step(fx.runlog(spark, sf), "run", "step", "loss")


# --- divergences ---------------------------------------------------------------------


def recorded(spark, sf) -> DataFrame:
    """The logged logits with the label each position is scored against, stored once for all measures."""
    return D.record(fx.logit_log(spark, sf))


def measure(kind: str, params: dict, spark, sf) -> DataFrame:
    rows = recorded(spark, sf) if kind in D.LABELLED else fx.logits(spark, sf)
    out = D.divergence(rows, kind, by=("sample_id",), **params)
    return out.select("sample_id", r6("value").alias("value"))


MEASURES = {
    "lm_loss": ("lm", {}),
    "div_fkl": ("fkl", {}),
    "div_rkl": ("rkl", {}),
    "div_tvd": ("tvd", {}),
    "div_js": ("js", {}),
    "div_skew_fkl": ("sfkl", {}),
    "div_skew_rkl": ("srkl", {}),
    "div_adaptive": ("adaptive_kl", {}),
    "div_adaptive_corrected": ("adaptive_kl", {"corrected": True}),
    "div_temperature": ("ctkd", {}),
    "div_decoupled": ("dkd", {}),
    "logit_standardize": ("dkd", {"standardize": True}),
    "div_interp": ("interp", {"t": 0.4}),
}
for _name, (_kind, _params) in MEASURES.items():
    QUERIES[_name] = partial(measure, _kind, _params)


@query
def div_expressions(spark, sf):
    """All measures once more as array expressions in the JVM."""
    out = D.divergence_all(fx.logits(spark, sf), by=("sample_id",), engine="expression")
    return out.select("sample_id", *[r6(k).alias(k) for k in D.KINDS])


@query
def logit_align(spark, sf):
    return D.align(fx.logits(spark, sf)).select(
        "sample_id", long("pos").alias("pos"), long("next_label").alias("next_label"), long("mask").alias("mask")
    )


@query
def logit_softmax(spark, sf):
    p = F.posexplode("s").alias("i", "p")
    return D.with_distributions(fx.logits(spark, sf)).select("sample_id", long("pos").alias("pos"), p).select(
        "sample_id", "pos", long("i").alias("i"), r6("p").alias("p")
    )


@query
def loss_combine(spark, sf):
    out = D.combine(recorded(spark, sf), "rkl", ratio=0.7, by=("sample_id",))
    return out.select("sample_id", *[r6(c).alias(c) for c in ("lm_loss", "distil_loss", "loss")])


@query
def div_dispatch(spark, sf):
    out = D.divergence_all(recorded(spark, sf), by=("sample_id",))
    return out.select("sample_id", *[r6(k).alias(k) for k in D.KINDS])


# --- run logs and sampling -----------------------------------------------------------


@query
def interp_schedule(spark, sf):
    out = S.interp_schedule(fx.runlog(spark, sf))
    return out.select("run", "step", r6("t").alias("t"), wide6("momentum").alias("momentum"), r6("delta_t").alias("delta_t"))


@query
def cosine_curriculum(spark, sf):
    epoch = F.col("step") - 2
    return fx.runlog(spark, sf).select("run", "step", r6(S.cosine_curriculum(epoch, 1.0, 0.25, 10)).alias("lambda"))


@query
def threshold_update(spark, sf):
    out = S.threshold_update(fx.runlog(spark, sf), "run", "step", "loss")
    return out.select("run", "step", r6("threshold").alias("threshold"))


@query
def threshold_margin(spark, sf):
    """Only a loss that is higher by the margin moves the mark."""
    out = S.threshold_update(fx.runlog(spark, sf), "run", "step", "loss", eps=0.5)
    return out.select("run", "step", r6("threshold").alias("threshold"))


@query
def sample_route(spark, sf):
    parts = []
    for kind in ("constant", "increasing", "decreasing"):
        routed = R.sample_route(fx.runlog(spark, sf), threshold=0.7, ratio=kind, batch_size=8, capacity=100)
        parts.append(routed.select(F.lit(kind).alias("ratio"), "run", "step", long("stored").alias("stored"), "route"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def replay_keep(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 4).alias("shard"))
    whole = R.replay_keep(e, ["ts", "event_id"], 1000).select(F.lit(-1).cast("long").alias("shard"), "event_id")
    return whole.unionByName(R.replay_keep(e, ["ts", "event_id"], 200, "shard").select("shard", "event_id"))


@query
def replay_sample(spark, sf):
    return R.replay_sample(fx.table(spark, sf, "events").select("event_id"), "event_id", 64, seed=7)


@query
def teacher_swap(spark, sf):
    d = fx.table(spark, sf, "documents")
    data = B.batch_ids(d.select("doc_id", "text"), "doc_id", 16, drop_last=False).select(
        F.col("doc_id").alias("sample_id"), "batch_id", F.col("text").alias("response")
    )
    teacher = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"), F.concat(F.lit("teacher "), F.col("quality").cast("string")).alias("response")
    )
    out = R.teacher_swap(data, teacher, 0.5, seed=3)
    return out.select("sample_id", "batch_id", "from_teacher", F.md5("response").alias("digest"))


# --- evaluation ----------------------------------------------------------------------


@query
def norm_answer(spark, sf):
    return fx.predictions(spark, sf).select("conv_id", "turn", X.norm_answer(F.col("pred")).alias("answer"))


@query
def exact_match(spark, sf):
    return fx.predictions(spark, sf).groupBy("eval_set").agg(
        r6(E.exact_match(F.col("pred"), F.col("target"))).alias("exact_match")
    )


@query
def rouge_tokens(spark, sf):
    w = E.rouge_tokens(F.col("target"))
    return fx.predictions(spark, sf).select("conv_id", "turn", F.array_join(w, " ").alias("tokens"))


@query
def rouge_l(spark, sf):
    score = E.rouge_l(F.col("pred"), F.col("target"))
    return fx.predictions(spark, sf).select("conv_id", "turn", r6(score).alias("rouge_l"))


@query
def eval_metrics(spark, sf):
    out = E.eval_metrics(fx.predictions(spark, sf))
    return out.select(r6("exact_match").alias("exact_match"), r6("rougeL").alias("rougeL"))


def set_losses(spark, sf) -> DataFrame:
    return fx.runlog(spark, sf).select((F.col("run") % 2).alias("eval_set"), "loss")


@query
def eval_by_set(spark, sf):
    out = E.eval_by_set(fx.predictions(spark, sf), set_losses(spark, sf))
    return out.select("eval_set", "name", r6("value").alias("value"))


@query
def metric_names(spark, sf):
    last = fx.runlog(spark, sf).select(
        "run", "step",
        F.create_map(F.lit("loss"), F.col("loss"), F.lit("r"), F.when(F.col("r") < 0.5, F.col("r"))).alias("m"),
    )
    named = E.metric_names(F.col("m"), F.lit("train"), "p_")
    return last.select("run", "step", F.explode(named).alias("name", "value")).withColumn("value", r6("value"))


# --- streaming -----------------------------------------------------------------------


def rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)


@query
def stream_expand(spark, sf):
    nested = canonical(spark, sf).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"], m["text"])).alias("messages"))
    folder = sinks.work_dir(spark, "nested")
    nested.write.parquet(folder)
    stream = jobs.read_stream(spark, folder, nested.schema, files=2)
    out = jobs.run_to_table(jobs.expand_stream(stream, ["conv_id"], BUDGET), "expanded")
    return out.select(
        "conv_id", "turn", "start", "kind", *[long(c).alias(c) for c in ("n_prompt", "n_full", "n_response")]
    )


@query
def stream_replay_keep(spark, sf):
    rocksdb(spark)
    schema = fx.table(spark, sf, "events").schema
    stream = jobs.read_stream(spark, sf, schema, glob="events.parquet").select(
        (F.col("user_id") % 4).alias("shard"), F.unix_micros(F.col("ts").cast("timestamp")).alias("step"), F.col("event_id").alias("item")
    )
    emitted = jobs.run_to_table(jobs.replay_stream(stream, 200), "replay")
    return jobs.replay_result(emitted, 200).select("shard", F.col("item").alias("event_id"))


@query
def stream_interp_schedule(spark, sf):
    rocksdb(spark)
    log = fx.runlog(spark, sf).select("run", "step", "total", "loss")
    folder = sinks.work_dir(spark, "runlog")
    log.write.parquet(folder)
    emitted = jobs.run_to_table(jobs.schedule_stream(jobs.read_stream(spark, folder, log.schema)), "schedule")
    return jobs.schedule_result(emitted).select("run", "step", r6("t").alias("t"), wide6("momentum").alias("momentum"), "late")
