"""Inputs of the registered queries, all derived from the given tables by Spark."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnloom.operators.batches import unit_hash
from turnloom.operators.folds import running
from turnloom.sources.files import turns_to_messages
from turnloom.sources.sinks import staged

# CASE texts that both engines understand.
RAW_ROLE = """CASE role
  WHEN 'user' THEN CASE (conv_id + turn) % 3 WHEN 0 THEN 'user' WHEN 1 THEN ' Human ' ELSE 'USER' END
  WHEN 'assistant' THEN CASE (conv_id + turn) % 4 WHEN 0 THEN 'assistant' WHEN 1 THEN 'bot' WHEN 2 THEN 'GPT ' ELSE 'Model' END
  ELSE CASE conv_id % 2 WHEN 0 THEN 'System' ELSE 'developer' END END"""
RUN_HOUR = 3_600_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, messages) with raw role spellings."""
    return turns_to_messages(turns(spark, sf).withColumn("role", F.expr(RAW_ROLE)))


def sharegpt(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select(
        "conv_id",
        F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations"),
    )


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    """Preferred side = the conversation, rejected side = the one with the next id."""
    m = messages(spark, sf)
    other = m.select((F.col("conv_id") - 1).alias("conv_id"), F.col("messages").alias("rejected"))
    return m.join(other, "conv_id", "left").withColumnRenamed("messages", "chosen")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant turn with the text before it and, where that opens the conversation's body, the system text.

    The joins are on (conv_id, turn), which is unique: a very long conversation spreads like many short ones.
    """
    t = turns(spark, sf)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("user_text"))
    system = t.where(F.col("role") == "system").select(
        "conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("system_text")
    )
    answers = t.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer_text"))
    return answers.join(before, ["conv_id", "turn"], "left").join(system, ["conv_id", "turn"], "left")


def alpaca(spark: SparkSession, sf: str) -> DataFrame:
    first_line = F.split_part("user_text", F.lit("\n"), F.lit(1))
    return pairs(spark, sf).select(
        "conv_id", "turn",
        first_line.alias("instruction"),
        F.substring("user_text", F.length(first_line) + 2, F.length("user_text")).alias("input"),
        F.col("answer_text").alias("output"),
        F.col("system_text").alias("system"),
    )


def prompt_response(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select(
        "conv_id", "turn", F.col("user_text").alias("question"), F.col("answer_text").alias("answer"), F.col("system_text").alias("sys")
    )


def _json(text) -> F.Column:
    """JSON string literal of a text column."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, role, text, k, content VARIANT): every content shape, chosen by k."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    n = pages.select(F.count("*").alias("n")).scalar()
    base = (
        turns(spark, sf)
        .withColumn("page_id", F.col("conv_id") % n)
        .join(pages, "page_id")
        .withColumn("k", (F.col("conv_id") + F.col("turn")) % 11)
    )
    t, u = _json(F.col("text")), _json(F.col("url"))
    shapes = {
        0: [t],
        1: ["null"],
        2: [F.col("turn").cast("string")],
        3: ["[", t, ', " tail"]'],
        4: ['[{"type":"text","text":', t, '},{"type":"image_url","image_url":{"url":', u, "}}]"],
        5: ['[{"text":', t, '},{"image":', u, '},"x"]'],
        6: ['[{"type":" Video.MP4 ","video":', u, '},{"type":"text","text":', t, "}]"],
        7: ['[{"file":', u, '},{"audio_url":', u, '},{"type":"","image":"","image_url":', u, "}]"],
        8: ['"[\\"hi\\"]"'],
        9: ["[]"],
        10: ['[{"foo":1},{"type":"text","text":', t, "}]"],
    }
    json = F
    for k, pieces in shapes.items():
        json = json.when(F.col("k") == k, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]))
    return base.select("conv_id", "turn", "role", "text", "k", F.parse_json(json).alias("content"))


def typed_contents(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, messages) with content as a typed list: a text part, a text and an image part, or nothing."""
    part = "struct<type:string,text:string,image:string>"
    text = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("image"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("picture").alias("image"))
    k = (F.col("conv_id") + F.col("turn")) % 3
    content = F.when(k == 0, F.array(text)).when(k == 1, F.array(text, image)).otherwise(F.array().cast(f"array<{part}>"))
    return turns(spark, sf).select("conv_id", "turn", F.array(F.struct("role", content.alias("content"))).alias("messages"))


def thinking(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant texts led by a think span made of the previous turn."""
    t = turns(spark, sf)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("thought"))
    span = F.concat(F.lit("<think>\n"), "thought", F.lit("\n</think>\n\n"), "text")
    return t.join(before, ["conv_id", "turn"], "left").withColumn(
        "text", F.when((F.col("role") == "assistant") & F.col("thought").isNotNull(), span).otherwise(F.col("text"))
    ).drop("thought")


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Channel-marked transcripts from two neighbouring turns, in four shapes."""
    t = turns(spark, sf)
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    b = t.join(after, ["conv_id", "turn"])
    m = F.lit("<|message|>")
    analysis = F.concat(F.lit("<|start|>assistant<|channel|>analysis"), m, "other", F.lit("<|end|>"))
    final = F.concat(F.lit("<|start|>assistant<|channel|> final "), m, F.lit(" "), "text", F.lit("<|return|>"))
    bare = F.concat(F.lit("<|start|>assistant"), m, "text")
    raw = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(analysis, final))
        .when(F.col("conv_id") % 4 == 1, F.concat(analysis, bare))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("assistantanalysisfinal<|end|>"), "text"))
        .otherwise(F.concat(final, analysis, final))
    )
    return b.select("conv_id", "turn", raw.alias("raw"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    n = e.select(F.count("*").alias("n")).scalar()
    z = F.transform("embedding", lambda x: x.cast("double") * 10)
    student = e.select("vec_id", z.alias("student"), "label", ((F.col("vec_id") + 1) % n).alias("next_id"))
    teacher = e.select(F.col("vec_id").alias("next_id"), z.alias("teacher"))
    pos = (F.col("vec_id") % 16).cast("int")
    return student.join(teacher, "next_id").select(
        F.floor(F.col("vec_id") / 16).alias("sample_id"), pos.alias("pos"), "student", "teacher",
        F.when(pos < 4, -100).otherwise(F.col("label")).alias("label"),
    )


def logit_log(spark: SparkSession, sf: str) -> DataFrame:
    """The logits as a run logs them: written sample by sample, position by position."""
    return staged(logits(spark, sf).orderBy("sample_id", "pos"), "logit-log")


def runlog(spark: SparkSession, sf: str) -> DataFrame:
    """(run, step, total, loss, r): per user the events in time order."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value").alias("loss"), unit_hash(0, F.col("event_id")).alias("r"), "event_id",
    )
    steps = running(e, "run", "us", sums={"step": F.lit(1)}, width=RUN_HOUR)
    totals = e.groupBy("run").agg(F.count("*").alias("total"))
    return steps.join(totals, "run").select("run", F.col("step").cast("long").alias("step"), "total", "loss", "r", "event_id")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(eval_set, conv_id, turn, pred, target): the turn before as prediction, or the target respelled."""
    t = turns(spark, sf)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    same = (F.col("conv_id") + F.col("turn")) % 3 == 0
    respelled = F.concat(F.translate("text", ascii_lowercase, ascii_uppercase), F.lit(" ..!"))
    return (
        t.where(F.col("role") == "assistant")
        .join(before, ["conv_id", "turn"], "left")
        .select(
            (F.col("conv_id") % 2).alias("eval_set"), "conv_id", "turn",
            F.when(same, respelled).otherwise(F.coalesce("previous", F.lit(""))).alias("pred"),
            F.col("text").alias("target"),
        )
    )
