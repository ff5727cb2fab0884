"""Sample expansion with a real tokenizer, whose length does not add up over messages.

The result is that of :func:`turnloom.operators.windows.expand_exact`: for each assistant turn the earliest legal start
whose rendered window fits. Instead of every window only those that may fit are tokenised. Every message is counted
alone once; running sums of these counts, less what can be saved at a join, bound each window from below. The bounds
may fall as well as rise along the starts, so the first start within the limit is found by bisecting their running
maximum. From there windows are tokenised whole, one after the other, until one fits: in most cases the first.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from turnloom.config import Budget
from turnloom.operators.template import GENERIC, Template, prefix_length

TURNS_PER_BLOCK = 256
SAMPLES_PER_BATCH = 256

Encode = Callable[[list[str]], list[list[int]]]
SAMPLE = (
    "turn long, start long, kind string, n_prompt int, n_full int, n_response int,"
    " prompt_ids array<int>, input_ids array<int>, response string, labels array<int>"
)


def blocks(df: DataFrame, keys: list[str], context: int, width: int = TURNS_PER_BLOCK) -> DataFrame:
    """Conversations as rows of ``width`` turns with the turns before them that a fitting window can reach.

    Columns: keys, k (length of the head), head, body, first (place in ``body`` of the block's own first turn), offset
    (turns of the conversation's body before ``body``), legal (whether ``body`` may start a window). Where no legal
    start lies in the context, ``body`` reaches back to the last one, because a sample that fits nowhere is cut from it.
    """
    messages = F.transform(
        "messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("text"))
    )
    rows = df.select(*keys, messages.alias("ms")).withColumn("k", prefix_length(F.col("ms")))
    rows = rows.select(
        *keys, "k", F.slice("ms", F.lit(1), F.col("k")).alias("head"), F.slice("ms", F.col("k") + 1, F.size("ms") - F.col("k")).alias("rest")
    ).where(F.size("rest") > 0)
    # Places are 1-based here; a start is legal at the first turn and after each assistant turn.
    cut = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("rest"), F.lit(width))).alias("own")).withColumn(
        "near", F.greatest(F.lit(1), F.col("own") - context)
    )

    def last_start(begin, end):
        part = F.slice("rest", begin, end - begin)
        return F.array_max(F.transform(part, lambda m, i: F.when(m["role"] == "assistant", begin + i + 1)))

    inside = last_start(F.col("near"), F.col("own"))
    far = F.coalesce(last_start(F.lit(1), F.col("own")), F.lit(1))
    cut = cut.withColumn("reach", (F.col("near") > 1) & inside.isNull()).withColumn(
        "begin", F.when(F.col("reach"), far).otherwise(F.col("near"))
    )
    return cut.select(
        *keys, "k", "head",
        F.slice("rest", F.col("begin"), F.col("own") + width - F.col("begin")).alias("body"),
        (F.col("own") - F.col("begin")).alias("first"),
        (F.col("begin") - 1).alias("offset"),
        (F.col("reach") | (F.col("begin") == 1)).alias("legal"),
        F.col("own").alias("block"),
    )


def block_samples(
    row: dict, budget: Budget, template: Template, slack: int, encode: Encode
) -> Iterator[tuple[int, int | None, str, list[int], list[int], list[int], str]]:
    """(place of the target, of the start, kind, prompt, full, answer ids, answer) of one block, in order."""
    body, first = row["body"], row["first"]

    def rendered(m: dict) -> str:
        return template.prefix[m["role"]] + m["text"] + template.suffix[m["role"]]

    pieces = [rendered(m) for m in body]
    head = "".join(rendered(m) for m in row["head"])
    *counts, in_head, in_generation = (len(x) - slack for x in encode([*pieces, head, template.generation]))
    least = [0, *accumulate(counts)]
    starts = ([0] if row["legal"] else []) + [i + 1 for i, m in enumerate(body[:-1]) if m["role"] == "assistant"]
    highest = list(accumulate((least[s] for s in starts), max))
    targets = [i for i in range(first, len(body)) if body[i]["role"] == "assistant"]
    for i, answer in zip(targets, encode([body[i]["text"] for i in targets])):
        if len(answer) > budget.max_output:
            continue
        # The lower bound of a window from s is within both limits exactly where least[s] reaches this.
        needed = in_head + max(least[i + 1] - budget.max_length, least[i] + in_generation - budget.max_input)
        legal = bisect_right(starts, i)
        chosen, prompt, full, tried = None, [], [], None
        for s in starts[bisect_left(highest, needed) : legal]:
            if least[s] < needed:
                continue
            before = head + "".join(pieces[s:i])
            prompt, full = encode([before + template.generation, before + pieces[i]])
            tried = s
            if len(full) <= budget.max_length and len(prompt) <= budget.max_input:
                chosen = s
                break
        if chosen is not None:
            place = row["offset"] + chosen
            yield i, place, "full" if place == 0 else "window", prompt, full, answer, body[i]["text"]
            continue
        if tried != starts[legal - 1]:
            before = head + "".join(pieces[starts[legal - 1] : i])
            prompt, full = encode([before + template.generation, before + pieces[i]])
        cut = prompt[-budget.max_input :]
        ends = bool(answer) and full[-len(answer) :] == answer
        size = len(cut) + len(answer)
        yield i, None, "trunc", cut, cut + answer if ends else full[len(full) - min(size, len(full)) :], answer, body[i]["text"]


def expand_tokenized(
    df: DataFrame,
    keys: list[str],
    budget: Budget,
    load: Callable[[], Encode],
    template: Template = GENERIC,
    slack: int = 1,
    min_message_tokens: int = 1,
    width: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """Samples of nested conversations (keys, messages) for any tokenizer; columns as ``expand_exact`` gives them.

    ``load`` is called once in a task and gives a function from texts to lists of ids. ``slack`` is the most ids that a
    join of two rendered messages (or of the generation prompt) can save against both counted alone; a larger value
    gives the same rows with more windows tried. ``min_message_tokens`` is the fewest ids that one more message adds to a
    window: it bounds the turns that a block looks back. Both must hold for the tokenizer, or samples lose history.

    Conversations are cut into blocks of ``width`` turns that are spread over tasks by (keys, block), so that one
    conversation with a large share of all turns is worked on in parallel. A null text is empty, a conversation
    without assistant turn gives no row, an unknown role is an error. Repeated keys are separate conversations.
    Families with a merged prefix and removal of think spans stay with ``expand_exact``.
    """
    if template.harmony:
        raise ValueError("a merged prefix needs expand_exact")
    if slack < 0 or min_message_tokens < 1 or width < 1:
        raise ValueError("slack must not be negative, min_message_tokens and width must be positive")
    cut = blocks(df, keys, budget.max_length // min_message_tokens + 1, width)
    schema = StructType([df.schema[k] for k in keys] + StructType.fromDDL(SAMPLE).fields)
    names = schema.names
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()

        def table(columns: list[pa.Array], out: list[tuple]) -> pa.RecordBatch:
            repeated = [c.take(pa.array([0] * len(out))) for c in columns]
            return pa.record_batch(repeated + [pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row, columns, out = one.select(["k", "head", "body", "first", "offset", "legal"]).to_pylist()[0], one.columns[: len(keys)], []
                base = row["k"] + row["offset"]
                for i, start, kind, prompt, full, answer, text in block_samples(row, budget, template, slack, encode):
                    place = None if start is None else row["k"] + start
                    out.append((base + i, place, kind, len(prompt), len(full), len(answer), prompt, full, text, full))
                    if len(out) == SAMPLES_PER_BATCH:
                        yield table(columns, out)
                        out = []
                if out:
                    yield table(columns, out)

    return cut.repartition(*keys, "block").drop("block").mapInArrow(run, schema)


def tokenizer_file(path: str) -> Callable[[], Encode]:
    """Loader of a ``tokenizers`` JSON file that every task can read; special strings in texts are ordinary text."""

    def load() -> Encode:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    return load
