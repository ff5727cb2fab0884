"""Sample expansion: one sample per assistant turn with the largest history that fits.

All paths meet in :func:`expand_blocks`, which works on rows of bounded length:

* a nested conversation row is cut into blocks in place, without a shuffle;
* a turn table is grouped by (conversation, block of turns), one shuffle for everything,
  so that even a conversation holding a large share of the table is spread over many rows.

A fitting window holds at most ``max_input`` tokens and every message costs at least the
template's markers, so a block needs only a fixed number of earlier messages as context.
Nothing is cut off by that: what lies further back cannot be part of a sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from turnloom.config import Budget, PrepConfig
from turnloom.functions import arrays as A
from turnloom.functions.text import PREFIX_ROLES, words
from turnloom.functions.tokens import Dictionary, Vocabulary
from turnloom.operators.template import GENERIC, ROLES, Template, chat_pair, prefix_length

DEFAULT_WIDTH = 2048
HEAD_SALTS = 32


def context_length(budget: Budget, template: Template) -> int:
    """Messages before a target that can matter; one more than the longest fitting window."""
    if template.min_cost < 1:
        raise ValueError("blocks need a template that costs at least one token per message")
    return budget.max_input // template.min_cost + 1


def _int_map(values: dict[str, int], key: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def _id_map(template_side: dict[str, str], template: Template, vocab: Vocabulary | Dictionary, key: Column) -> Column:
    pairs = []
    for role in ROLES:
        pairs += [F.lit(role), _id_array([vocab.id_of(w) for w in template.marker_words(template_side, role)])]
    return F.element_at(F.create_map(*pairs), key)


def _id_array(ids: list[int]) -> Column:
    return F.array(*map(F.lit, ids)).cast("array<int>")


def _entry(
    turn: Column, role: Column, text: Column, n: Column, ids: Column | None, template: Template, vocab, budget: Budget
) -> Column:
    """What the expansion needs to know about one message, bounded by the budget.

    A sample never looks further back than ``max_length`` ids, so a longer message keeps only
    its last ids (its full length stays in ``n``); a response over ``max_output`` gives no
    sample and needs no text.
    """
    cost = _int_map({r: template.cost(r) for r in ROLES}, role)
    fields = [
        turn.cast("long").alias("turn"),
        role.alias("role"),
        n.cast("int").alias("n"),
        (n + cost).cast("int").alias("cost"),
        (text != "").alias("some"),
    ]
    if ids is not None:
        marked = F.concat(
            _id_map(template.prefix, template, vocab, role), ids, _id_map(template.suffix, template, vocab, role)
        )
        if not template.harmony:
            marked = A.tail(marked, budget.max_length + max(template.cost(r) for r in ROLES))
        wanted = (role == "assistant") & (n <= budget.max_output)
        fields += [marked.alias("ids"), F.when(wanted, text).alias("response")]
    return F.struct(*fields)


def encode_turns(turns: DataFrame, key: str, template: Template, vocab: Vocabulary | Dictionary | None, budget: Budget) -> DataFrame:
    """(key, turn, role, entry) of a turn table with ``turn``, ``role``, ``text``."""
    text = F.coalesce("text", F.lit(""))
    split = turns.select(key, "turn", "role", text.alias("text"), words(text).alias("words"))
    if vocab is not None:
        split = vocab.with_ids(split, [key, "turn"], "words", "ids")
    entry = _entry(
        F.col("turn"), F.col("role"), F.col("text"), F.size("words"),
        F.col("ids") if vocab is not None else None, template, vocab, budget,
    )
    return split.select(key, F.col("turn").cast("long").alias("turn"), "role", entry.alias("entry"))


def late_prefix(messages: Column) -> Column:
    """Is a system/developer message the first one of some shortened window?

    The harmony family merges it into the window's leading message, so the lengths of such
    a conversation do not add up message by message.
    """
    return F.exists(
        F.transform(
            messages,
            lambda m, i: m["role"].isin(*PREFIX_ROLES) & F.coalesce(F.get(messages, i - 1)["role"] == "assistant", F.lit(False)),
        ),
        lambda x: x,
    )


def _checked(entries: Column, first_turn: Column, key: str, template: Template) -> Column:
    """Positions must be contiguous; a gap or a repeat would silently change windows."""
    gap = F.exists(
        F.transform(entries, lambda e, i: e["turn"] != first_turn + i), lambda bad: bad
    )
    message = F.concat(F.lit("turn positions are not 0,1,2,... in conversation "), F.col(key).cast("string"))
    checked = F.when(gap, F.raise_error(message))
    if template.harmony:
        nest = F.lit("a system message opens a later window: nest the turns and use expand_nested for this family")
        checked = checked.when(late_prefix(entries), F.raise_error(nest))
    return checked.otherwise(entries)


def turn_blocks(
    turns: DataFrame,
    key: str,
    budget: Budget,
    template: Template = GENERIC,
    vocab: Vocabulary | Dictionary | None = None,
    width: int = DEFAULT_WIDTH,
    long: bool | None = None,
) -> DataFrame:
    """Turn table -> block rows (key, head, body, first, at_start).

    ``long`` says whether any conversation is longer than ``width``; when not given, the
    largest turn number is looked up first (footer statistics or a one-column scan).
    """
    context = context_length(budget, template)
    width = max(width, context)
    if long is None:
        top = turns.agg(F.max("turn").alias("t")).first()["t"]
        long = top is not None and top >= width
    short = encode_turns(turns.where(F.col("turn") < width) if long else turns, key, template, vocab, budget)
    start = (
        short.groupBy(key)
        .agg(F.array_sort(F.collect_list("entry")).alias("ms"))
        .select(key, _checked(F.col("ms"), F.lit(0), key, template).alias("ms"))
        .withColumn("k", prefix_length(F.col("ms")))
        .select(
            key,
            F.slice("ms", F.lit(1), F.col("k")).alias("head"),
            F.slice("ms", F.col("k") + 1, F.size("ms") - F.col("k")).alias("body"),
            F.lit(0).alias("first"),
            F.lit(True).alias("at_start"),
        )
    )
    if not long:
        return start

    # Blocks after the first: own turns plus the last `context` turns of the block before.
    block = F.floor(F.col("turn") / width).cast("long")
    is_context = F.col("turn") % width >= width - context
    rows = encode_turns(turns.where(F.col("turn") >= width - context), key, template, vocab, budget)
    later = (
        rows.select(
            key,
            "entry",
            F.explode(
                F.filter(F.array(block, F.when(is_context, block + 1)), lambda b: b.isNotNull() & (b > 0))
            ).alias("block"),
        )
        .groupBy(key, "block")
        .agg(F.array_sort(F.collect_list("entry")).alias("ms"))
        .where(F.size("ms") > context)
        .withColumn("base", F.col("block") * width - context)
        .withColumn("ms", _checked(F.col("ms"), F.col("base"), key, template))
        .withColumn("salt", (F.col("block") % HEAD_SALTS).cast("int"))
    )
    # Their leading system run, bounded by one block and copied to a few salts so that the
    # blocks of one long conversation do not all meet in one join partition.
    long_keys = turns.where(F.col("turn") >= width).select(key).distinct()
    run = (
        encode_turns(
            turns.where((F.col("turn") < width) & F.col("role").isin(*PREFIX_ROLES)), key, template, vocab, budget
        )
        .join(long_keys, key, "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("entry")).alias("run"))
        .withColumn("run", F.filter("run", lambda e, i: e["turn"] == i))
        .withColumn(
            "run",
            F.when(
                F.size("run") >= width,
                F.raise_error(F.lit("a leading system run is longer than one block; raise width")),
            ).otherwise(F.col("run")),
        )
        .select(key, "run", F.explode(F.sequence(F.lit(0), F.lit(HEAD_SALTS - 1))).alias("salt"))
    )
    prefix_end = F.coalesce(F.size("run"), F.lit(0))
    later = later.join(run, [key, "salt"], "left").select(
        key,
        F.coalesce("run", F.slice("ms", 1, 0)).alias("head"),
        F.filter("ms", lambda e: e["turn"] >= prefix_end).alias("body"),
        (F.col("block") * width - F.greatest(F.col("base"), prefix_end.cast("long"))).cast("int").alias("first"),
        (F.col("base") <= prefix_end).alias("at_start"),
    )
    return start.unionByName(later)


def nested_blocks(
    df: DataFrame,
    keys: list[str],
    budget: Budget,
    template: Template = GENERIC,
    vocab: Vocabulary | Dictionary | None = None,
    width: int = DEFAULT_WIDTH,
    messages: str = "messages",
) -> DataFrame:
    """Nested conversations -> block rows, without a shuffle (also usable on a stream)."""
    rows = df.select(
        *keys,
        F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("text"))).alias("m"),
    ).withColumn("w", F.transform("m", lambda m: words(m["text"])))
    if vocab is not None:
        rows = vocab.with_ids(rows, keys, "w", "ids")
    entries = F.transform(
        "m",
        lambda m, i: _entry(
            i, m["role"], m["text"], F.size(F.get(F.col("w"), i)),
            F.get(F.col("ids"), i) if vocab is not None else None, template, vocab, budget,
        ),
    )
    rows = (
        rows.select(*keys, entries.alias("ms"))
        .withColumn("k", prefix_length(F.col("ms")))
        .select(
            *keys,
            F.slice("ms", F.lit(1), F.col("k")).alias("head"),
            F.slice("ms", F.col("k") + 1, F.size("ms") - F.col("k")).alias("rest"),
        )
    )
    if template.min_cost < 1:
        return rows.select(*keys, "head", F.col("rest").alias("body"), F.lit(0).alias("first"), F.lit(True).alias("at_start"))
    context = context_length(budget, template)
    width = max(width, context)
    last = F.greatest(F.ceil(F.size("rest") / width) - 1, F.lit(0)).cast("int")
    before = F.least(F.lit(context), F.col("b") * width)
    return rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("b")).select(
        *keys,
        "head",
        F.slice("rest", F.col("b") * width - before + 1, before + width).alias("body"),
        before.alias("first"),
        (F.col("b") == 0).alias("at_start"),
    )


def _scan_back(i: Column, back: Column, room: Column, at_start: Column, reached: Column) -> Column:
    """Walk from the message before target ``i`` towards the start of the body.

    A start is legal at the body's first message and after every assistant turn. Token sums
    only grow on the way, so the last legal start seen within ``room`` is the first fit.
    ``last`` is the nearest legal start, used when nothing fits.
    """
    none = F.lit(None).cast("int")

    def state(ix, tokens, best, best_sum, last, last_sum) -> Column:
        return F.struct(
            ix.cast("int").alias("ix"), tokens.cast("int").alias("sum"),
            best.cast("int").alias("best"), best_sum.cast("int").alias("best_sum"),
            last.cast("int").alias("last"), last_sum.cast("int").alias("last_sum"),
        )

    def step(s: Column, e: Column) -> Column:
        legal = e["role"] == "assistant"
        fits = legal & (s["sum"] <= room)
        near = legal & s["last"].isNull()
        return state(
            s["ix"] - 1,
            s["sum"] + e["cost"],
            F.when(fits, s["ix"] + 1).otherwise(s["best"]),
            F.when(fits, s["sum"]).otherwise(s["best_sum"]),
            F.when(near, s["ix"] + 1).otherwise(s["last"]),
            F.when(near, s["sum"]).otherwise(s["last_sum"]),
        )

    def finish(s: Column) -> Column:
        begin = at_start & reached
        fits = begin & (s["sum"] <= room)
        near = begin & s["last"].isNull()
        return state(
            s["ix"], s["sum"],
            F.when(fits, F.lit(1)).otherwise(s["best"]),
            F.when(fits, s["sum"]).otherwise(s["best_sum"]),
            F.when(near, F.lit(1)).otherwise(s["last"]),
            F.coalesce(s["last_sum"], s["sum"]),
        )

    return F.aggregate(back, state(i - 1, F.lit(0), none, none, none, none), step, finish)


def lead_words(template: Template, cfg: PrepConfig) -> list[str]:
    if not (template.harmony and cfg.reasoning_effort != "auto"):
        return []
    return (
        template.marker_words(template.prefix, "system")
        + ["Reasoning:", cfg.reasoning_effort]
        + template.marker_words(template.suffix, "system")
    )


def expand_blocks(
    blocks: DataFrame,
    keys: list[str],
    budget: Budget,
    template: Template = GENERIC,
    vocab: Vocabulary | Dictionary | None = None,
    cfg: PrepConfig = PrepConfig(),
) -> DataFrame:
    """Block rows -> samples.

    Columns: keys, turn, start, kind, n_prompt, n_full, n_response and, with a vocabulary,
    input_ids, labels, prompt_ids, response. ``kind`` is ``full`` (whole history),
    ``window`` (shortened history) or ``trunc`` (smallest window, prompt cut from the left;
    ``start`` is null then). A response longer than ``max_output`` gives no sample.
    """
    lead = lead_words(template, cfg)
    gen = template.generation_words
    body = F.col("body")
    head_cost = F.aggregate("head", F.lit(0), lambda acc, e: acc + (e["n"] if template.harmony else e["cost"]))
    if template.harmony:
        head_cost = F.when(F.exists("head", lambda e: e["some"]), head_cost + template.cost("developer")).otherwise(0)
    df = blocks.withColumn("head_cost", (head_cost + len(lead)).cast("int"))
    if vocab is not None:
        df = df.withColumn("head_ids", _head_ids(template, vocab, lead))

    reach = context_length(budget, template) if template.min_cost >= 1 else None

    def span(i: Column) -> Column:
        return i - 1 if reach is None else F.least(F.lit(reach), i - 1)

    positions = F.when(
        F.size("body") > F.col("first"), F.sequence(F.col("first") + 1, F.size("body"))
    ).otherwise(F.array().cast("array<int>"))
    targets = F.filter(
        positions,
        lambda i: (F.get(body, i - 1)["role"] == "assistant") & (F.get(body, i - 1)["n"] <= budget.max_output),
    )

    def room(i: Column) -> Column:
        left = F.least(
            F.lit(budget.max_input) - F.col("head_cost") - len(gen),
            F.lit(budget.max_length) - F.col("head_cost") - F.get(body, i - 1)["cost"],
        )
        return F.struct(i.alias("i"), span(i).alias("span"), left.alias("room"))

    def scan(t: Column) -> Column:
        back = F.reverse(F.slice(body, t["i"] - t["span"], t["span"]))
        walked = _scan_back(t["i"], back, t["room"], F.col("at_start"), t["span"] == t["i"] - 1)
        return F.struct(t["i"].alias("i"), t["span"].alias("span"), walked.alias("s"))

    def sample(p: Column) -> Column:
        i, s = p["i"], p["s"]
        target = F.get(body, i - 1)
        fields = [
            target["turn"].alias("turn"),
            F.get(body, s["best"] - 1)["turn"].alias("start"),
            (s["best"] == 1).alias("from_first"),
            F.coalesce(s["best_sum"], s["last_sum"]).alias("history_cost"),
            target["cost"].alias("cost"),
            target["n"].alias("n_response"),
        ]
        if vocab is not None:
            begin = F.coalesce(s["best"], s["last"], i - p["span"])
            history = F.flatten(F.transform(F.slice(body, begin, i - begin), lambda e: e["ids"]))
            fields += [history.alias("history"), target["ids"].alias("target_ids"), target["response"].alias("response")]
        return F.struct(*fields)

    staged = F.transform(F.transform(F.transform(targets, room), scan), sample)
    carried = ["head_cost", "at_start"] + (["head_ids"] if vocab is not None else [])
    # The outer form, because Spark would otherwise evaluate the array twice: once to filter
    # out rows without samples, once to produce them.
    rows = df.select(*keys, *carried, F.inline_outer(staged)).where(F.col("turn").isNotNull())

    fits = F.col("start").isNotNull()
    whole_prompt = F.col("head_cost") + F.col("history_cost") + len(gen)
    n_prompt = F.when(fits, whole_prompt).otherwise(F.least(F.lit(budget.max_input), whole_prompt))
    whole = F.col("head_cost") + F.col("history_cost") + F.col("cost")
    kind = F.when(~fits, "trunc").when(F.col("at_start") & F.col("from_first"), "full").otherwise("window")
    counts = [
        n_prompt.cast("int").alias("n_prompt"),
        F.when(fits, whole).otherwise(F.least(whole, n_prompt + F.col("n_response"))).cast("int").alias("n_full"),
    ]
    base = [*keys, "turn", "start", kind.alias("kind"), *counts, "n_response"]
    if vocab is None:
        return rows.select(*base)
    skip = len(template.marker_words(template.prefix, "assistant"))
    joined = rows.select(
        *base,
        "response",
        F.concat("head_ids", "history", _id_array([vocab.id_of(w) for w in gen])).alias("prompt"),
        F.concat("head_ids", "history", "target_ids").alias("full"),
        F.slice("target_ids", F.lit(skip + 1), F.col("n_response")).alias("answer"),
    )
    cut = A.tail(F.col("prompt"), budget.max_input)
    return joined.select(
        *keys, "turn", "start", "kind", "n_prompt", "n_full", "n_response", "response",
        F.when(fits, F.col("prompt")).otherwise(cut).alias("prompt_ids"),
        F.when(fits, F.col("full")).otherwise(truncated_full(F.col("full"), cut, F.col("answer"))).alias("input_ids"),
    ).withColumn("labels", F.col("input_ids"))


def truncated_full(full: Column, prompt_cut: Column, answer: Column) -> Column:
    """Full ids after a prompt cut.

    Prompt plus response when the full sequence ends with the response, else as many ids
    from its end as prompt and response have together.
    """
    n = F.size(answer)
    ends = (n > 0) & (A.tail(full, n) == answer)
    return F.when(ends, F.concat(prompt_cut, answer)).otherwise(A.tail(full, F.size(prompt_cut) + n))


def _head_ids(template: Template, vocab: Vocabulary | Dictionary, lead: list[str]) -> Column:
    lead_ids = _id_array([vocab.id_of(w) for w in lead])
    if not template.harmony:
        return F.concat(lead_ids, F.flatten(F.transform("head", lambda e: e["ids"])))
    own = F.flatten(
        F.transform(
            "head",
            lambda e: F.slice(
                e["ids"], _int_map({r: len(template.marker_words(template.prefix, r)) for r in ROLES}, e["role"]) + 1, e["n"]
            ),
        )
    )
    mark = [
        _id_array([vocab.id_of(w) for w in template.marker_words(side, "developer")])
        for side in (template.prefix, template.suffix)
    ]
    merged = F.concat(lead_ids, mark[0], own, mark[1])
    return F.when(F.exists("head", lambda e: e["some"]), merged).otherwise(lead_ids)


def expand_turns(
    turns: DataFrame,
    budget: Budget,
    template: Template = GENERIC,
    vocab: Vocabulary | Dictionary | None = None,
    key: str = "conv_id",
    width: int = DEFAULT_WIDTH,
    long: bool | None = None,
    cfg: PrepConfig = PrepConfig(),
) -> DataFrame:
    """Expansion of a turn table (key, turn, role, text)."""
    blocks = turn_blocks(turns, key, budget, template, vocab, width, long)
    return expand_blocks(blocks, [key], budget, template, vocab, cfg)


def expand_nested(
    df: DataFrame,
    keys: list[str],
    budget: Budget,
    template: Template = GENERIC,
    vocab: Vocabulary | Dictionary | None = None,
    width: int = DEFAULT_WIDTH,
    cfg: PrepConfig = PrepConfig(),
) -> DataFrame:
    """Expansion of nested conversations (keys, messages array<struct<role, text>>).

    In the harmony family, conversations whose lengths do not add up take the exact path.
    """

    def additive(rows: DataFrame) -> DataFrame:
        blocks = nested_blocks(rows, keys, budget, template, vocab, width)
        return expand_blocks(blocks, keys, budget, template, vocab, cfg)

    if not template.harmony:
        return additive(df)
    if vocab is None:
        raise ValueError("the harmony family needs a vocabulary")
    late = late_prefix(F.col("messages"))
    rest = expand_exact_words(df.where(late), keys, budget, vocab, template, cfg)
    return additive(df.where(~late)).unionByName(rest)


def expand_exact(
    df: DataFrame,
    keys: list[str],
    budget: Budget,
    encode: Callable[[Column], Column],
    template: Template = GENERIC,
    cfg: PrepConfig = PrepConfig(),
    max_token_bytes: int | None = None,
    min_message_tokens: int | None = None,
) -> DataFrame:
    """Expansion for tokenizers whose length is not additive over messages.

    Every candidate window is rendered and tokenised. ``encode`` maps array<string> to
    array<array<int>>. Two facts about the tokenizer, where known, leave out windows that
    cannot fit before they are rendered, with the same result: ``max_token_bytes``, the
    longest text one token can stand for, and ``min_message_tokens``, the fewest tokens one
    rendered message can have. Give one of them for corpora with very long conversations.
    """
    # Think spans shrink the text before it is counted, so no bound holds for them; a merged
    # prefix has fewer markers than messages.
    bounded = cfg.enable_thinking != "false"
    msgs = F.transform(
        "messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("text"))
    )
    rows = (
        df.select(*keys, msgs.alias("ms"))
        .withColumn("k", prefix_length(F.col("ms")))
        .select(
            *keys, "k",
            F.slice("ms", F.lit(1), F.col("k")).alias("head"),
            F.slice("ms", F.col("k") + 1, F.size("ms") - F.col("k")).alias("body"),
        )
    )
    body = F.col("body")
    starts_all = F.concat(
        F.array(F.lit(1)),
        F.filter(
            F.transform(body, lambda m, i: F.when(m["role"] == "assistant", i + 2)), lambda s: s.isNotNull()
        ),
    )
    rows = rows.withColumn("starts", starts_all)
    positions = F.when(F.size(body) > 0, F.sequence(F.lit(1), F.size(body))).otherwise(F.array().cast("array<int>"))
    targets = F.filter(positions, lambda i: F.get(body, i - 1)["role"] == "assistant")

    def window(start: Column, i: Column) -> Column:
        return F.slice(body, start, i - start + 1)

    # Bound step by step: inside a lambda the search for the nearest start would run once per start.
    def legal_starts(i: Column) -> Column:
        return F.struct(i.alias("i"), F.filter("starts", lambda s: s <= i).alias("legal"))

    def with_nearest(t: Column) -> Column:
        return F.struct(t["i"].alias("i"), t["legal"].alias("legal"), F.array_max(t["legal"]).alias("nearest"))

    def candidates(t: Column) -> Column:
        i, legal, nearest = t["i"], t["legal"], t["nearest"]
        if bounded and min_message_tokens and not template.harmony:
            legal = F.filter(legal, lambda s: ((i - s + 1) * min_message_tokens <= budget.max_length) | (s == nearest))
        if bounded and max_token_bytes:
            cap = budget.max_length * max_token_bytes

            def small(s: Column) -> Column:
                size = F.aggregate(window(s, i), F.lit(0), lambda a, m: a + F.octet_length(m["text"]))
                return (size <= cap) | (s == nearest)

            legal = F.filter(legal, small)
        windows = F.transform(legal, lambda s: F.struct(s.alias("start"), F.concat("head", window(s, i)).alias("w")))
        return F.struct(i.alias("i"), windows.alias("c"))

    # Targets become rows before their windows are cut, so that no row holds the windows of a whole conversation.
    found = F.transform(F.transform(targets, legal_starts), with_nearest)
    picked = rows.select(*keys, "k", "head", "body", F.explode_outer(found).alias("t")).where(F.col("t").isNotNull()).select(
        *keys, "k", candidates(F.col("t")).alias("t")
    )

    def pair(c: Column) -> Column:
        prompt, full, answer = chat_pair(c["w"], template, cfg)
        return F.struct(c["start"].alias("start"), prompt.alias("prompt"), full.alias("full"), answer.alias("answer"))

    texts = picked.select(*keys, "k", F.col("t.i").alias("i"), F.transform("t.c", pair).alias("c")).withColumn(
        "answer", F.get(F.col("c"), F.lit(0))["answer"]
    )
    coded = (
        texts.withColumn("answer_ids", F.get(encode(F.array("answer")), F.lit(0)))
        .where(F.size("answer_ids") <= budget.max_output)
        .withColumn("prompts", encode(F.transform("c", lambda x: x["prompt"])))
        .withColumn("fulls", encode(F.transform("c", lambda x: x["full"])))
    )
    options = F.transform(
        "c",
        lambda x, j: F.struct(
            x["start"].alias("start"), F.get(F.col("prompts"), j).alias("prompt"), F.get(F.col("fulls"), j).alias("full")
        ),
    )
    fitting = F.filter(
        options, lambda o: (F.size(o["full"]) <= budget.max_length) & (F.size(o["prompt"]) <= budget.max_input)
    )
    chosen = coded.withColumn("fit", F.try_element_at(fitting, F.lit(1))).withColumn(
        "least", F.try_element_at(options, F.lit(-1))
    )
    fits = F.col("fit").isNotNull()
    cut = A.tail(F.col("least")["prompt"], budget.max_input)
    result = chosen.select(
        *keys,
        (F.col("k") + F.col("i") - 1).cast("long").alias("turn"),
        F.when(fits, F.col("k") + F.col("fit")["start"] - 1).cast("long").alias("start"),
        F.when(~fits, "trunc").when(F.col("fit")["start"] == 1, "full").otherwise("window").alias("kind"),
        F.when(fits, F.col("fit")["prompt"]).otherwise(cut).alias("prompt_ids"),
        F.when(fits, F.col("fit")["full"])
        .otherwise(truncated_full(F.col("least")["full"], cut, F.col("answer_ids")))
        .alias("input_ids"),
        F.col("answer").alias("response"),
        F.size("answer_ids").alias("n_response"),
    )
    return result.select(
        *keys, "turn", "start", "kind",
        F.size("prompt_ids").alias("n_prompt"), F.size("input_ids").alias("n_full"), "n_response",
        "prompt_ids", "input_ids", "response", F.col("input_ids").alias("labels"),
    )


def window_texts_encoder(vocab: Vocabulary) -> Callable[[Column], Column]:
    """The word tokenizer in the shape :func:`expand_exact` asks for."""
    return lambda texts: vocab.nested_ids(F.transform(texts, words))


def expand_exact_words(
    df: DataFrame,
    keys: list[str],
    budget: Budget,
    vocab: Vocabulary | Dictionary,
    template: Template = GENERIC,
    cfg: PrepConfig = PrepConfig(),
    min_message_tokens: int | None = None,
) -> DataFrame:
    """:func:`expand_exact` with the word tokenizer: windows are chosen on words, and only those of a sample get ids."""
    samples = expand_exact(df, keys, budget, lambda texts: F.transform(texts, words), template, cfg, None, min_message_tokens)
    both = samples.withColumn("both", F.array("prompt_ids", "input_ids"))
    coded = vocab.with_ids(both, [*keys, "turn"], "both", "ids")
    prompt, full = F.get("ids", F.lit(0)), F.get("ids", F.lit(1))
    return coded.withColumns({"prompt_ids": prompt, "input_ids": full, "labels": full}).select(*samples.columns)
