"""Expansion with real tokenizers against every window of every target, rendered and tokenised."""

import random
import time

import pytest

from turnloom.config import Budget
from turnloom.operators import exact as X
from turnloom.operators import template as T
from turnloom.operators import windows as W
from turnloom.functions.tokens import text_encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "conv_id long, messages array<struct<role:string,text:string>>"


def by_thirds():
    """Groups of three characters, counted from the start of the text: a join saves at most one."""

    def load():
        return lambda texts: [[sum(ord(c) * 31**k for k, c in enumerate(t[i : i + 3])) % 1_000_003 for i in range(0, len(t), 3)] for t in texts]

    return load


thirds = by_thirds()  # made inside a function, so that it travels to the tasks by value


def talks(seed, n, longest):
    g = random.Random(seed)
    words = ["alpha", "Beta", "  gamma", "\n\ndelta", "'s", "12", "été", "<|end|>", "\n", "ωμέγα"]
    out = []
    for conv in range(n):
        head = [("system", "be brief")] * g.choice([0, 0, 1, 2])
        body = [(g.choice(["user", "assistant", "assistant", "user", "tool", "system"]), " ".join(g.choice(words) for _ in range(g.randint(0, 9)))) for _ in range(g.choice([0, 1, 2, 5, longest]))]
        out.append((conv, head + body))
    return out


def brute(conv, msgs, budget, encode, template):
    k = 0
    while k < len(msgs) and msgs[k][0] in ("system", "developer"):
        k += 1
    head, body, found = msgs[:k], msgs[k:], []

    def render(ms):
        return "".join(template.prefix[r] + (t or "") + template.suffix[r] for r, t in ms)

    for end, (role, text) in enumerate(body):
        answer = encode([text or ""])[0]
        if role != "assistant" or len(answer) > budget.max_output:
            continue
        for s in [0] + [i + 1 for i in range(end) if body[i][0] == "assistant"]:
            prompt, full = encode([render(head + body[s:end]) + template.generation, render(head + body[s : end + 1])])
            if len(full) <= budget.max_length and len(prompt) <= budget.max_input:
                found.append((conv, k + end, k + s, "full" if s == 0 else "window", tuple(prompt), tuple(full), text or ""))
                break
        else:
            cut = prompt[-budget.max_input :]
            full = cut + answer if answer and full[-len(answer) :] == answer else full[-(len(cut) + len(answer)) :]
            found.append((conv, k + end, None, "trunc", tuple(cut), tuple(full), text or ""))
    return found


def collected(df):
    rows = df.collect()
    for r in rows:
        assert (r.n_prompt, r.n_full) == (len(r.prompt_ids), len(r.input_ids)) and r.labels == r.input_ids
    return sorted(((r.conv_id, r.turn, r.start, r.kind, tuple(r.prompt_ids), tuple(r.input_ids), r.response) for r in rows), key=repr)


CASES = [
    (thirds, T.GENERIC, Budget(120, 30), 1, 5),
    (thirds, T.PLAIN, Budget(40, 15), 1, 1),
    (X.tokenizer_file(BYTE_BPE), T.GENERIC, Budget(150, 40), 2, 4),
    (X.tokenizer_file(BYTE_BPE), T.PLAIN, Budget(60, 20), 3, 1),
    (X.tokenizer_file(WORD_BPE), T.GENERIC, Budget(150, 40), 2, 4),
]


@pytest.mark.parametrize("load, template, budget, slack, least", CASES)
@pytest.mark.parametrize("width", [3, 256])
def test_equals_every_window(spark, load, template, budget, slack, least, width):
    if template is T.PLAIN:
        least = 1
        convs = [(c, [(r, t + ".") for r, t in m]) for c, m in talks(6, 20, 30)]
    else:
        convs = talks(5, 25, 40)
    # A run without assistant turn longer than any context: the cut sample reaches back over blocks.
    convs.append((900, [("user", "q"), ("assistant", "a")] + [("user", "word " * 3 + ".")] * 60 + [("assistant", "yes.")] * 3))
    convs += [(901, []), (902, [("system", "alone")]), (903, [("user", None), ("assistant", None), ("assistant", "z.")]), (903, [("assistant", "twice.")])]
    df = spark.createDataFrame(convs, SCHEMA)
    got = collected(X.expand_tokenized(df, ["conv_id"], budget, load, template, slack, least, width))
    assert got == sorted((s for c, m in convs for s in brute(c, m, budget, load(), template)), key=repr)
    assert {r[3] for r in got} == {"full", "window", "trunc"}


def test_equals_the_path_that_tries_every_start(spark):
    df = spark.createDataFrame(talks(9, 15, 30), SCHEMA)
    budget = Budget(120, 30)
    want = W.expand_exact(df, ["conv_id"], budget, text_encoder(thirds), max_token_bytes=12)
    assert collected(X.expand_tokenized(df, ["conv_id"], budget, thirds, min_message_tokens=5)) == collected(want)


def test_long_conversation(spark):
    talk = [("user" if i % 2 == 0 else "assistant", f"turn {i} says some ordinary words about nothing much") for i in range(4500)]
    df = spark.createDataFrame([(1, talk)], SCHEMA).withColumnRenamed("conv_id", "id")
    begin = time.time()
    got = X.expand_tokenized(df, ["id"], Budget(512, 128), X.tokenizer_file(BYTE_BPE), slack=2, min_message_tokens=6).select("turn", "start", "n_prompt", "n_full").collect()
    assert time.time() - begin < 60
    assert sorted(r.turn for r in got) == list(range(1, 4500, 2))
    assert all(r.n_full <= 512 and r.start is not None for r in got)
    # One more question and answer (about 45 ids) would not fit the 384 ids of the input.
    assert all(384 - 60 < r.n_prompt <= 384 for r in got if r.turn > 200)


def test_empty_table_and_wrong_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert X.expand_tokenized(df, ["conv_id"], Budget(64, 16), thirds).count() == 0
    with pytest.raises(ValueError):
        X.expand_tokenized(df, ["conv_id"], Budget(64, 16), thirds, T.HARMONY)
    with pytest.raises(ValueError):
        X.expand_tokenized(df, ["conv_id"], Budget(64, 16), thirds, min_message_tokens=0)


def test_registered_query_equals_every_window(spark):
    from turnloom.plans import fixtures as fx
    from turnloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    talks_of = {}
    for r in fx.turns(spark, sf).orderBy("conv_id", "turn").collect():
        talks_of.setdefault(r.conv_id, []).append((r.role, r.text))
    encode = X.tokenizer_file(BYTE_BPE)()
    want = [(s[0], s[1], s[2], s[3], " ".join(map(str, s[5])), s[6]) for c, m in talks_of.items() for s in brute(c, m, Budget(2048, 512), encode, T.GENERIC)]
    got = [(r.conv_id, r.turn, r.start, r.kind, r.input_ids, r.response) for r in QUERIES["expand_samples_tokenized"](spark, sf).collect()]
    assert got and sorted(got, key=repr) == sorted(want, key=repr)


def test_prepare_with_a_tokenizer_file(spark):
    from turnloom.config import PrepConfig
    from turnloom.plans.prepare import expand_messages

    df, budget = spark.createDataFrame(talks(3, 10, 12), SCHEMA), Budget(150, 40)
    load = X.tokenizer_file(BYTE_BPE)
    got = expand_messages(df, ["conv_id"], PrepConfig(budget=budget), load=load, slack=2, min_message_tokens=4)
    assert collected(got) == sorted((s for c, m in talks(3, 10, 12) for s in brute(c, m, budget, load(), T.GENERIC)), key=repr)
    with pytest.raises(ValueError):
        expand_messages(df, ["conv_id"], PrepConfig(budget=budget, enable_thinking="false"), load=load)
