"""Dictionaries without a limit against plain Python, whatever share of the words is joined."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnloom.config import Budget, PrepConfig
from turnloom.functions.tokens import SPECIAL_TOKENS, UNK_ID, Dictionary, dictionary_table
from turnloom.operators import windows as W
from turnloom.operators.ranks import ranked
from turnloom.operators.template import HARMONY
from turnloom.sources import sinks
from tests.test_expansion import collected, expected, nested_table, turn_table


def conversations(seed, n=12):
    """Every word is new or very common; some turns are empty, some repeat a special token."""
    r = random.Random(seed)
    words = ["the", "of", "<pad>", "<|end|>", *(f"w{i}" for i in range(300))]
    return [
        (c, [(("user", "assistant")[t % 2] if t or c % 3 else "system", " ".join(r.choice(words[: 4 if r.random() < 0.5 else None]) for _ in range(r.randrange(0, 30)))) for t in range(r.randrange(1, 12))])
        for c in range(n)
    ]


def numbered(convs):
    counts = Counter(w for _, m in convs for _, t in m for w in t.split() if w not in SPECIAL_TOKENS)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    return [(w, counts[w], i + len(SPECIAL_TOKENS)) for i, w in enumerate(order)]


def test_ranks_are_dense_over_many_partitions(spark):
    df = spark.range(5000).withColumn("x", F.xxhash64("id")).repartition(7)
    got = {r.id: r.rank for r in ranked(df, F.desc("x"), "id").collect()}
    rows = sorted(((r.x, r.id) for r in df.collect()), key=lambda p: (-p[0], p[1]))
    assert got == {i: k for k, (_, i) in enumerate(rows)}
    assert ranked(df.where("false"), "id").count() == 0


def test_every_word_has_an_id(spark):
    convs = conversations(1)
    got = [tuple(r) for r in dictionary_table(turn_table(spark, convs)).orderBy("id").collect()]
    assert got == numbered(convs) and len(got) > 200


@pytest.mark.parametrize("hot", [0, 5, 10**6])
def test_ids_of_flat_and_nested_lists(spark, hot):
    convs = conversations(2)
    d = Dictionary.fit(turn_table(spark, convs), hot_words=hot)
    assert d.complete == (hot > 1000)
    index = {w: i for i, w in enumerate(SPECIAL_TOKENS)} | {w: i for w, _, i in numbered(convs)}
    lists = [(0, ["the", "never", "w7"]), (1, []), (2, None), (None, ["w1", "w1", "<pad>"]), (4, [f"w{i}" for i in range(300)])]
    df = spark.createDataFrame([(k, w, 1) for k, w in lists], "k long, words array<string>, _at int")
    got = {r.k: r.ids for r in d.with_ids(df, ["k"], "words", "ids").collect()}
    assert got == {k: w and [index.get(x, UNK_ID) for x in w] if w is not None else None for k, w in lists}
    nested = spark.createDataFrame([(k, [w or [], ["of"], []]) for k, w in lists], "k long, words array<array<string>>")
    got = {r.k: r.ids for r in d.with_ids(nested, ["k"], "words", "ids").collect()}
    assert got == {k: [[index.get(x, UNK_ID) for x in w or []], [index["of"]], []] for k, w in lists}
    rare = numbered(convs)[-1][0]
    assert d.id_of(rare) == index[rare] and d.id_of("never") == UNK_ID and d.id_of("<|user|>") == index["<|user|>"]


def test_repeated_keys_are_an_error_where_words_are_joined(spark):
    d = Dictionary.fit(turn_table(spark, conversations(2)), hot_words=1)
    df = spark.createDataFrame([(1, ["w1"]), (1, ["w2"])], "k long, words array<string>")
    with pytest.raises(Exception, match="repeat a key"):
        d.with_ids(df, ["k"], "words", "ids").collect()


@pytest.mark.parametrize("hot", [3, 10**6])
def test_expansion_with_a_dictionary(spark, hot):
    convs = conversations(3)
    budget = Budget(60, 25)
    d = Dictionary.fit(turn_table(spark, convs), hot_words=hot)

    class Whole:
        tokens = SPECIAL_TOKENS + tuple(w for w, _, _ in numbered(convs))

    want = expected(convs, budget, Whole)
    assert collected(W.expand_turns(turn_table(spark, convs), budget, vocab=d, width=20)) == want
    assert collected(W.expand_nested(nested_table(spark, convs), ["conv_id"], budget, vocab=d, width=20)) == want
    assert collected(W.expand_exact_words(nested_table(spark, convs), ["conv_id"], budget, d)) == want
    harmony = expected(convs, budget, Whole, harmony=True)
    assert collected(W.expand_nested(nested_table(spark, convs), ["conv_id"], budget, HARMONY, d, cfg=PrepConfig())) == harmony


def test_stored_dictionaries(spark):
    convs = conversations(4)
    d = Dictionary.fit(turn_table(spark, convs), hot_words=10)
    path = sinks.work_dir(spark, "dictionary")
    d.save(path)
    again = Dictionary.load(spark, path, hot_words=20)
    assert again.hot[: len(d.hot)] == d.hot and len(again.hot) == len(SPECIAL_TOKENS) + 20 and not again.complete
    empty = Dictionary.fit(turn_table(spark, convs).where("false"))
    assert empty.hot == SPECIAL_TOKENS and empty.complete
