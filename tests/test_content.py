"""Literal cases for roles, text and mixed-type content."""

import json

import pytest
from pyspark.sql import functions as F

from turnloom.config import BatchSpec, Budget, PrepConfig
from turnloom.functions import content as C
from turnloom.functions import text as X
from turnloom.operators import normalize as N
from turnloom.operators import template as T
from turnloom.sources import files, sinks


def one(spark, value, column, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, want, harmony",
    [
        ("assistant", "assistant", None), (" BOT\n", "assistant", None), ("gpt", "assistant", None), ("Model", "assistant", None),
        ("tool", "tool", None), ("function", "tool", None), ("system", "system", None), ("Developer", "system", "developer"),
        ("user", "user", None), (" human", "user", None),
    ],
)
def test_roles(spark, raw, want, harmony):
    assert one(spark, raw, X.canonical_role) == want
    assert one(spark, raw, lambda c: X.canonical_role(c, True)) == (harmony or want)


def test_unknown_role_fails_or_is_set_aside(spark):
    df = spark.createDataFrame(
        [(1, [("narrator", "x")]), (2, [("user", "y")])], "id long, messages array<struct<role string, content string>>"
    )
    with pytest.raises(Exception, match="unsupported role"):
        N.normalize(df, PrepConfig(), ["id"]).collect()
    rows = {r.id: r.error for r in N.normalize(df, PrepConfig(on_error="quarantine"), ["id"]).collect()}
    assert rows == {1: "unsupported role: narrator", 2: None}


@pytest.mark.parametrize(
    "text, want",
    [
        ("a", "a"),
        ("<think>x</think>  a ", "a"),
        ("<think>\nx\ny\n</think>\n\na<think></think> b", "ab"),
        ("<think>open", "<think>open"),
        ("<think><think>x</think></think> a", "</think> a"),
        (" a ", "a"),
    ],
)
def test_thinking(spark, text, want):
    assert one(spark, text, X.clean_generated) == want
    assert one(spark, text, lambda c: X.apply_thinking(c, "auto")) == text


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<|start|>assistant<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>final<|message|>yes<|return|>", "yes"),
        ("<|start|>assistant<|message|>one<|end|><|start|>assistant<|channel|>commentary<|recipient|>f<|message|>two", "one\ntwo"),
        ("<|start|>assistant<|channel|>final<|message|> <|x|> <|end|>", ""),
        ("assistantanalysisfinalhi<|end|> ", "hi"),
        ("plain", "plain"),
    ],
)
def test_transcripts(spark, raw, want):
    assert one(spark, raw, X.visible_text) == want


def test_prompt_join(spark):
    df = spark.createDataFrame([("a", "b"), ("a", ""), (None, "b"), (None, None), ("", "")], "p string, i string")
    got = [r.r for r in df.select(X.prompt_join(F.col("p"), F.col("i")).alias("r")).collect()]
    assert got == ["a\n\nb", "a", "b", "", ""]


# (content, its text with placeholders, its text without other modalities)
CONTENTS = [
    (None, "", ""),
    (5, "5", "5"),
    (1.5, "1.5", "1.5"),
    (True, "True", "True"),
    ("", "", ""),
    ("plain", "plain", "plain"),
    ('["looks like a list"]', '["looks like a list"]', '["looks like a list"]'),
    ([], "", ""),
    (["a", "b"], "ab", "ab"),
    ([{"type": "text", "text": "t"}, "u"], "tu", "tu"),
    (
        [{"type": "image_url", "image_url": {"url": "u"}}, {"image": "i"}, {"video": None}, {"file": 1}, {"audio_url": "x"}],
        "[IMAGE_URL][IMAGE][VIDEO][DOCUMENT][AUDIO]",
        "",
    ),
    ([{"type": " IMAGE.png ", "text": "no"}, {"type": "Table", "rows": 3}, {"type": None, "text": "quirk"}], "[IMAGE][TABLE][NONE]", ""),
    ([{"text": 7}, {"text": None}, {"text": True}, {"type": "text"}], "7NoneTrue", "7NoneTrue"),
    ([{"foo": 1}], "[UNKNOWN]", ""),
]


@pytest.mark.parametrize("mode", ["placeholder", "text-only"])
def test_content_modes(spark, mode):
    rows = [(i, json.dumps(c[0])) for i, c in enumerate(CONTENTS)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("v", F.parse_json("j"))
    text, _, error = N.content_fields(F.col("v"), df.schema["v"].dataType, PrepConfig(multimodal_mode=mode))
    got = {r.i: (r.t, r.e) for r in df.select("i", text.alias("t"), error.alias("e")).collect()}
    assert got == {i: (c[1] if mode == "placeholder" else c[2], None) for i, c in enumerate(CONTENTS)}


@pytest.mark.parametrize("mode, texts, bad", [
    ("placeholder", ["hi[IMAGE]", "yo", ""], []), ("text-only", ["hi", "yo", ""], []),
    ("strict", ["hi[IMAGE]", "yo", ""], [0]), ("preserve", ["hi[IMAGE]", "yo", ""], []),
])
def test_typed_lists_of_parts(spark, mode, texts, bad):
    rows = [(0, [("text", "hi"), ("image", None)]), (1, [("text", "yo")]), (2, None)]
    df = spark.createDataFrame(rows, "i int, v array<struct<type string, text string>>")
    text, _, error = N.content_fields(F.col("v"), df.schema["v"].dataType, PrepConfig(multimodal_mode=mode))
    got = df.orderBy("i").select(text.alias("t"), error.alias("e")).collect()
    assert [r.t for r in got] == texts and [i for i, r in enumerate(got) if r.e] == bad


def test_other_content_types(spark):
    def text(value, schema):
        df = spark.createDataFrame([(value,)], f"v {schema}")
        return df.select(N.content_fields(F.col("v"), df.schema["v"].dataType, PrepConfig(multimodal_mode="placeholder"))[0]).first()[0]

    assert text(["a", "b"], "array<string>") == "ab" and text(True, "boolean") == "True"
    with pytest.raises(TypeError):
        text([1], "array<int>")


@pytest.mark.parametrize("schema, values", [
    ("string", [(None, False), ("", False), ("x", True)]), ("int", [(0, False), (2, True)]), ("boolean", [(False, False), (True, True)]),
    ("array<struct<type string, image string>>", [([], False), ([("image", "u")], True), (None, False)]),
])
def test_system_value_counts_by_its_raw_form(spark, schema, values):
    cfg = PrepConfig(system_column="s", multimodal_mode="text-only")
    df = spark.createDataFrame([(i, v, "q", "a") for i, (v, _) in enumerate(values)], f"i int, s {schema}, prompt string, response string")
    got = {r.i: len(r.messages) == 3 for r in N.normalize(df, cfg, ["i"]).collect()}
    assert got == {i: w for i, (_, w) in enumerate(values)}


def test_content_errors(spark):
    cases = {
        "strict": [([{"type": "text", "text": "a"}], None), ([{"image": "i"}], "multimodal content in strict mode")],
        "preserve": [([{"image": "i"}], None), ([{"foo": 1}], "unsupported multimodal content item")],
        "placeholder": [(["a", 3], "unsupported content item type"), (["a", ["b"]], "unsupported content item type"), (["a", None], "unsupported content item type")],
    }
    for mode, rows in cases.items():
        df = spark.createDataFrame([(json.dumps(c),) for c, _ in rows], "j string").select(F.parse_json("j").alias("v"))
        error = N.content_fields(F.col("v"), df.schema["v"].dataType, PrepConfig(multimodal_mode=mode))[2]
        assert [r.e for r in df.select(error.alias("e")).collect()] == [e for _, e in rows]


def test_processor_wraps_scalars_and_media_are_collected(spark):
    msgs = [
        {"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}, {"image": "", "image_url": "w"}, {"video": "v"}]},
        {"role": "assistant", "content": "fine"},
        {"role": "user", "content": None},
    ]
    df = spark.createDataFrame([(json.dumps({"id": 1, "messages": msgs}),)], "value string")
    schema = "id long, messages array<struct<role string, content variant>>"
    src = df.select(F.from_json("value", schema).alias("x")).select("x.*")
    out = N.normalize(src, PrepConfig(use_processor=True), ["id"])
    r = out.select(
        F.transform("messages", lambda m: F.size(m["parts"])).alias("n"), F.transform("messages", lambda m: m["text"]).alias("t"),
        C.media_refs(F.col("messages"), "image").alias("i"), C.media_refs(F.col("messages"), "video").alias("v"),
        C.media_refs(F.slice("messages", 2, 2), "image").alias("none"),
    ).first()
    assert r.n == [3, 1, 0] and r.t == ["[IMAGE_URL][IMAGE][VIDEO]", "fine", ""]
    assert r.i == ['{"url":"u"}', "w"] and r.v == ["v"] and r.none is None


def test_detect_format_order():
    auto = PrepConfig()
    assert N.detect_format(["prompt", "completion"], auto) == "prompt-response"
    assert N.detect_format(["question", "response"], auto) == "prompt-response"
    assert N.detect_format(["conversation"], auto) == "sharegpt"
    assert N.detect_format(["chosen", "messages"], auto) == "messages"
    assert N.detect_format(["messages", "out"], PrepConfig(output_column="out")) == "alpaca"
    assert N.detect_format(["x"], PrepConfig(input_format="chosen")) == "chosen"
    with pytest.raises(ValueError):
        N.detect_format(["prompt"], auto)


def test_chat_pair_needs_final_assistant(spark):
    df = spark.createDataFrame([([("user", "x")],), ([],)], "messages array<struct<role string, text string>>")
    with pytest.raises(Exception, match="must be from the assistant"):
        df.select(T.chat_pair(F.col("messages"), T.GENERIC, PrepConfig())[0].alias("p")).collect()


def test_config_checks():
    with pytest.raises(ValueError):
        Budget(10, 10)
    with pytest.raises(ValueError):
        PrepConfig(multimodal_mode="other")
    assert BatchSpec().max_length == 2048


def test_json_content_keeps_lists_and_texts_apart(spark, tmp_path):
    rows = [{"id": 1, "messages": [{"role": "user", "content": '["hi"]'}, {"role": "assistant", "content": ["hi"]}]}]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    df = files.load_source(spark, "jsonl", str(path), mixed_content=True)
    texts = N.normalize(df, PrepConfig(multimodal_mode="placeholder"), ["id"]).first().messages
    assert [m.text for m in texts] == ['["hi"]', "hi"]


def test_names_and_sizes():
    assert files.file_list(" a.json, ,b.json,") == ["a.json", "b.json"] and files.file_list(None) is None
    assert sinks.output_name("org\\my data!/", "m") == "my-data--m"
    assert sinks.output_name("x", explicit="y") == "y" and sinks.output_name("", None) == "prepared-data"
    assert sinks.parse_bytes("500MB") == 500_000_000 and sinks.parse_bytes("1.5kb") == 1500
    assert files.preset_column(["chosen"]) == "chosen"
