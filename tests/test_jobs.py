"""Whole jobs: every registered query, preparation levels, streams in several batches."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry
from check_oracles import database, difference
from turnloom.config import Budget, PrepConfig
from turnloom.functions.schedule import Schedule
from turnloom.functions.tokens import Vocabulary, text_encoder, tokenizer_file
from turnloom.operators import folds as S
from turnloom.operators import normalize as N
from turnloom.operators import sampling as Q
from turnloom.operators import windows as W
from turnloom.plans import fixtures as fx
from turnloom.plans.catalog import QUERIES
from turnloom.plans.oracles import ORACLES
from turnloom.plans.prepare import prepare, store
from turnloom.sources import sinks
from turnloom.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, db, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_only_python_metrics_and_real_tokenizers_lack_sql():
    # The last is compared with every window of every target in test_exact.py.
    assert set(QUERIES) - set(ORACLES) == {"rouge_l", "eval_metrics", "eval_by_set", "expand_samples_tokenized"}


def test_one_conversation_of_4500_turns(spark, tmp_path):
    """Every path but the exact one (too slow at this length) sees the whole of it: same samples, one result per conversation, positions 0 to 4,499."""
    t = fx.turns(spark, SF)
    long_one = spark.range(4500).select(
        F.lit(10**6).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
    )
    t.unionByName(long_one).write.parquet(f"{tmp_path}/conversations.parquet")

    def of_long(name, key="conv_id"):
        got = QUERIES[name](spark, str(tmp_path))
        return got.where(F.split_part(F.col(key).cast("string"), F.lit("-"), F.lit(1)) == "1000000")

    want = sorted(tuple(r) for r in of_long("flagship").select("turn", "start", "kind", "n_prompt", "n_full").collect())
    assert len(want) == 2250 and want[-1][0] == 4499 and sum(k == "full" for _, _, k, _, _ in want) < 10
    assert sorted(tuple(r) for r in of_long("stream_expand").select("turn", "start", "kind", "n_prompt", "n_full").collect()) == want
    assert sorted(tuple(r) for r in of_long("expand_samples").select("turn", "start", "kind").collect()) == [w[:3] for w in want]
    ids = of_long("prepare_corpus", "sample_id").select(F.split_part("sample_id", F.lit("-"), F.lit(2)).cast("long"), "kind", "n_prompt", "n_full")
    assert sorted(tuple(r) for r in ids.collect()) == [(a, k, p, n) for a, _, k, p, n in want]
    assert sorted(r.i for r in of_long("norm_messages").collect()) == list(range(4500))
    for name in ("src_turns_to_messages", "prefix_split", "chat_pair", "render_template", "flatten_lists"):
        assert of_long(name).count() == 1


@pytest.mark.parametrize("level", ["conversation", "sample"])
def test_prepare_levels_and_store(spark, level):
    vocab = Vocabulary.fit(fx.turns(spark, SF), max_size=500)
    cfg = PrepConfig(eval_size=5, budget=Budget(320, 256))
    out = prepare(fx.messages(spark, SF), "conv_id", cfg, vocab=vocab, level=level)
    path = sinks.work_dir(spark, "store")
    store(out, path)
    test = sinks.read_prepared(spark, path, "test")
    found = test.count() if level == "sample" else test.select(F.split_part("sample_id", F.lit("-"), F.lit(1))).distinct().count()
    assert found == 5 if level == "sample" else found <= 5
    assert sinks.read_prepared(spark, path).count() == 29


def test_vocabulary_round_trip(spark):
    vocab = Vocabulary.fit(fx.turns(spark, SF), max_size=50)
    path = sinks.work_dir(spark, "vocab")
    vocab.save(spark, path)
    assert Vocabulary.load(spark, path) == vocab and len(vocab.tokens) == 50


def test_exact_path_with_a_trained_tokenizer(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    texts = [r.text for r in fx.turns(spark, SF).select("text").collect()]
    tok.train_from_iterator(texts, tokenizers.trainers.BpeTrainer(vocab_size=800, special_tokens=["[UNK]"]))
    path = str(tmp_path / "tok.json")
    tok.save(path)
    nested = N.normalize(fx.messages(spark, SF), PrepConfig(), ["conv_id"])
    budget = Budget(600, 400)
    got = W.expand_exact(nested, ["conv_id"], budget, text_encoder(tokenizer_file(path))).collect()
    assert got and all(r.n_prompt <= budget.max_input and r.n_full <= budget.max_length for r in got)
    full = next(r for r in got if r.kind == "full" and r.turn <= 2)
    msgs = next(r.messages for r in nested.where(F.col("conv_id") == full.conv_id).collect())
    text = "".join(f"<|{m.role}|>\n{m.text}\n<|end|>\n" for m in msgs[: full.turn + 1])
    assert full.input_ids == tok.encode(text).ids


def write_in_turn(df, folder, parts):
    """Several files whose modification order is the order of ``parts``."""
    for cond in parts:
        df.where(cond).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("files, width", [(1, 3), (2, 512), (1000, 4)])
def test_streamed_schedule_in_any_order(spark, files, width):
    """Shuffled files, the first step last, many triggers or one: the batch result."""
    log = fx.runlog(spark, SF).where("run < 30").select("run", "step", "total", "loss").cache()
    folder = sinks.work_dir(spark, "log")
    part = F.pmod(F.xxhash64("run", "step"), F.lit(3))
    write_in_turn(log, folder, [(part == k) & (F.col("step") > 0) for k in (2, 0, 1)] + [F.col("step") == 0])
    stream = jobs.read_stream(spark, folder, log.schema, files=files)
    emitted = jobs.run_to_table(jobs.schedule_stream(stream, width=width), "sched")
    got = jobs.schedule_result(emitted, width=width).collect()
    want = {(r.run, r.step): r.t for r in S.interp_schedule(log).collect()}
    assert len(want) > 300 and not any(r.late for r in got)
    assert {(r.run, r.step): r.t for r in got} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_streamed_schedule_stops_at_a_missing_step(spark):
    """Steps 10, 20, ... with one missing, one repeated and one off the grid."""
    rows = [(7, s, 200, 1.0 / s) for s in range(10, 210, 10) if s != 90]
    odd = [(7, 30, 200, 9.0), (7, 35, 200, 9.0), (7, 0, 200, 9.0)]
    df = spark.createDataFrame(rows + odd, "run long, step long, total long, loss double")
    folder = sinks.work_dir(spark, "log")
    early = (F.col("step") % 20 == 0) & (F.col("step") > 0)
    write_in_turn(df, folder, [early, (F.col("step") % 20 == 10) & (F.col("loss") < 9), F.col("loss") == 9])
    emitted = jobs.run_to_table(jobs.schedule_stream(jobs.read_stream(spark, folder, df.schema, files=1), 10, 10, 4), "sched")
    got = jobs.schedule_result(emitted, Schedule(alpha=0.1), 10, 10, 4).collect()
    assert sorted(r.step for r in got if r.late) == [0, 30, 35]
    want = {r.step: r.t for r in S.interp_schedule(df.where("loss < 9 AND step < 90"), alpha=0.1).collect()}
    assert {r.step: r.t for r in got if not r.late} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_streamed_buffer_over_many_batches(spark):
    e = fx.table(spark, SF, "events").select(
        (F.col("user_id") % 2).alias("shard"), F.unix_micros(F.col("ts").cast("timestamp")).alias("step"), F.col("event_id").alias("item")
    ).cache()
    folder = sinks.work_dir(spark, "buffer")
    write_in_turn(e, folder, [F.col("item") % 3 == k for k in (2, 0, 1)])
    emitted = jobs.run_to_table(jobs.replay_stream(jobs.read_stream(spark, folder, e.schema, files=1), 40, salts=3), "buffer")
    got = {tuple(r) for r in jobs.replay_result(emitted, 40).select("shard", "step", "item").collect()}
    assert got == {tuple(r) for r in Q.replay_keep(e, ["step", "item"], 40, "shard").select("shard", "step", "item").collect()}
