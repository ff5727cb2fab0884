"""Results at the limits of budgets, blocks and buffers."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from check_oracles import difference
from turnloom.operators import evaluate as E
from turnloom.plans.catalog import QUERIES
from turnloom.plans.oracles import ORACLES
from turnloom.streaming import jobs


@pytest.mark.parametrize("size", [254, 255, 256, 257])
def test_packed_answer_of_the_longest_size_keeps_its_end(spark, tmp_path, size):
    """An answer of max_output words and its end marker are one id more than max_output."""
    import duckdb

    turns = [(1, 0, "user", "a question"), (1, 1, "assistant", " ".join(f"w{i}" for i in range(size))), (1, 2, "user", "more"), (1, 3, "assistant", "short")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert difference(QUERIES["pack_generated"](spark, str(tmp_path)), db, ORACLES["pack_generated"]) is None


class _Map:
    """The calls of map state that the reorder buffer uses."""

    def __init__(self):
        self.kept, self.writes = {}, 0

    def getValue(self, key):
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key], self.writes = value, self.writes + 1


@pytest.mark.parametrize("settled", [1 << 18, 64])
def test_short_runs_share_the_frames_of_a_bucket(monkeypatch, settled):
    """One frame for the 300 runs of a bucket, not one each; steps too early wait, repeated ones are late."""
    monkeypatch.setattr(jobs, "_SETTLED", settled)
    rng, buffer = np.random.default_rng(0), jobs._InOrder(4)
    buffer.state = _Map()
    log = pd.DataFrame([(run, step // 4, step, step, 10, run + step / 10) for run in range(300) for step in range(10)], columns=jobs._WAITING.names)
    log = log.iloc[rng.permutation(len(log))]
    missing = (log["run"] % 3 == 0) & (log["place"] == 1)

    step = 60 if settled == 64 else len(log)

    def sent(rows):
        return list(buffer.handleInputRows((0,), iter(rows.iloc[a : a + step] for a in range(0, len(rows), step)), None))

    first = sent(log[~missing])
    assert settled == 64 or (len(first) == 1 and buffer.state.writes == 900)
    first = pd.concat(first)
    # In block 0 of every third run all steps behind the missing one wait.
    assert len(first) == 3000 - 100 * 3 and not first["late"].any() and first["total"].dtype == "int64"
    again = pd.concat(sent(pd.concat([log[missing], log[log["run"] == 1]])))
    assert len(again) == 300 + 10 and set(again[again["late"]]["run"]) == {1} and again["late"].sum() == 10
    passed = pd.concat([first, again[~again["late"]]])
    assert set(zip(passed["run"], passed["step"], passed["loss"])) == set(zip(log["run"], log["step"], log["loss"])) and len(passed) == 3000
    off = log[log["run"] < 2].assign(block=-1, place=-1)
    assert pd.concat(sent(off))["late"].all()


def test_words_of_a_whole_batch_are_never_held_at_once():
    """10,000 pairs of 100 words each take some megabytes of objects, not hundreds; null and empty lists score 0."""
    words = pa.array([[f"word{(i + j) % 5000}" for j in range(100)] for i in range(10_000)] + [None, []], pa.list_(pa.string()))
    tracemalloc.start()
    scores = E.pair_scores(words, words).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
    assert scores[:10_000] == [1.0] * 10_000 and scores[10_000:] == [0.0, 0.0]
