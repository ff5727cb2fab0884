"""The table of candidate windows, margin thresholds and buffer changes against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.config import Budget
from turnloom.operators import folds as S
from turnloom.operators.candidates import candidate_windows
from turnloom.sources import sinks
from turnloom.streaming import jobs

TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(30):
        head = [rng.choice(["system", "developer"]) for _ in range(rng.randrange(3))]
        body = [rng.choice(["user", "assistant", "tool", "assistant"]) for _ in range(rng.randrange(25))]
        for turn, role in enumerate(head + body):
            text = " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(9)))
            rows.append((conv, turn, role, text if rng.random() > 0.05 else None))
    return rows


def every_window(rows, budget):
    """Every legal start of every answer, tried one by one."""
    out = set()
    for conv in {r[0] for r in rows}:
        talk = [(r[2], len((r[3] or "").split())) for r in rows if r[0] == conv]
        first = next((i for i, (role, _) in enumerate(talk) if role not in ("system", "developer")), None)
        for t, (role, n) in enumerate(talk):
            if role != "assistant" or first is None:
                continue
            starts = [first] + [i + 1 for i in range(first, t) if talk[i][0] == "assistant"]
            found = []
            for s in starts:
                prompt = sum(m + 2 for _, m in talk[:first]) + sum(m + 2 for _, m in talk[s:t]) + 1
                full = prompt - 1 + n + 2
                fits = prompt <= budget.max_input and full <= budget.max_length and n <= budget.max_output
                found.append((conv, t, len(starts), s, prompt, full, fits))
            out |= {w for w in found if w[-1]} or {found[-1]}
    return out


@pytest.mark.parametrize("budget", [Budget(40, 6), Budget(17, 5), Budget(400, 50)])
def test_candidates_match_every_window(spark, budget):
    rows = conversations(budget.max_length)
    got = candidate_windows(spark.createDataFrame(rows, TURNS), budget).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == every_window(rows, budget)


def test_candidates_of_empty_tables_and_bare_heads(spark):
    assert candidate_windows(spark.createDataFrame([], TURNS), Budget(40, 6)).collect() == []
    assert candidate_windows(spark.createDataFrame([(1, 0, "system", "a")], TURNS), Budget(40, 6)).collect() == []


@pytest.mark.parametrize("start, eps", [(0.0, 0.3), (0.45, 2.0), (1.0, 0.1)])
def test_margin_over_a_rising_run(spark, start, eps):
    """A run in which every row is a new maximum, one with nulls and one that never improves."""
    rows = [(1, k, 0.1 * k) for k in range(400)] + [(2, k, None if k % 3 == 0 else float(k)) for k in range(20)] + [(3, k, 5.0 - k) for k in range(20)]
    got = S.threshold_update(spark.createDataFrame(rows, "run long, step long, loss double"), "run", "step", "loss", start=start, eps=eps, width=16)
    want = {}
    for run in (1, 2, 3):
        mark, hits = None, 0
        for _, step, loss in [r for r in rows if r[0] == run]:
            if loss is not None and mark is None:
                mark = loss
            elif loss is not None and loss >= mark + eps:
                mark, hits = loss, hits + 1
            want[run, step] = pytest.approx(min(1.0, start + 0.1 * hits))
    assert {(r.run, r.step): r.threshold for r in got.collect()} == want


def test_streamed_buffer_emits_changes_only(spark):
    rows = [(0, s, 100 + s) for s in range(60)] + [(0, 59, 159)]
    df = spark.createDataFrame(rows, "shard long, step long, item long")
    folder = sinks.work_dir(spark, "changes")
    for part in (F.col("step") < 20, (F.col("step") >= 20) & (F.col("step") < 25), F.col("step") >= 25):
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
    emitted = jobs.run_to_table(jobs.replay_stream(jobs.read_stream(spark, folder, df.schema, files=1), 10, salts=1), "changes").collect()
    held, entered = set(), 0
    for change, sign in ((c, c.change) for c in sorted(emitted, key=lambda c: (-c.change, c.step))):
        entered += sign > 0
        (held.add if sign > 0 else held.discard)((change.step, change.item))
    assert held == {(s, 100 + s) for s in range(50, 60)}
    # Ten rows of each batch, at most, came in; whatever came in and is not held has left.
    assert entered <= 30 and len(emitted) == 2 * entered - 10
