"""Divergences, folds, routing, batches and text metrics against plain Python."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turnloom.config import BatchSpec
from turnloom.functions import arrays as A
from turnloom.functions import rouge as R
from turnloom.operators import batches as B
from turnloom.operators import divergence as D
from turnloom.operators import evaluate as E
from turnloom.operators import folds as S
from turnloom.operators import sampling as Q
from turnloom.sources import sinks

# --- divergences ---------------------------------------------------------------------


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def kl(p, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log(p) - np.log(q)), 0.0).sum()


def numpy_scores(zs, zt, target, mask, tau):
    s, t = softmax(zs), softmax(zt)
    with np.errstate(divide="ignore", invalid="ignore"):
        ls, lt = np.log(s), np.log(t)
        inf_s = np.isinf(zs)
        inf = inf_s | np.isinf(zt)
        fkl = -np.where(inf_s, 0, t * ls).sum()
        rkl = np.where(inf, 0, s * (ls - lt)).sum()
        m, sm = 0.1 * t + 0.9 * s, 0.9 * t + 0.1 * s
        js = 0.9 * np.where(inf, 0, s * (ls - np.log(m))).sum() + 0.1 * np.where(inf, 0, t * (lt - np.log(m))).sum()
        head = np.cumsum(np.sort(t)) >= 0.5
        gap = np.abs(t - s)
        hw = (head * gap).sum() / gap.sum()
        ts, tt = softmax(zs / tau), softmax(zt / tau)
        mixed = softmax(0.6 * zs + 0.4 * zt) if not inf.any() else None
        off = np.zeros_like(zs)
        off[target] = 1000.0
        two = lambda p: np.array([p[target], p.sum() - p[target]])
        dkd = kl(two(t), two(s)) + 0.5 * kl(softmax(zt - off), softmax(zs - off))
        return {
            "fkl": fkl, "rkl": rkl, "tvd": 0.5 * np.where(inf, 0, gap).sum(), "js": js,
            "adaptive_kl": hw * fkl + (1 - hw) * rkl,
            "sfkl": -np.where(inf, 0, t * np.log(m)).sum(), "srkl": np.where(inf, 0, s * (ls - np.log(sm))).sum(),
            "ctkd": -tau * tau * np.where(inf_s, 0, tt * np.log(ts)).sum(),
            "interp": None if mixed is None else -(mixed * ls).sum(),
            "lm": -ls[target] if mask else None, "dkd": dkd * mask,
        }


def logit_rows(seed, n, vocab=11):
    rng = np.random.default_rng(seed)
    return [
        (0, p, (3 * rng.normal(size=vocab)).tolist(), (3 * rng.normal(size=vocab)).tolist(), int(rng.choice([-100, *range(vocab)])))
        for p in range(n)
    ]


SCHEMA = "sample_id long, pos int, student array<double>, teacher array<double>, label int"


@pytest.mark.parametrize("engine", ["arrow", "expression"])
def test_all_divergences_match_numpy(spark, engine):
    rows = logit_rows(0, 12)
    tau = D.default_temperature()
    per = []
    for a, b in zip(rows, rows[1:]):
        mask = int(b[4] != -100)
        per.append((mask, numpy_scores(np.array(a[2]), np.array(a[3]), b[4] if mask else 0, mask, tau)))
    got = D.divergence_all(spark.createDataFrame(rows, SCHEMA), engine=engine).first().asDict()
    for kind in D.KINDS:
        values = [(m, v[kind]) for m, v in per]
        if kind == "dkd":
            want = sum(v for _, v in values) / len(values)
        else:
            want = sum(v for m, v in values if m) / sum(m for m, _ in values)
        assert got[kind] == pytest.approx(want, rel=1e-9), kind
    one = D.divergence(spark.createDataFrame(rows, SCHEMA), "js", engine=engine).first().value
    assert one == pytest.approx(got["js"], rel=1e-12)


@pytest.mark.parametrize("engine", ["arrow", "expression"])
def test_infinite_logits_count_as_zero(spark, engine):
    rows = logit_rows(1, 3)
    rows[0][2][4] = -math.inf
    rows[1][3][2] = -math.inf
    rows = [(*r[:4], 3) for r in rows]
    got = D.score_positions(spark.createDataFrame(rows, SCHEMA), {k: {} for k in ("fkl", "rkl", "tvd", "js", "sfkl", "srkl")}, engine=engine).orderBy("pos").collect()
    for row, r in zip(got, rows):
        want = numpy_scores(np.array(r[2]), np.array(r[3]), 3, 1, 2.0)
        for kind in ("fkl", "rkl", "tvd", "js", "sfkl", "srkl"):
            assert row[kind] == pytest.approx(want[kind], rel=1e-9), kind


def test_all_masked_is_null_and_unknown_kind_fails(spark):
    rows = [(*r[:4], -100) for r in logit_rows(2, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert D.divergence(df, "fkl").first().value is None
    with pytest.raises(NotImplementedError):
        D.divergence(df, "nope")
    out = D.combine(spark.createDataFrame(logit_rows(3, 6), SCHEMA), "sft").first()
    assert out.loss == out.lm_loss and out.distil_loss is None


def test_identical_sides_have_no_divergence(spark):
    rows = [(s, p, z, z, 1) for s, p, z, _, _ in logit_rows(4, 5)]
    got = D.divergence_all(spark.createDataFrame(rows, SCHEMA)).first()
    for kind in ("rkl", "tvd", "js", "srkl", "dkd"):
        assert got[kind] == pytest.approx(0.0, abs=1e-12)


# --- folds ---------------------------------------------------------------------------


def run_rows(seed, runs=4, n=90):
    rng = random.Random(seed)
    return [(r, k, n, round(rng.uniform(0.5, 9.0), 3), rng.random()) for r in range(runs) for k in range(n + 7 * r)]


RUN = "run long, step long, total long, loss double, r double"


@pytest.mark.parametrize("width", [7, 16_384])
@pytest.mark.parametrize("adaptive", [True, False])
def test_schedule_matches_a_loop(spark, width, adaptive):
    rows = run_rows(1)
    rows[5] = (*rows[5][:3], math.inf, rows[5][4])
    want = {}
    for run in {r[0] for r in rows}:
        t, m, prev = 0.4, 0.0, math.inf
        for _, step, total, loss, _ in [r for r in rows if r[0] == run]:
            delta = None
            if not math.isinf(prev):
                m = 0.9 * m + 0.1 * ((prev - loss) / (prev + 1e-15))
                gain = 0.05 / (1 + math.exp(-m))
                target = 0.4 + 0.6 * step / total
                delta = gain * (1 - t)
                t = min(1.0, max(target, t + delta)) if adaptive else target
            prev = loss
            want[run, step] = (t, m, delta)
    df = S.interp_schedule(spark.createDataFrame(rows, RUN), alpha=0.05, beta=0.9, adaptive=adaptive, width=width)
    got = {(r.run, r.step): (r.t, r.momentum, r.delta_t) for r in df.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9, nan_ok=True), k


@pytest.mark.parametrize("eps", [0.0, 0.4])
def test_threshold_matches_a_loop(spark, eps):
    rows = run_rows(2, n=40)
    want = {}
    for run in {r[0] for r in rows}:
        prev, threshold = None, 0.0
        for _, step, _, loss, _ in [r for r in rows if r[0] == run]:
            if prev is None:
                prev = loss
            elif loss >= prev + eps:
                threshold, prev = min(threshold + 0.1, 1.0), loss
            want[run, step] = threshold
    got = S.threshold_update(spark.createDataFrame(rows, RUN), "run", "step", "loss", eps=eps, width=9).collect()
    assert {(r.run, r.step): pytest.approx(r.threshold) for r in got} == want


@pytest.mark.parametrize("sampling, ratio", [("adaptive", "constant"), ("adaptive", "increasing"), ("adaptive", "decreasing"), ("mixed", "constant")])
def test_routes_match_a_loop(spark, sampling, ratio):
    rows = run_rows(3, n=60)
    share = {"constant": lambda s, t: 0.5, "increasing": lambda s, t: s / t, "decreasing": lambda s, t: 1 - s / t}[ratio]
    want = {}
    for run in {r[0] for r in rows}:
        stored = 0
        for _, step, total, _, r in [x for x in rows if x[0] == run]:
            before, vision, active = stored, step % 9 == 4, step % 11 != 5
            limit = 0.6 if sampling == "adaptive" else 0.5
            if not active:
                route = "data"
            elif vision and r < limit:
                route = "fresh"
            elif sampling == "mixed" and r < 0.5:
                route, stored = "mixed", min(100, stored + 8)
            elif sampling == "adaptive" and (r < 0.6 * share(step, total) or (r < 0.6 and stored < 100)):
                route, stored = "fresh", min(100, stored + 8)
            elif sampling == "adaptive" and r < 0.6:
                route = "replay"
            else:
                route = "teacher" if r < 0.8 else "data"
            want[run, step] = (before, route)
    got = Q.sample_route(
        spark.createDataFrame(rows, RUN), threshold=0.6, sampling=sampling, ratio=ratio, capacity=100, width=13,
        training=F.col("step") % 11 != 5, multimodal=F.col("step") % 9 == 4, model_ratio=0.8, teacher_draw="r",
    ).collect()
    assert {(r.run, r.step): (r.stored, r.route) for r in got} == want


def test_cosine_curriculum(spark):
    df = spark.createDataFrame([(e,) for e in (-3, 0, 5, 10, 40)], "e int")
    got = [r.v for r in df.select(S.cosine_curriculum(F.col("e"), 2.0, 1.0, 10).alias("v")).collect()]
    assert got == pytest.approx([2.0, 2.0, 1.5, 1.0, 1.0])


# --- split and batches ---------------------------------------------------------------


@pytest.mark.parametrize("n, size, ratio, want", [(2, 2000, 0.02, 1), (100, 2000, 0.02, 99), (100, 7, 0.02, 7), (100, 0, 0.02, 2), (30, 0, 0.02, 1), (5, -1, 0.9, 4)])
def test_split_sizes(spark, n, size, ratio, want):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = B.split_exact(df, "k", size, ratio).collect()
    test = {r.k for r in got if r.split == "test"}
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert len(got) == n and test == set(order[:want])


def test_split_needs_two_rows(spark):
    with pytest.raises(Exception, match="at least 2"):
        B.split_exact(spark.range(1), "id", 5).collect()


@pytest.mark.parametrize("seed", [42, None])
def test_batches(spark, seed):
    df = spark.range(1000, 1103).withColumnRenamed("id", "k")
    got = B.batch_ids(df, "k", 10, seed).collect()
    order = sorted(range(1000, 1103), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i)) if seed else list(range(1000, 1103))
    assert {r.k: (r.batch_id, r.slot) for r in got} == {k: (i // 10, i % 10) for i, k in enumerate(order[:100])}
    assert B.batch_ids(df, "k", 10, seed, drop_last=False).count() == 103
    assert B.limit_batches(B.batch_ids(df, "k", 10, seed), 0.35).agg(F.max("batch_id")).first()[0] == 2


def test_array_edges(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    r = df.select(
        A.tail(F.col("a"), 5).alias("t5"), A.tail(F.col("a"), 2).alias("t2"), A.tail(F.col("a"), 0).alias("t0"),
        A.pad_right(F.col("a"), 2, 9).alias("r"), A.pad_left(F.col("a"), 4, 9).alias("l"),
        A.cut_generated(F.col("a"), F.lit(4)).alias("c"),
    ).collect()
    assert r[0].asDict() == {"t5": [1, 2, 3], "t2": [2, 3], "t0": [], "r": [1, 2], "l": [9, 1, 2, 3], "c": []}
    assert r[1].asDict() == {"t5": [], "t2": [], "t0": [], "r": [9, 9], "l": [9, 9, 9, 9], "c": []}


def test_best_step_prefers_the_earliest_of_equals(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 5.0), (1, 3, 5.0), (2, 1, 1.0)], "run int, step int, score double")
    assert sorted(tuple(r) for r in B.best_step(df, "run", "step", "score").collect()) == [(1, 2, 5.0), (2, 1, 1.0)]


def test_chunks_are_written_and_read_per_split(spark):
    rows = [(f"s{i}", "test" if i % 10 == 0 else "train", list(range(200)), list(range(200)), [1, 2], "x" * 50) for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id string, split string, input_ids array<int>, labels array<int>, prompt_ids array<int>, response string")
    path = sinks.work_dir(spark, "chunks")
    sinks.write_chunks(df.repartition(16), path, "20KB")
    back = sinks.read_prepared(spark, path, "test")
    assert back.count() == 40 and sinks.read_prepared(spark, path).count() == 400
    local = path.removeprefix("file://")
    files = {s: len([f for f in os.listdir(f"{local}/split={s}") if f.endswith(".parquet")]) for s in ("train", "test")}
    assert files["train"] > files["test"] >= 1


def test_chunk_sizes_without_a_session_setting(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    noise = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(50_000)).cast("int"))
    split = F.when(F.col("id") % 10 == 0, "test").when(F.col("id") % 10 < 9, "train")
    df = spark.range(6000).repartition(5).select(F.col("id").cast("string").alias("sample_id"), split.alias("split"), noise.alias("input_ids"))
    path = sinks.work_dir(spark, "sized")
    sinks.write_chunks(df, path, "600KB")
    assert spark.conf.get(name, None) == before
    sizes = {}
    for folder in ("split=train", "split=test", "split=__HIVE_DEFAULT_PARTITION__"):
        local = f"{path.removeprefix('file://').removeprefix('file:')}/{folder}"
        sizes[folder] = [pq.ParquetFile(f"{local}/{f}").read().nbytes for f in os.listdir(local) if f.endswith(".parquet")]
    # 4,800 and twice 600 rows of about 2,010 bytes.
    assert {k: len(v) for k, v in sizes.items()} == {"split=train": 17, "split=test": 3, "split=__HIVE_DEFAULT_PARTITION__": 3}
    assert all(0.9 * 600_000 < x < 1.1 * 600_000 for x in sizes["split=train"])
    assert all(max(v) < 1.1 * min(v) for v in sizes.values())
    back = spark.read.parquet(path)
    assert back.count() == 6000 and back.select("sample_id").distinct().count() == 6000
    assert back.exceptAll(df.select(*back.columns)).count() == 0


def test_chunks_of_an_empty_table_and_of_equal_rows(spark):
    path = sinks.work_dir(spark, "odd")
    same = spark.range(3000).select(F.lit("one").alias("sample_id"), F.lit("train").alias("split"))
    sinks.write_chunks(same, path, 1000)
    assert spark.read.parquet(path).count() == 3000
    sinks.write_chunks(same.limit(0), sinks.work_dir(spark, "odd"), 1000)


# --- text metrics --------------------------------------------------------------------


def test_porter_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
        "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall",
        "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
        "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formality": "formal", "triplicate": "triplic",
        "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustable": "adjust", "replacement": "replac",
        "adoption": "adopt", "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
        "controlling": "control", "rolling": "roll", "dying": "die", "news": "news", "enjoy": "enjoy", "geology": "geolog",
    }
    assert {w: R.stem(w) for w in known} == known


def test_lcs_against_dynamic_programming():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert R.lcs_length(a, b) == row[-1]


def test_metrics(spark):
    df = spark.createDataFrame(
        [("The cat, sat!", "the cat sat"), ("Running dogs", "run dog quickly"), ("", "x"), ("a b", "a b")], "pred string, target string"
    )
    got = E.eval_metrics(df).first()
    # Second pair: stems run/dog against run/dog/quickli, so P = 1 and R = 2/3.
    assert got.exact_match == pytest.approx(50.0) and got.rougeL == pytest.approx(100 * (1 + 0.8 + 0 + 1) / 4)
    with pytest.raises(Exception, match="counts differ"):
        E.eval_metrics(spark.createDataFrame([("a", None)], "pred string, target string")).collect()


def test_eval_by_set_names(spark):
    pairs = spark.createDataFrame([(0, "a", "a"), (0, "a", "b")], "eval_set int, pred string, target string")
    losses = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "eval_set int, loss double")
    got = {r.name: r.value for r in E.eval_by_set(pairs, losses).collect()}
    assert got == {"val_0/loss": 2.0, "val_0/exact_match": 50.0, "val_0/rougeL": 50.0, "val_1/loss": 5.0}


def explained(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _logit_rows(samples: int, positions: int) -> list[tuple]:
    rng = np.random.default_rng(3)
    return [
        (s, p, rng.normal(size=6).tolist(), rng.normal(size=6).tolist(), -100 if p < 2 else int(rng.integers(6)))
        for s in range(samples) for p in range(positions)
    ]


LOGITS = "sample_id long, pos int, student array<double>, teacher array<double>, label int"


@pytest.mark.parametrize("order", ["logged", "shuffled"])
def test_recorded_logits_give_every_measure_without_a_join(spark, order):
    rows = _logit_rows(7, 30)
    if order == "shuffled":
        np.random.default_rng(0).shuffle(rows := np.array(rows, dtype=object))
        rows = [tuple(r) for r in rows.tolist()]
    # A gap and a sample of one position: neither has a next position.
    rows = [r for r in rows if r[:2] != (3, 12)] + [(99, 0, [0.0] * 6, [1.0] * 6, 2), (None, 5, [0.0] * 6, [1.0] * 6, 2)]
    df = spark.createDataFrame(rows, LOGITS).coalesce(3)
    stored = D.record(df)
    keys = {(r.sample_id, r.pos): (r.next_label, r.mask) for r in stored.collect()}
    labels = {(r[0], r[1]): r[4] for r in rows}
    assert keys == {(s, p): (labels[s, p + 1], int(labels[s, p + 1] != -100)) for s, p in labels if (s, p + 1) in labels and s is not None}
    result = D.divergence_all(stored, by=("sample_id",))
    assert "Exchange" in explained(result)
    for node in re.findall(r"Exchange\n.*?(?=\n\n)", explained(result), flags=re.S):
        assert "student" not in node and "teacher" not in node
    want = {r.sample_id: r for r in D.divergence_all(df, by=("sample_id",)).collect()}
    got = {r.sample_id: r for r in result.collect()}
    assert got.keys() == want.keys()
    for key, row in got.items():
        assert np.allclose([row[k] for k in D.KINDS], [want[key][k] for k in D.KINDS])


def test_logged_rows_are_paired_inside_their_task():
    batch = pa.RecordBatch.from_pylist([{"sample_id": s, "pos": p, "label": 10 * s + p} for s in (1, 2) for p in range(5)])
    out = pa.Table.from_batches(D._hand_over(iter([batch.slice(0, 3), batch.slice(3, 0), batch.slice(3, 1), batch.slice(4)]))).to_pylist()
    assert [r["label"] for r in out] == [10 * s + p for s in (1, 2) for p in range(5)]
    assert [(r["sample_id"], r["pos"]) for r in out if r["open"]] == [(1, 4), (2, 4)]
    assert all(r["next_label"] == r["label"] + 1 for r in out if not r["open"])
    assert list(D._hand_over(iter([]))) == []


def test_collate_with_given_masks_types_and_media(spark):
    rows = [
        (0, 1, [5, 6], [5, 6], [5], "b", [1, 1], [0, 2], [1], None, [[1.5, 2.0], [3.0, 4.0]]),
        (0, 0, [7, 8, 9], [7, 8, 9], [7, 8], "a", None, [1, 1, 1], [0, 1], [2, 2], None),
        (1, 0, [4], [4], [], "c", [], [2], [], [], []),
    ]
    names = "input_ids array<int>, labels array<int>, prompt_ids array<int>, response string, attention_mask array<int>, mm_token_type_ids array<int>"
    sides = "prompt_attention_mask array<int>, prompt_mm_token_type_ids array<int>, pixel_values array<array<double>>"
    df = spark.createDataFrame(rows, f"batch_id long, slot int, {names}, {sides}")
    out = {r.batch_id: r for r in B.collate(df, BatchSpec(max_input=2, max_output=2)).collect()}
    first, gen = out[0].model_inputs, out[0].model_inputs_gen
    assert first.input_ids == [[7, 8, 9, 0], [5, 6, 0, 0]]
    assert first.attention_mask == [[0, 0, 0, 0], [1, 1, 0, 0]]
    assert first.mm_token_type_ids == [[1, 1, 1, 0], [0, 2, 0, 0]]
    assert first.pixel_values == [[1.5, 2.0], [3.0, 4.0]] and first.pixel_values_offsets == [0, 0, 2]
    assert gen.attention_mask == [[0, 1], [0, 1]] and gen.mm_token_type_ids == [[2, 2], [0, 0]] and gen.response == ["a", "b"]
    assert out[1].model_inputs.pixel_values == [] and out[1].model_inputs.pixel_values_offsets == [0, 0]
    bare = B.collate(df.select(*df.columns[:6]), BatchSpec(max_input=2, max_output=2)).where("batch_id = 0").first()
    assert bare.model_inputs.attention_mask == [[1, 1, 1, 0], [1, 1, 0, 0]]
