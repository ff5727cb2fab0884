"""The mixture of the three orders: it tiles the unit, and its cost is the one a plain sequential model gives."""

import numpy as np
import pytest

from turnloom.llm import rangecoder


def trained(alphabet: int, lanes: int, steps: int) -> rangecoder._Model:
    model, g = rangecoder._Model(alphabet, lanes), np.random.default_rng(2)
    for _ in range(steps):
        model.look()
        ids = np.where(g.random(lanes) < 0.6, (model.last * 7 + 3) % alphabet, g.integers(0, alphabet, lanes))
        model.interval(ids)
        model.learn(ids)
    model.look()
    return model


def test_intervals_tile_the_unit_and_find_inverts_them():
    model = trained(37, 9, 40)
    end = np.zeros(9, np.int64)
    for i in range(37):
        ids = np.full(9, i)
        start, width = model.interval(ids)
        assert (start == end).all() and (width > 0).all()
        for value in (start, start + width - 1, start + width // 2):
            assert (model.find(value) == i).all()
        end = start + width
    assert (end == model.unit).all()


def test_probabilities_are_weighted_sums_of_the_orders():
    model = trained(50, 16, 60)
    weights = np.maximum(1, model.credit * rangecoder._WEIGHT_UNIT // model.credit.sum(axis=1, keepdims=True))
    for i in range(50):
        _, width = model.interval(np.full(16, i))
        for lane in range(16):
            w = weights[model.context[lane]]
            p = w[0] * (model.cumulative[i + 1] - model.cumulative[i]) / model.total + w[1] * (model.guess1[lane] == i) + w[2] * (model.guess2[lane] == i)
            assert width[lane] / model.unit[lane] == pytest.approx(p / w.sum(), rel=1e-12)


def test_repeated_passages_cost_less_than_their_entropy():
    g = np.random.default_rng(5)
    passage = g.integers(0, 2000, 3000)
    ids = np.concatenate([passage] * 20)
    words, per_lane = rangecoder.encode(ids, 2000)
    assert (rangecoder.decode(words, per_lane, len(ids), 2000) == ids).all()
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert 16 * len(words) < 0.75 * len(ids) * -(p * np.log2(p)).sum()


@pytest.mark.parametrize("alphabet, count", [(1, 3000), (2, 5000), (50000, 20000)])
def test_counts_past_their_limit_and_odd_alphabets(alphabet, count, monkeypatch):
    monkeypatch.setattr(rangecoder, "_COUNT_LIMIT", 3 * alphabet)
    ids = np.random.default_rng(8).integers(0, alphabet, count)
    words, per_lane = rangecoder.encode(ids, alphabet)
    assert (rangecoder.decode(words, per_lane, count, alphabet) == ids).all()
