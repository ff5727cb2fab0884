"""Places of order 0 are found by slots of the table: nothing is sorted or searched but what lies behind a slot's first id."""

import numpy as np
import pytest

from turnloom.llm import rangecoder


@pytest.mark.parametrize("bits", [0, 3, 16])
@pytest.mark.parametrize("alphabet", [1, 5, 3000])
def test_every_place_has_its_id(alphabet, bits, monkeypatch):
    monkeypatch.setattr(rangecoder, "_SLOT_BITS", bits)
    model = rangecoder._Model(alphabet, 4)
    for _ in range(9):
        model.look()
        ids = np.random.default_rng(1).integers(0, alphabet, 4) // 2
        model.interval(ids)
        model.learn(ids)
    places = np.random.default_rng(2).permutation(model.total)
    assert (model._placed(places) == np.searchsorted(model.cumulative, places, side="right") - 1).all()


def test_frequent_ids_are_not_searched(monkeypatch):
    model = rangecoder._Model(50_000, 2000)
    for _ in range(9):
        model.look()
        ids = np.arange(2000) % 20
        model.interval(ids)
        model.learn(ids)
    place = np.repeat(model.cumulative[:20], 100) + 600
    sought, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **more: (sought.append(len(v)), search(a, v, *rest, **more))[1])
    assert (model._placed(place) == np.repeat(np.arange(20), 100)).all() and not sum(sought)
