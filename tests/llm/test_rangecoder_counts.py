"""Work per step of the range coder."""

import zlib

import numpy as np

from turnloom.llm import rangecoder


#: Of the coder before its steps were made cheaper.
EXPECTED = (44291, 2367618125, 668325591)


def sample(n=60_000):
    r = np.random.default_rng(3)
    return np.where(r.random(n) < 0.5, (np.arange(n) * 7) % 900, (r.random(n) ** 4 * 50_000).astype(np.int64)).astype("<u4")


def test_words_stay_those_of_files_already_written():
    ids = sample()
    words, per_lane = rangecoder.encode(ids, 50_257, lanes=64)
    assert (len(words), zlib.crc32(words.astype("<u2").tobytes()), zlib.crc32(per_lane.astype("<u4").tobytes())) == EXPECTED
    assert (rangecoder.decode(words, per_lane, len(ids), 50_257) == ids).all()


def test_the_alphabet_is_counted_when_it_is_read_only():
    """Counting has the length of the alphabet, so it is done once for the steps between two refreshes."""
    model, before = rangecoder._Model(50_257, 8), None
    for step in range(9):
        model.look()
        if step % rangecoder._REFRESH:
            assert (model.counts == before).all()
        else:
            assert model.counts.sum() == 50_257 + 8 * step * rangecoder._GAIN
        before = model.counts.copy()
        x = np.arange(8) * (step + 1)
        model.interval(x)
        model.learn(x)
