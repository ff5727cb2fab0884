"""Pieces of a byte-level vocabulary: told apart in arrays, new ones encoded many at once, those seen before not at all."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from turnloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Z", "é", "Ü", "ß", "×", "÷", "ñ", "Ā", "ж", "語", "。", "…", "’", "'", "'s", "'LL", "5", "٣", "²", "_", "-", ",", ".", "(", "\"", "<", "|", "😀", "́", "​", "᠎", "Ġ", "Ċ", "Ã"]


def rows(seed: int, count: int) -> list[str]:
    g = np.random.default_rng(seed)
    return ["".join(g.choice([*PARTS, *PARTS[:8], " ", " ", " ", "\n"], g.integers(1, 60))) for _ in range(count)]


@pytest.mark.parametrize("limit", [0, 50, 100_000])
def test_slices_after_one_another_equal_the_library(limit, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_PIECES", limit)
    monkeypatch.setattr(bpe, "_AT_ONCE", 37)
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    for seed in (1, 2, 1):
        texts = rows(seed, 400)
        ids, starts = own.batch(pa.array(texts))
        for text, a, b in zip(texts, starts, starts[1:]):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_new_words_are_encoded_together_and_known_ones_never(monkeypatch):
    own, met = bpe.Encoder(PATH), []
    monkeypatch.setattr(own.table, "encode", lambda pieces, new=own.table.encode: (met.extend(pieces.to_pylist()), new(pieces))[1])
    for one in ("_word", "_library", "_bare", "_spaced"):
        monkeypatch.setattr(own, one, lambda *_: pytest.fail("a piece by itself"))
    first = own.batch(pa.array(["start einen Wörter, einen dass", "Mehr Wörter."]))
    assert sorted(met) == sorted(["start", " einen", " Wörter", ",", " dass", "Mehr", "."])
    again = own.batch(pa.array(["start einen Wörter, einen dass", "Mehr Wörter."]))
    assert len(met) == 7 and all((a == b).all() for a, b in zip(first, again))


def test_the_table_is_bounded_by_bytes_too(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_BYTES", 10_000)
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    for k in range(30):
        text = " ".join(chr(0x4E00 + k) * 500 + str(i) for i in range(4))
        assert own.batch(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.table.names.nbytes < 20_000 and len(own.table.starts) == len(own.table.names) + 1
