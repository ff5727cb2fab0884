"""Ids of whole batches against the tokenizers library."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from turnloom.llm import bpe

ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "plain words here", "Straße ΣΑΣ İstanbul ΟΔΟΣ*** Café", "tab\there",
    "nbsp\xa0here", "sep\x1chere", "end. (word) word*** word's don't it's' a'b \"quoted\" x--- 12,5 a1b2 e=mc^2 $$$ ### <b>bold</b> a_b_ [x] {y}",
    "<|im_end|> special", "<unk> <s> <pad>", "日本語 テスト。 naïve coöp", "😀 smile 😀😀", "word​join word́***", "x" * 3000 + " y", "<" * 5,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("rows", [[], [None], ["", None], ODD, ODD[::-1] * 3, ["\x1c"], ["ab ab ab"]])
def test_batches_equal_the_library(name, rows):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    for texts in (pa.array(rows, pa.string()), pa.array(["before", *rows, "after"], pa.string()).slice(1, len(rows))):
        ids, starts = own.batch(texts)
        assert len(starts) == len(rows) + 1 and starts[0] == 0 and starts[-1] == len(ids)
        for text, a, b in zip(rows, starts, starts[1:]):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids[a:b].tolist() == want == np.frombuffer(own(text or ""), "<u4").tolist()


def test_equal_pieces_of_a_batch_are_looked_up_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, seen = bpe.Encoder(path), []

    class Counted(dict):
        def __getitem__(self, piece):
            seen.append(piece)
            return b"\1\0\0\0"

    own.bare = Counted()
    ids, starts = own.batch(pa.array(["one two one two one ", "two one " * 1000]))
    assert sorted(set(seen)) == ["one", "two"] and len(seen) == 2
    assert starts.tolist() == [0, 5, 2005] and set(ids.tolist()) == {1}
