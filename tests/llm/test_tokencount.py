"""Token counts by the whole-token shortcut against the libraries."""

import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from turnloom.llm import tokencount
from turnloom.llm.catalog import BYTE_BPE, PIECE_BPE

PARTS = ["a", "b", "the", "  ", " ", "\n", "\t", "\r\n", "'s", "'ll", "1", "22", "!", "...", "é", "ß", "<|endoftext|>", "<|endoftext|", "<s>", "▁", "中", "😀", " ", " ", "　", "\x85", "\x1c", "\x00", "İ", "́", "​", "½", "²", "٣", "�", "_", "hello", "world"]
TEXTS = [None, "", " ", "word ", "x" * 5000, "<|endoftext|>" * 3, "a <|endoftext|> b"]


def texts(n):
    r = random.Random(4)
    return TEXTS + ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(n)]


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [BYTE_BPE, PIECE_BPE])
def test_counts_equal_the_library(spark, path):
    rows = [(i, t, 5) for i, t in enumerate(texts(400))] + [(1, "again", 5), (1, "again", 5), (None, "no id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(repr, map(tuple, tokencount.token_counts(docs, path, limit=20).collect())))
    count = library(path)
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 20) for i, t, _ in rows]
    assert got == sorted(map(repr, want))
    assert tokencount.token_counts(docs.where("false"), path).count() == 0


@pytest.mark.parametrize("path", [BYTE_BPE, PIECE_BPE])
def test_parts_and_full_tables_change_nothing(path, monkeypatch):
    monkeypatch.setattr(tokencount, "PART", 7)
    monkeypatch.setattr(tokencount, "KEPT", 5)
    counter = tokencount.Pieces(path) if path.endswith(".model") else tokencount.ByteLevel(path)
    count = library(path)
    assert all(counter(t or "") == count(t or "") for t in texts(800))


def test_proven_strings_are_not_merged():
    counter = tokencount.ByteLevel(BYTE_BPE)
    proven = set(counter.counts.proven)
    assert len(proven) > 45_000 and " the" in proven and "�" not in proven - {"�"}
    count = library(BYTE_BPE)
    assert all(count(t) == 1 for t in proven)
    counter("the house and the houses")
    assert counter.counts.merged == sum(p not in proven for p in ["the", " house", " and", " the", " houses"])


def test_other_kinds_are_refused():
    from turnloom.llm.catalog import WORD_BPE

    with pytest.raises(ValueError):
        tokencount.ByteLevel(WORD_BPE)
