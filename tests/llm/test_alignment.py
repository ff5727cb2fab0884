"""Two tokenizers aligned over bytes: groups, links and corpus counts against plain Python; fragments as a monoid."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from turnloom.llm import alignment, cuts
from turnloom.llm.bpe import _byte_letters
from turnloom.llm.catalog import BYTE_BPE, PIECE_BPE

A = Tokenizer.from_file(BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
BYTE = {letter: code for code, letter in _byte_letters().items()}
ODD = ["a", "the", "  ", " ", "\n", "\t", "\r\n", "1", "22", "!", "é", "中", "😀", "<|endoftext|>", "<s>", " ", "\x1c", "\x00", "hello", "world", "ing", "don't"]


def tokens(text):
    """(id, bytes) of A and of B, whole texts by the libraries; nothing where the bytes differ."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    data = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == data == b"".join(x for _, x in b) else ([], [])


def plain(texts):
    """The result per text, token by token."""
    found, counts = [], Counter()
    for text in texts:
        sides = []
        for side in tokens(text):
            at, ends = 0, {}
            for i, data in side:
                at += len(data)
                ends[at] = i
            sides.append(ends)
        a, b = sides
        both = sorted(set(a) & set(b))
        links = [(a[e], b[e]) for e in both]
        counts.update(links)
        groups = [[[side[e] for e in sorted(side) if low < e <= high] for side in sides] for low, high in zip([0, *both], both)]
        found.append((len(a), len(b), links, ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for n_a, n_b, links, text in found
    ]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(40))) for _ in range(n)]


TEXTS = [None, "", " ", "   ", "a ", "▁", "x▁ y", "same text", "same text", "z" * 3000, "é " * 500, *odd_texts(150, 5)]


def result(df):
    return sorted((r.doc_id, *r[1:]) for r in df.collect())


@pytest.mark.parametrize("size, fan, broadcast_pairs", [(alignment.RANGE, alignment.FAN, alignment.BROADCAST_PAIRS), (7, 2, 0), (64, 3, 10**9)])
def test_equals_plain_python(spark, size, fan, broadcast_pairs):
    texts = TEXTS + [" ".join(t or "" for t in odd_texts(400, 6))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, pair int").repartition(3)
    got = result(alignment.alignments(docs, BYTE_BPE, PIECE_BPE, size=size, fan=fan, broadcast_pairs=broadcast_pairs))
    assert got == sorted((i, *x) for i, x in enumerate(plain(texts)))


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "some words"), (1, "some words"), (None, "some words"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in alignment.alignments(docs, BYTE_BPE, PIECE_BPE).collect()]
    want = plain([t for _, t in rows])
    assert sorted(got, key=repr) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)
    assert alignment.alignments(docs.where("false"), BYTE_BPE, PIECE_BPE).count() == 0


def test_fragments_compose_in_any_order():
    parts = alignment.Parts(BYTE_BPE, PIECE_BPE)
    r = random.Random(9)
    for text in [t for t in odd_texts(60, 7) if tokens(t)[0]] + ["unbroken" * 40]:
        made = [alignment.fragment(parts, *x)[0] for x in alignment.ranges(text, 5)]
        whole = alignment.fragment(parts, text, 0, len(text.encode()) + 1)[0]
        assert any(f.pre_a and f.suf_a or not f.cut for f in made) or len(made) < 8
        while len(made) > 1:
            k = r.randrange(len(made) - 1)
            made[k : k + 2] = [made[k] * made[k + 1]]
        assert made[0].whole() == whole.whole() and made[0] * alignment.EMPTY == made[0] == alignment.EMPTY * made[0]


def test_ranges_cover_the_text_once():
    for text in odd_texts(50, 8) + ["a" * 100, "word " * 50]:
        spans = list(alignment.ranges(text, 6)) if text else []
        assert sum(high - low for _, low, high in spans) == len(text.encode()) + bool(text)
        assert all(part in text and 0 <= low <= high <= len(part.encode()) + 1 for part, low, high in spans)


def test_vocabulary_that_crosses_blanks_is_refused():
    assert cuts.starts_only(["▁a", "▁▁", "b"]) and not cuts.starts_only(["a▁b"])
