"""Spelling variants against all pairs of words in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import spelling


def near(a, b):
    """Exactly one edit, by trying them all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, form = [], {}
    links = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed, rows):
    """Words with one to three edits each, chains of frequencies, anagrams, accents and very long runs."""
    r = random.Random(seed)
    letters = "abcdeilnorstéüÿÀ"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(5, 10))) for _ in range(25)] + ["abcabcabc" * 9, "ÀÀÀÀÀÀ"]
    bag = []
    for w in base:
        weight = 200
        for _ in range(6):
            bag += [w] * max(1, weight)
            weight //= r.choice([2, 6, 8])
            at = r.randrange(len(w))
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :], "".join(r.sample(w, len(w)))])
    return [(r.choice([i, i, None]), r.choice([None, "", "Ärger 12"]) if i % 9 == 0 else " ".join(r.choice(bag).title() if r.random() < 0.2 else r.choice(bag) for _ in range(r.randrange(1, 120)))) for i in range(rows)]


@pytest.mark.parametrize("sample, block_chars", [(spelling.SAMPLE, spelling.BLOCK_CHARS), (40, 60), (500, 200)])
def test_equals_all_pairs(spark, monkeypatch, sample, block_chars):
    monkeypatch.setattr(spelling, "LEAF", 3)
    rows = corpus(3, 200)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows + rows[:20]], "doc_id long, text string, word string, n int").repartition(3)
    got = sorted(tuple(r) for r in spelling.variants(docs, sample=sample, block_chars=block_chars).collect())
    want = plain(rows + rows[:20])
    assert len(want) > 60 and any(x[1] for x in want) and any(x[2] not in (x[0], x[1]) for x in want)
    assert got == want


def test_planted_deletions_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "spelling") for i in range(2000)], "doc_id long, text string")
    rows = {r.word: r for r in spelling.variants(docs.withColumn("text", F.concat("text", F.lit(" Spelling")))).collect()}
    lost = [w for w in rows if len(w) == 7]
    assert sum(r.n for r in rows.values()) <= 4000 and all(rows[w].form == "spelling" == rows[w].root for w in lost)
    assert sorted((w, *tuple(r)[1:]) for w, r in rows.items()) == plain([(i, "spelling Spelling") for i in range(2000)])
    empty = spelling.variants(docs.where("false"))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 0


def test_cells_reach_every_near_vector():
    r = np.random.default_rng(2)
    x = r.integers(0, 4, (400, spelling.CLASSES)).astype(np.int32)
    x[:, 5:] = 0
    tree = spelling.Cells(x, 40)
    own = tree.own(x)
    assert tree.size > 20 and len(set(own.tolist())) == tree.size
    for up, down in ((1, 1), (1, 0), (0, 1)):
        row, cell = tree.reached(x, up, down)
        found = set(zip(row.tolist(), cell.tolist()))
        gap = x[None] - x[:, None]
        a, b = np.nonzero((np.maximum(0, gap).sum(axis=2) <= up) & (np.maximum(0, -gap).sum(axis=2) <= down))
        assert {(i, int(own[j])) for i, j in zip(a.tolist(), b.tolist())} <= found
        assert len(found) < 400 * tree.size


def test_one_edit():
    r = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(n)) for n in (4, r.choice([3, 4, 5])))
        got = spelling.one_edit(np.stack(spelling.points([a])), np.stack(spelling.points([b])))
        assert bool(got[0]) == near(a, b)
