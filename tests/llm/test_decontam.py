"""Decontamination against a plain search by edit distance, and texts made of repeats."""

import random
import time

import numpy as np
import pytest

from turnloom.llm import decontam


def plain(item, text, budget):
    """Fewest edits of ``item`` anywhere in ``text`` and the leftmost start, by the whole table."""
    row = [(0, j) for j in range(len(text) + 1)]
    for i, c in enumerate(item):
        new = [(i + 1, 0)]
        for j, d in enumerate(text):
            new.append(min((row[j][0] + (c != d), row[j][1]), (row[j + 1][0] + 1, row[j + 1][1]), (new[j][0] + 1, new[j][1])))
        row = new
    best = min(row)
    return best[0] if best[0] <= budget else None


def points(text):
    return decontam.normalised(text)[0]


def edited(r, text, edits):
    for _ in range(edits):
        at = r.randrange(len(text))
        text = r.choice([text[:at] + text[at + 1 :], text[:at] + r.choice("abcxyz ") + text[at:], text[:at] + r.choice("abcxyz") + text[at + 1 :]])
    return text


def test_equals_a_plain_search():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    items = [" ".join(word() for _ in range(r.randrange(4, 24))) for _ in range(25)] + ["ab" * 40, "the same line and more words", "the same line and other words"]
    texts = []
    for k in range(80):
        own = r.choice(items)
        budget = len(own) // 10
        texts.append(" ".join([*(word() for _ in range(r.randrange(30))), edited(r, own, r.choice([0, 1, budget // 2, budget, budget + 1, 3 * budget + 3])), *(word() for _ in range(r.randrange(30)))]))
    texts += ["", "ab" * 300, "the same line " * 40, *items[:3]]
    index = decontam.build_slice([(i, points(t)) for i, t in enumerate(items)], decontam.Q, decontam.EDIT_SHARE)
    got = decontam._found([points(t) for t in texts], index, decontam.Q)
    hits = 0
    for text, held in zip(texts, got):
        for i, item in enumerate(items):
            p, t = points(item), points(text)
            budget = int(index.edits[list(index.owner).index(i)])
            want = plain(p.tolist(), t.tolist(), budget)
            assert (want is None) == (i not in held), (item, text)
            if want is not None:
                edits, start, end = held[i]
                assert edits == want == plain(p.tolist(), t[start:end].tolist(), budget)
                hits += 1
    assert hits > 40


@pytest.mark.parametrize("held", [decontam.HELD, 500])
def test_repeats_of_a_shared_line_end_in_seconds(monkeypatch, held):
    monkeypatch.setattr(decontam, "HELD", held)
    r = random.Random(3)
    line = "Read the question below with care and answer it in at most one short full sentence. "
    n, repeats = (5000, 100) if held > 500 else (60, 20)
    items = [line + "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(80)) for _ in range(n)]
    index = decontam.build_slice([(i, points(t)) for i, t in enumerate(items)], decontam.Q, decontam.EDIT_SHARE)
    at = time.time()
    found = decontam._found([points(line * repeats), points(line * 3 + items[7] + line * 3)], index, decontam.Q)
    assert found[0] == {} and set(found[1]) == {7} and found[1][7][0] == 0
    assert time.time() - at < 60


def test_index_is_built_by_tasks_in_slices(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(12))) for i in range(40)]
    bench = spark.createDataFrame([*items, (90, None), (91, "  ")], "item_id long, text string")
    rows = [(i, f"before {t} after") for i, t in items[::3]] + [(500, None), (501, ""), (501, ""), (502, "clean words only")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, item_id string")
    monkeypatch.setattr(decontam, "SLICE_CHARS", 900)
    assert len(decontam.build_index(bench, "item_id", "text", decontam.Q, decontam.EDIT_SHARE).names) > 2
    got = {(x.doc_id, x.item_id, x.edits) for x in decontam.leaks(docs, bench).collect()}
    assert got == {(i, i, 0) for i, _ in items[::3]}
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == [500, 501, 501, 502]
    assert decontam.clean(docs, bench.where("false")).count() == len(rows)


def test_alignment_stays_in_its_band():
    index = decontam.build_slice([(0, points("abcdefghij" * 4))], decontam.Q, decontam.EDIT_SHARE)
    text = points("xx" + "abcdefghij" * 2 + "Z" + "abcdefghij" * 2 + "yy")
    hit, none = decontam._alignments(index, [decontam.Candidate(0, text, -2, 6), decontam.Candidate(0, text, 20, 24)])
    assert hit == (1, 2, 43) and none is None
    assert isinstance(np.asarray(hit), np.ndarray)
