"""Prefix trees in token ids, and the search over several groups and buckets."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from turnloom.llm import chattree, topk

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_of_shared_turns_are_emitted_once(spark):
    r, rows = random.Random(4), []
    for c in range(30):
        for t in range(r.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say <|endoftext|> {r.randrange(2)}  é\n"))
    rows += [(None, 0, "user", None), (50, 0, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments, runs, paths = chattree.prefix_trees(turns, BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    layout = sorted(segments.collect(), key=lambda s: s.place)
    ids = [i for s in layout for i in np.frombuffer(s.ids, np.uint32).tolist()]
    assert [s.place for s in layout] == np.cumsum([0] + [s["size"] for s in layout])[:-1].tolist()
    own = {}
    for c, _, role, text in rows:
        own.setdefault(c, []).append(chattree.format_turn(role or "", text or "")[0])
    whole = {c: [i for turn in turns for i in library.encode(turn, add_special_tokens=False).ids] for c, turns in own.items()}
    assert len(ids) < sum(map(len, whole.values()))
    places = sorted(x.place for x in runs.collect())
    ends = dict(zip(places, [*places[1:], len(ids)]))
    digests = chattree.read_back(segments, paths)
    got = {x.conv_id: x for x in chattree.with_layout(digests, runs).collect()}
    assert got.keys() == whole.keys() and digests.count() == len(got)
    seen = 0
    for c, x in got.items():
        if x.run_place is None:
            assert any(other != c and "".join(own[other]).startswith("".join(own[c])) for other in own)
            continue
        above = [tuple(map(int, s.split("-"))) for s in x.attends.split()]
        assert [i for a, b in above for i in ids[a:b]] + ids[x.run_place : ends[x.run_place]] == whole[c]
        assert x.run_position == sum(b - a for a, b in above)
        seen += bool(above)
    assert seen


def test_search_over_many_groups_and_buckets(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(900, 6)), 2)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000 + i, [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, every=2, k=4, block_rows=32, group_rows=300, bucket_blocks=5).collect()
    want = set()
    by_size = {}
    for i, v in rows:
        by_size.setdefault(len(v), []).append((i, np.floor(256 * np.array(v)).astype(int)))
    for same in by_size.values():
        for i, v in same:
            if i % 2 == 0:
                ranked = sorted((-int(v @ w), j) for j, w in same if j != i)[:4]
                want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
