"""Numbered operators against plain Python on small tables with nulls, empty texts, ties, repeated rows and odd columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm import bpe, chattree, decontam, maintext, neardup, packing, pii, rangecoder, tokenfiles, topk, toxicity, warc
from turnloom.llm.catalog import BYTE_BPE, WORD_BPE
from turnloom.llm.components import components

DOCS = "doc_id long, text string, id string, label int"


def docs(spark, rows):
    """Documents with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def texts(n, seed=3):
    r = random.Random(seed)
    return [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(r.randrange(40)) for _ in range(r.randrange(1, 120))) for _ in range(n)]


def test_warc_round_trip(spark):
    rows = [(3, "u", "same"), (1, "u\r\nx é", "same"), (2, None, None), (7, "u", ""), (None, "u", "same"), (9, "u", "é" * 200_000), (8, "u", "é" * 200_000), (5, "u", "one"), (5, "u", "one")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, chunk int")
    got = sorted(map(repr, (tuple(r) for r in warc.round_trip(pages).collect())))
    payload = [(i, (t or "").encode()) for i, _, t in rows]
    want = []
    for i, p in payload:
        first = min((j for j, q in payload if q == p and j is not None), default=None)
        other = i is not None and first != i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if other else "response", first if other else None))
    assert got == sorted(map(repr, want))
    assert warc.round_trip(pages.where("false")).count() == 0
    small = {r.page_id: r.record_type for r in warc.round_trip(pages.where("page_id IN (1, 3)"), least=5).collect()}
    assert small == {1: "response", 3: "response"}


def test_warc_chunks_carry_running_digests(spark, tmp_path):
    body = "".join(random.Random(1).choice("abcdef") for _ in range(150_000))
    pages = spark.createDataFrame([(1, "u", body)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, str(tmp_path / "a"))
    rows = warc.read_chunks(manifest, str(tmp_path / "a"), data=True).orderBy("chunk").collect()
    assert [r.chunk for r in rows] == [0, 1, 2] and b"".join(r.data for r in rows) == body.encode()
    assert all(r.sha1_so_far == warc.base32(hashlib.sha1(body[: r.end_byte].encode()).digest()) for r in rows)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def linked(sets):
    """Smallest id reachable over pairs of similarity 0.8 or more, by comparing all pairs until nothing changes."""
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, x in sets:
            for j, y in sets:
                if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    base, r = texts(25), random.Random(5)
    rows = list(enumerate(base)) + [(100, None), (101, ""), (102, " \n "), (103, "one"), (104, "ONE"), (None, base[0])]
    for i in range(60):
        words = base[i % 25].split()
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(len(words))] = "new" + str(i)
        rows.append((200 + i, " ".join(words)))
    rows += [(3, base[3]), (300, base[3].upper())]
    sets = [(i, shingles(t, width)) for i, t in rows]
    label = linked(sets)
    got = neardup.near_duplicates(docs(spark, rows), how=neardup.NearDup(width=width)).collect()
    assert len(got) == len(rows)
    assert {r.id: r.component_id for r in got if r.id is not None} == label
    assert sorted((r.n_shingles, r.id or -1) for r in got) == sorted((len(s), i or -1) for i, s in sets)
    assert all(r.kept == (r.id == r.component_id) for r in got if r.id is not None)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_of_sets_longer_than_a_head(spark):
    """Variants of one long text around the threshold, so that guesses from samples are refuted and made again."""
    r = random.Random(11)
    base = [f"w{r.randrange(100_000)}" for _ in range(neardup.HEAD + 900)]
    rows = [(500, " ".join(base[:400]))]
    for i in range(40):
        words = list(base)
        for at in r.sample(range(len(words)), 60 + 2 * i):
            words[at] = f"v{i}x{at}"
        rows.append((r.randrange(10**6), " ".join(words)))
    label = linked([(i, shingles(t, 2)) for i, t in rows])
    assert 2 < len(set(label.values())) < len(rows)
    got = neardup.near_duplicates(docs(spark, rows), how=neardup.NearDup(width=2)).collect()
    assert {x.id: x.component_id for x in got} == label


def test_components_follow_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 400), (7, 7), (None, 3)], "a long, b long")
    assert {(r.id, r.label) for r in components(links).collect()} == {(i, 0) for i in range(301)} | {(400, 400), (500, 400)}


ODD = ["", "  a b", "Ünïté ça\nva. No.\n\nx", "it's we'll 12 345", "a b", "éa x", "<|endoftext|> hi", "hi<|startoftext|>", "a \n b", "\tq", "日本 語", "x\x1cy,z", "a.\nB, c", "İstanbul ΣΑΣ", "A" * 3000]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoder_equals_library(path):
    own, library = bpe.Encoder(path), Tokenizer.from_file(path)
    for t in ODD + texts(20):
        assert own(t) == np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark):
    rows = list(enumerate(ODD + texts(60))) + [(900, None), (5, "again"), (None, "no id"), (901, " ".join(texts(80, 9)))]
    got = packing.pack(docs(spark, rows), WORD_BPE).collect()
    library = Tokenizer.from_file(WORD_BPE)
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    known = {(i, s, len(x[s : s + r]), zlib.crc32(np.asarray(x[s : s + r], "<u4").tobytes()), len(x)) for i, x in ids for r in (2048,) for s in range(0, len(x), 2048)}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == known
    by = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048 and sum(by.values()) > 0.8 * 2048 * (len(by) - 1)
    assert packing.pack(docs(spark, []), WORD_BPE).count() == 0


def test_first_fit_decreasing_equals_a_plain_scan():
    r = random.Random(2)
    lengths = np.array([r.randrange(1, 2049) for _ in range(400)])
    bins, offsets = packing.first_fit_decreasing(lengths, 2048)
    free = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), None)
        if b is None:
            free.append(2048)
            b = len(free) - 1
        assert (bins[i], offsets[i]) == (b, 2048 - free[b])
        free[b] -= lengths[i]


@pytest.mark.parametrize("count, lanes", [(0, 4), (1, 8), (17, 1024), (5000, 64), (40000, 512)])
def test_range_coder_round_trip(count, lanes):
    ids = np.random.default_rng(4).zipf(1.3, count).clip(1, 50000).astype(np.int64)
    words, per_lane = rangecoder.encode(ids, 50257, lanes)
    assert (rangecoder.decode(words, per_lane, count, 50257) == ids).all()
    if count == 40000:
        assert len(words) * 16 < 12 * count


def test_token_files(spark):
    rows = list(enumerate(ODD + texts(20)))[::-1] + [(900, None), (None, "first")]
    got = tokenfiles.token_round_trip(docs(spark, rows), BYTE_BPE, block_ids=700).collect()
    library, at, want = Tokenizer.from_file(BYTE_BPE), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tokenfiles.token_round_trip(docs(spark, []), BYTE_BPE).count() == 0


def test_damaged_block_is_an_error(tmp_path):
    path = tmp_path / "f"
    with path.open("wb") as out:
        tokenfiles.write_block(out, np.arange(500, dtype=np.uint32), np.array([1]), np.array([500]), False)
    data = bytearray(path.read_bytes())
    data[-3] ^= 1
    path.write_bytes(bytes(data))
    with path.open("rb") as source, pytest.raises(ValueError):
        list(tokenfiles.read_blocks(source))


def test_exact_search(spark):
    g = np.random.default_rng(6)
    rows = [(i, (g.integers(-40, 40, 8) / 64).tolist()) for i in range(1500)] + [(2000 + i, [0.5] * 8) for i in range(30)]
    rows += [(50_000, None), (50_050, [0.1, None] + [0.0] * 6), (50_100, [float("nan")] * 8), (50_150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (50_200, [1.0, 2.0]), (50_250, [3.0, 1.0])]
    got = topk.top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">home</a></ul></nav><div class="cookie-notice"><p>We use cookies, many, of them.</p></div>
<article><h1>Title &amp; more</h1><p>First <b>bold<br>text, with&nbsp;space &#233; 1 < 2.<p>Second paragraph, long enough, to count for something in the tree of the page.</p>
<div class="ad"><p>Buy, buy, buy now.</p></div><form><p>Name, please</p></form><ul><li>one<li>two</ul><!-- <p>no</p> --></article>
<aside><p>Side, bar, text.</p></aside><section id="comments"><p>Reader, says, something, long, and, full, of, commas, here.</p></section><footer>&copy; foot</footer>"""


def test_main_text(spark):
    want = "Title & more\nFirst bold text, with space é 1 < 2.\nSecond paragraph, long enough, to count for something in the tree of the page.\none\ntwo"
    assert maintext.main_text(PAGE) == want
    plain = "<body><div class=menu><a href=a>a</a> <a href=b>b</a></div><div class=content><h1>Head</h1><p>Some, text, here that goes on and on.</p><p>And more, text.</p></div><div id=footer>foot</div></body>"
    assert maintext.main_text(plain) == "Head\nSome, text, here that goes on and on.\nAnd more, text."
    deep = "<div>" * 3000 + "<p>deep, text</p>" + "</div>" * 3000
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", deep), (1, "u", "<p"), (4, "u", "just text")]
    got = {(r.page_id, r.n_chars) for r in maintext.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert got == {(1, len(want)), (2, 0), (3, 0), (None, 10), (1, 0), (4, 9)}


def test_main_text_inside_forms_and_named_parts():
    lines = [f"Paragraph {i}, long enough, to count for something, in the tree of a page with several of them." for i in range(6)]
    body = "".join(f"<p>{x}</p>" for x in lines)
    menu = "<div class='menu'><a href=a>one</a> <a href=b>two</a></div>"
    fields = "<form><label>Mail</label><input name=m><p>Leave us your mail, please</p></form>"
    asp = f"<body><form id='aspnetForm'><input type='hidden' name='v' value='x'>{menu}<input name='q'><div class='text'><h1>Head</h1>{body}</div></form></body>"
    assert maintext.main_text(asp) == "\n".join(["Head", *lines])
    for around in ("<div class='paywall'>%s</div>", "<div class='elementor-widget'>%s</div>", "<section id='has-comments'>%s</section>", "<div class='ad-layout'>%s</div>"):
        assert maintext.main_text(f"<body>{menu}{around % (f'<h1>Head</h1>{body}' + fields)}</body>") == "\n".join(["Head", *lines]), around
    head = f"<body>{menu}<article><h2 id='login'>Login</h2><p id='share'>{lines[0]}</p><section id='related-work'><h2>Related work</h2><p>{lines[1]}</p></section>{body}"
    cut = "<div class='related'><a href=a>Some other article, which is long</a><a href=b>And one more of them, which is longer still</a></div>"
    comments = "<section id='comments'>" + "".join(f"<p>Reader {i} says, something long, and full of commas, under the article of the page.</p>" for i in range(5)) + "</section>"
    want = ["Login", lines[0], "Related work", lines[1], *lines]
    assert maintext.main_text(f"{head}{cut}{fields}</article>{comments}</body>") == "\n".join(want)
    assert maintext.main_text(f"<body><div class='content'>{body}{comments}<div class='cookie-notice'><p>{lines[0]}</p></div></div></body>") == "\n".join(lines)


def test_main_text_notices_headers_and_references():
    lines = [f"Paragraph {i}, long enough, to count for something, in the tree of a page with several of them." for i in range(6)]
    body = "".join(f"<p>{x}</p>" for x in lines)
    rich = "This part is long, plain and rich, but it says nothing that belongs to the text of the page. " * 2
    for name in ("notice", "promo-box", "site-banner", "popup", "promotion"):
        assert maintext.main_text(f"<body><article><h1>Head</h1>{body}<div class='{name}'><p>{rich}</p></div></article></body>") == "\n".join(["Head", *lines]), name
    site = "<header><p>The name of the site</p></header>"
    for around in ("<main><header><h1>Head</h1></header>%s</main>", "<div class='content'><header><h1>Head</h1></header>%s</div>"):
        assert maintext.main_text(f"<body>{site}{around % body}</body>") == "\n".join(["Head", *lines]), around
    named = "<div class='content'><header class='site-header'><p>The name of the site</p></header>%s</div>"
    assert maintext.main_text(f"<body>{named % body}</body>") == "\n".join(lines)
    notes = "<ol><li><a href=a>First reference</a></li><li><a href=b>Second reference</a></li></ol>"
    others = "<ul><li><a href=c>Another page</a></li><li><a href=d>One more page</a></li></ul>"
    assert maintext.main_text(f"<body><article>{body}{notes}{others}</article></body>") == "\n".join([*lines, "First reference", "Second reference"])
    formula = "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>"
    assert maintext.main_text(f"<body><article>{body}{formula}</article></body>") == "\n".join([*lines, "Let x=2 hold."])


def test_prefix_trees(spark):
    r, rows = random.Random(8), []
    for c in range(40):
        for t in range(r.randrange(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"{'<|im_end|>' if t == 1 else ''}turn {r.randrange(2)} <\\|x"))
    rows += [(90, 0, None, None), (90, 1, "assistant", ""), (91, 0, "a\nb\\n<|", "x"), (None, 0, "user", "q"), (92, 5, "user", "b"), (92, 5, "user", "a")]
    turns = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, node int")
    segments, runs, paths = chattree.prefix_trees(turns)
    got = {tuple(x) for x in chattree.read_back(segments, paths).collect()}
    want, whole, by = set(), {}, {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    for c, own in by.items():
        own = sorted(own)
        loss = "".join(t for _, role, t in own if role == "assistant")
        whole[c] = "".join(chattree.format_turn(role, t)[0] for _, role, t in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((c, len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)), len(loss), sha(loss), len(whole[c])))
    assert got == want
    layout = sorted(segments.collect(), key=lambda s: s.place)
    text = "".join(s.turn for s in layout)
    assert len({s.node for s in layout}) == len(layout) and [s.place for s in layout] == np.cumsum([0] + [s["size"] for s in layout])[:-1].tolist()
    assert len(text) < sum(map(len, whole.values()))
    starts = sorted((x.place, x.c) for x in runs.collect())
    ends = dict(zip([p for p, _ in starts], [p for p, _ in starts[1:]] + [len(text)]))
    for x in runs.collect():
        c = None if x.c == -(1 << 63) else x.c
        assert "".join(text[a.start : a.end] for a in x.attends) + text[x.place : ends[x.place]] == whole[c]
        assert x.position == sum(a.end - a.start for a in x.attends)


def test_decontamination(spark):
    items, r = texts(12, 21), random.Random(3)
    bench = spark.createDataFrame(list(enumerate(items)) + [(50, None), (51, " "), (52, "tiny")], "item_id long, text string")
    rows, want = [(500, None), (501, ""), (502, "plain words " * 400)], set()
    for i, item in enumerate(items):
        edited = list(item)
        for _ in range(int(len(item) * 0.08)):
            edited[r.randrange(len(edited))] = "#"
        rows += [(i, f"before {item.upper()}\n\nafter"), (100 + i, "x " * 50 + "".join(edited) + " y" * 30), (200 + i, item[: len(item) // 2])]
        want |= {(i, i)} | ({(100 + i, i)} if len(item) >= 40 else set())
    rows.append((600, "a Tiny bit"))
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(docs(spark, rows), bench).collect()}
    assert want | {(600, 52)} <= got and not got & {(200 + i, i) for i in range(12) if len(items[i]) > 60}
    left = {x.doc_id for x in decontam.clean(docs(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in got}
    assert decontam.leaks(docs(spark, rows), bench.where("false")).count() == 0 and decontam.leaks(docs(spark, []), bench).count() == 0


def test_decontamination_by_passages(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    item, other = [word() for _ in range(400)], [word() for _ in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    part = item[120:270]
    edited = [w if k % 25 else "changed" for k, w in enumerate(part)]
    plain = " ".join(word() for _ in range(50))
    rows = [(1, f"{plain} {' '.join(part)} {plain}"), (2, f"{plain}\n{' '.join(edited).upper()}"), (3, " ".join(item[:200])), (4, " ".join(item[200:])), (5, f"x {' '.join(item)} y"), (6, " ".join(item[50:80])), (7, plain), (8, " ".join(other))]
    got = {x.doc_id: x for x in decontam.leaks(docs(spark, rows), bench).collect()}
    assert {i: x.item_id for i, x in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 2}
    assert (got[5].edits, got[5].start, got[5].end) == (0, 2, len(rows[4][1]) - 2) and got[2].edits > 0
    assert got[1].edits == 0 and rows[0][1][got[1].start : got[1].end] in " ".join(item) and got[1].end - got[1].start == decontam.PASSAGE
    assert {x.doc_id for x in decontam.clean(docs(spark, rows), bench).collect()} == {6, 7}


def test_pseudonyms(spark):
    rows = [
        (1, "a.b1@x.com 4111 1111 1111 1111 4111111111111112 +1 (988) 555-2485"), (2, "42.144.35.254, 999.1.1.1 2024-02-29 31/12/1999 30.02.2020"), (3, "DE89370400440532013000 123-45-6789 666-12-1234 42.144.35.254"),
        (4, None), (5, ""), (6, "+1 (142) 055-2485 nothing else 12345"), (7, "clean text @ 7"),
    ]
    out = {r.doc_id: r for r in pii.pseudonymised(docs(spark, rows), "key", count_col="n").collect()}
    assert {k: r.n for k, r in out.items()} == {1: 3, 2: 3, 3: 3, 4: 0, 5: 0, 6: 1, 7: 0}
    assert out[4].text is None and out[5].text == "" and out[7].text == rows[6][1]
    # The numbers of an address may differ in length; everything else keeps its shape.
    shape = lambda t: re.sub(r"[0-9a-z]", "0", re.sub(r"\d{1,3}(\.\d{1,3}){3}", "IP", t))
    for i, t in rows[:3] + rows[5:6]:
        assert shape(out[i].text) == shape(t)
    for same in ("4111111111111112", "@x.com", "+1 ("):
        assert same in out[1].text
    assert "999.1.1.1" in out[2].text and "30.02.2020" in out[2].text and "666-12-1234" in out[3].text
    card = re.search(r"(?:\d{4} ){3}\d{4}", out[1].text)[0].replace(" ", "")
    assert sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(card[::-1])) % 10 == 0
    iban = re.search(r"DE\d{20}", out[3].text)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert out[2].text.split(",")[0] == out[3].text.split(" ")[-1]


def test_pseudonyms_beside_other_numbers_and_capitals(spark):
    card, iban, phone = "4111 1111 1111 1111", "BE68 5390 0754 7034", "+1 (743) 555-3824"
    cases = [
        (f"{card}", "", "", 1), (f"{card} 123", "", " 123", 1), (f"{card} 12/27", "", " 12/27", 1), ("no 7 4111111111111111", "no 7 ", "", 1), (f"12 {card} 12 27 123", "12 ", " 12 27 123", 1),
        (f"{iban} EUR", "", " EUR", 1), ("AT61 1904 3002 3457 3201 BIC", "", " BIC", 1), (f"{phone} 20 people", "", " 20 people", 1), ("+44 20 7946 0958 20 people", "", " 20 people", 1),
        (f"{card} {card} 99", "", " 99", 2), (f"{card} 123-45-6789", "", "", 2), (f"{card} 2024-01-15", "", "", 2), (f"{iban} {card} 123", "", " 123", 2), (f"BE12 {card}", "BE12 ", "", 1),
        (f"{phone} {card}", "", "", 2), (f"+44 20 7946 0958 {card} 1", "", " 1", 2), ("3782 822463 10005 1234", "", " 1234", 1), ("41 11 11 11 11 11 11 11 123", "", " 123", 1), ("1 2 3 4 5 6 7 8 9 10 11 12 13", "1 2 3 4 5 6 7 8 9 10 11 12 13", "", 0),
        ("4111 1111 1111 1112 123", "4111 1111 1111 1112 123", "", 0), (f"7 2024-01-15 {card}", "7 ", "", 2), ("+1 (743) 555-3824", "", "", 1), (" ".join(["1234"] * 3000), " ".join(["1234"] * 3000), "", 0),
    ]
    out = {r.doc_id: r for r in pii.pseudonymised(docs(spark, [(i, c[0]) for i, c in enumerate(cases)]), "key", count_col="n").collect()}
    for i, (text, head, tail, n) in enumerate(cases):
        got = out[i].text
        assert (out[i].n, got[: len(head)], got[len(got) - len(tail) :], re.sub(r"\d", "0", got)) == (n, head, tail, re.sub(r"\d", "0", text)), (text, got)
    # Equal values stay linked whatever stands beside them.
    assert out[1].text == out[0].text + " 123" and out[2].text == out[0].text + " 12/27" and out[7].text == out[21].text + " 20 people"
    assert out[3].text == "no 7 " + out[0].text.replace(" ", "") and out[12].text == out[5].text[:-4] + " " + out[1].text


def test_date_pseudonyms_are_a_permutation(spark):
    days = spark.range(0, 73049, 7).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    got = days.select("d", pii._date(F.col("d"), "k").alias("p"))
    row = got.agg(F.count("*").alias("n"), F.countDistinct("p").alias("m"), F.min("p").alias("lo"), F.max("p").alias("hi")).collect()[0]
    assert row.n == row.m and row.lo >= "1900-01-01" and row.hi <= "2099-12-31"


def test_toxicity(spark):
    r, rows, marks = random.Random(4), [], []
    for i in range(1200):
        bad = i % 4 == 0
        words = ["word" + str(r.randrange(300)) for _ in range(60)]
        if bad:
            words[10] = r.choice(["grubbish", "grubbly", "snarfing", "snarfed"])
            words[20] = "women" if r.random() < 0.9 else "men"
        rows.append((i, " ".join(words)))
        marks.append((i, 0, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "the women word1 word2"), (2003, "the men word1 word2"), (None, "word3")]
    labels = spark.createDataFrame(marks + [(None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.classified(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in marks)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert got[2002].predicted == 0 and abs(got[2002].score - got[2003].score) < 0.1 and got[2000].score == got[2001].score
    none = toxicity.classified(docs(spark, rows[:5]), labels.where("toxic = 0")).collect()
    assert len({x.score for x in none}) == 1
    assert toxicity.classified(docs(spark, []), labels).count() == 0
