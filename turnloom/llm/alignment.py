"""Alignment of two tokenizers over the bytes of a text, as a monoid of fragments.

Tokens of A (byte-level BPE) and B (``sentencepiece`` BPE) lie on the same bytes: a blank and the text. Offsets where
tokens of both end are cuts; between two cuts lies a group. For a byte range, the tokens that end in it make a fragment:
an open prefix up to the first cut, closed groups between the first and the last cut, and an open suffix after it. Two
neighbouring fragments compose to the fragment of the joined range: the first one's suffix and the second one's prefix
close to a group. That is associative, so a very long document is cut into byte ranges which Spark spreads over tasks, and
the fragments are composed in a tree of ``FAN`` neighbours a round. The other documents are one fragment each, closed
where they lie.

Both tokenizers cut before a blank that follows a visible character (:mod:`turnloom.llm.cuts`), so the ids of each such
part are found once per worker and taken from a table after that. A range is read with the parts that its ends lie in.
"""

from __future__ import annotations

import hashlib
import os
import sys
import types
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from turnloom.llm import cuts
from turnloom.llm.arrow import splits
from turnloom.llm.bpe import _byte_letters
from turnloom.sources.sinks import staged

#: Characters of a range of a very long document; a document of at most twice as many is one fragment.
RANGE = 1 << 15
#: Neighbouring fragments that a round composes.
FAN = 16
#: Parts kept per worker; when full, the table starts anew.
KEPT = 400_000
#: Rows of the table of linked id pairs up to which it is broadcast (24 bytes a row); beyond, the pairs are shuffled.
BROADCAST_PAIRS = 1_500_000


class Parts(dict):
    """Part without its blank -> (ids of A, ids of B) as bytes of ``<u4``; None where the bytes of either differ."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.model, self.letters = self.a.model, _byte_letters()
        byte = {letter: code for code, letter in self.letters.items()}
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(byte[c] for c in name)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if not cuts.starts_only(pieces):
            raise ValueError(f"{b_path} merges across blanks")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = [pieces.index("▁")]
        # Texts of ids with what follows them inside a group and at the end of their side, for strings of whole ranges.
        self.strings = pa.array([f"{i}{end}" for table, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(table))])
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, table), np.int64, len(table)) for table in (self.a_bytes, self.b_bytes))

    def learn(self, parts: list[str]) -> None:
        """Take in new parts, all at once: the libraries are quicker with many."""
        if len(self) + len(parts) > KEPT:
            self.clear()
        words = [p for p in parts if p.isalpha()]
        others = [p for p in parts if not p.isalpha()]
        # A blank and letters are one piece to A's pattern, so they go straight to its merges.
        a = [[t.id for t in self.model.tokenize((" " + w).encode().decode("latin-1").translate(self.letters))] for w in words]
        a += [e.ids for e in self.a.encode_batch_fast([" " + p for p in others], add_special_tokens=False)]
        # Alone, B's library gives nothing for the empty text; here it is the blank at the end of a text.
        for part, of_a, of_b in zip(words + others, a, self.b.encode(words + others, num_threads=1)):
            of_b = of_b if part else self.blank
            same = (" " + part).encode() == b"".join(map(self.a_bytes.__getitem__, of_a)) == b"".join(map(self.b_bytes.__getitem__, of_b))
            self[part] = (array("I", of_a).tobytes(), array("I", of_b).tobytes()) if same else None

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B for a blank and ``text``; None where the bytes of either differ from it."""
        cut = cuts.CUT.split(text)
        distinct = set(cut)
        if new := [p for p in distinct if p not in self]:
            self.learn(new if len(self) + len(new) <= KEPT else list(distinct))
        found = list(map(self.__getitem__, cut))
        if None in found:
            return None
        a, b = (np.frombuffer(b"".join(side), np.uint32).astype(np.int64) for side in zip(*found))
        return a, b


def parts_of(a_path: str, b_path: str) -> Parts:
    """One table per worker and pair of files; it outlives the task."""
    kept = sys.modules.setdefault("turnloom_worker_state", types.ModuleType("turnloom_worker_state")).__dict__
    name = f"align {a_path} {b_path}"
    if name not in kept:
        kept[name] = Parts(a_path, b_path)
    return kept[name]


@dataclass(frozen=True)
class Fragment:
    """Tokens that end in a byte range: ids as text. Without a cut all of them are in the prefix.

    ``closed`` are the groups between the first and the last cut, joined by ``;``, ``n_closed`` their number.
    """

    ok: bool
    cut: bool
    pre_a: str
    pre_b: str
    closed: str
    n_closed: int
    suf_a: str
    suf_b: str

    def __mul__(self, other: Fragment) -> Fragment:
        """The fragment of both ranges, this one first."""
        ok = self.ok and other.ok
        if not self.cut:
            return Fragment(ok, other.cut, _joined(self.pre_a, other.pre_a), _joined(self.pre_b, other.pre_b), other.closed, other.n_closed, other.suf_a, other.suf_b)
        a, b = _joined(self.suf_a, other.pre_a), _joined(self.suf_b, other.pre_b)
        if not other.cut:
            return Fragment(ok, True, self.pre_a, self.pre_b, self.closed, self.n_closed, a, b)
        closed = _joined(_joined(self.closed, f"{a}|{b}", ";"), other.closed, ";")
        return Fragment(ok, True, self.pre_a, self.pre_b, closed, self.n_closed + 1 + other.n_closed, other.suf_a, other.suf_b)

    def whole(self) -> tuple[int, str]:
        """Number of groups and their string, for a range from the start to the end of a text."""
        return self.n_closed + 1, _joined(f"{self.pre_a}|{self.pre_b}", self.closed, ";")


EMPTY = Fragment(True, False, "", "", "", 0, "", "")


def _joined(left: str, right: str, mark: str = ",") -> str:
    return f"{left}{mark}{right}" if left and right else left or right


def _listed(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _groups(parts: Parts, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> pa.Array:
    """The ids in the order of the result, each with its mark: as one Arrow array, whose bytes are the string."""
    codes = np.empty(len(a) + len(b), np.int64)
    last_a = np.append(a_group[1:] != a_group[:-1], True)
    last_b = np.append(b_group[1:] != b_group[:-1], True)
    ahead_b, through_a = np.searchsorted(b_group, a_group), np.searchsorted(a_group, b_group, side="right")
    n_a = len(parts.a_bytes)
    codes[np.arange(len(a)) + ahead_b] = a + n_a * last_a
    codes[np.arange(len(b)) + through_a] = b + len(parts.b_bytes) * last_b + 2 * n_a
    return pc.take(parts.strings, pa.array(codes))


def _cut_ends(parts: Parts, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the tokens of A and B in bytes, and which of them are cuts."""
    a_end, b_end = np.cumsum(parts.a_sizes[a]), np.cumsum(parts.b_sizes[b])
    size = int(max(a_end[-1], b_end[-1])) + 1 if len(a) and len(b) else 1
    of_a, of_b = np.zeros(size, bool), np.zeros(size, bool)
    of_a[a_end], of_b[b_end] = True, True
    return a_end, b_end, of_b[a_end], of_a[b_end]


def fragment(parts: Parts, text: str, low: int, high: int) -> tuple[Fragment, np.ndarray, int, int]:
    """The fragment of the tokens of ``text`` (a blank before it) that end in the bytes (low, high], the linked id pairs
    (``a << 32 | b``), and the numbers of tokens. The text starts and ends at safe cuts."""
    found = parts.ids(text)
    if found is None:
        return Fragment(False, False, "", "", "", 0, "", ""), np.zeros(0, np.int64), 0, 0
    a, b = found
    a_end, b_end, a_cut, b_cut = _cut_ends(parts, a, b)
    here_a, here_b = (a_end > low) & (a_end <= high), (b_end > low) & (b_end <= high)
    a, a_cut, b, b_cut = a[here_a], a_cut[here_a], b[here_b], b_cut[here_b]
    links = a[a_cut] << 32 | b[b_cut]
    if not len(links):
        return Fragment(True, False, _listed(a), _listed(b), "", 0, "", ""), links, len(a), len(b)
    (a0, a1), (b0, b1) = (((at := np.flatnonzero(c))[0] + 1, at[-1] + 1) for c in (a_cut, b_cut))
    middle_a, middle_b = slice(a0, a1), slice(b0, b1)
    closed = ""
    if len(links) > 1:
        groups = [np.cumsum(c) - c for c in (a_cut[middle_a], b_cut[middle_b])]
        closed = _bytes_of(_groups(parts, a[middle_a], b[middle_b], *groups))[0].tobytes()[:-1].decode()
    return Fragment(True, True, _listed(a[:a0]), _listed(b[:b0]), closed, len(links) - 1, _listed(a[a1:]), _listed(b[b1:])), links, len(a), len(b)


def _bytes_of(marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows."""
    _, offsets, data = marked.buffers()
    wide = np.int64 if pa.types.is_large_string(marked.type) else np.int32
    return np.frombuffer(data, np.uint8), np.frombuffer(offsets, wide)[marked.offset : marked.offset + len(marked) + 1]


LINKS = "links array<struct<pair:long,n:long>>"
ALIGNED = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {LINKS}"
RANGES = "row long, doc_id long, seq long, text string, low long, high long"
PIECE = f"row long, doc_id long, seq long, ok boolean, cut boolean, pre_a string, pre_b string, closed string, n_closed long, suf_a string, suf_b string, n_a long, n_b long, {LINKS}"
_LINK = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))


def _counted(parts: Parts, a: np.ndarray, b: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    """Distinct pairs of each row with their numbers, as one list column."""
    n_a, n_b = len(parts.a_bytes), len(parts.b_bytes)
    keys, number = np.unique((rows * n_a + a) * n_b + b, return_counts=True)
    pairs = keys // n_b % n_a << 32 | keys % n_b
    offsets = np.searchsorted(keys, np.arange(n_rows + 1) * (n_a * n_b))
    values = pa.StructArray.from_arrays([pa.array(pairs), pa.array(number, pa.int64())], ["pair", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(_LINK)


def _short(parts: Parts, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of ``ALIGNED`` for whole texts, aligned together: every text ends at a cut, so they are ranges of one."""
    n = batch.num_rows
    sides: list[list[np.ndarray]] = [[], []]
    held = np.zeros((2, n), np.int64)
    texts = batch.column("text").to_pylist()
    new = {part for t in texts if t for part in cuts.CUT.split(t) if part not in parts}
    if new:
        parts.learn(list(new))
    for i, t in enumerate(texts):
        found = parts.ids(t) if t else None
        for side in (0, 1):
            if found is not None:
                sides[side].append(found[side])
                held[side, i] = len(found[side])
    a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in sides)
    digest, links, n_links = [""] * n, pa.array([[]] * n, _LINK), np.zeros(n, np.int64)
    if len(a):
        _, _, a_cut, b_cut = _cut_ends(parts, a, b)
        row_a = np.repeat(np.arange(n), held[0])
        data, at = _bytes_of(_groups(parts, a, b, np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut))
        ends = at[np.concatenate(([0], np.cumsum(held.sum(axis=0))))]
        for i in np.flatnonzero(held[0]).tolist():
            digest[i] = hashlib.sha256(data[ends[i] : ends[i + 1] - 1]).hexdigest()
        n_links = np.bincount(row_a[a_cut], minlength=n)
        links = _counted(parts, a[a_cut], b[b_cut], row_a[a_cut], n)
    number = [pa.array(x, pa.int64()) for x in (held[0], held[1], n_links, n_links)]
    return pa.record_batch([batch.column("row"), batch.column("doc_id"), *number, pa.array(digest), links], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def ranges(text: str, size: int = RANGE) -> Iterator[tuple[str, int, int]]:
    """(text, low, high): byte ranges of a blank and ``text``, each with the text between the safe cuts around it.

    Ranges meet every ``size`` characters, wherever that falls; only where no safe cut is within ``size`` characters they
    meet at the next cut, so the parts read twice stay shorter than the ranges.
    """
    safe = np.array([-1, *(m.start() for m in cuts.CUT.finditer(text)), len(text)])
    meet = []
    for x in range(size, len(text), size):
        k = int(np.searchsorted(safe, x))
        x = x if safe[k] - safe[k - 1] <= size else int(safe[k])
        if (not meet or x > meet[-1]) and x < len(text):
            meet.append(x)
    for s, e in zip([-1, *meet], [*meet, len(text)]):
        # The part that starts at a cut takes the cut's blank as the blank before it.
        left = int(safe[np.searchsorted(safe, s, side="right") - 1])
        right = int(safe[np.searchsorted(safe, e)])
        low = len(text[left + 1 : s].encode()) + 1 if s > left else 0
        yield text[left + 1 : right], low, low + len(text[max(s, 0) : e].encode()) + (s < 0)


def _fold(rows: DataFrame, by: str, fan: int) -> DataFrame:
    """One round of the tree: neighbouring fragments ``seq // fan`` of a document become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                here = (r[by], r["seq"] // fan)
                if held and here != key:
                    yield _composed(held, key[1])
                    held = []
                key = here
                held.append(r)
        if held:
            yield _composed(held, key[1])

    return rows.repartition(by, F.floor(F.col("seq") / fan)).sortWithinPartitions(by, "seq").mapInArrow(run, PIECE)


_FIELDS = ("ok", "cut", "pre_a", "pre_b", "closed", "n_closed", "suf_a", "suf_b")


def _composed(rows: list[dict], seq: int) -> pa.RecordBatch:
    out = reduce(Fragment.__mul__, (Fragment(*(r[f] for f in _FIELDS)) for r in rows), EMPTY)
    pairs = np.array([x["pair"] for r in rows for x in r["links"]], np.int64)
    number = np.array([x["n"] for r in rows for x in r["links"]], np.int64)
    distinct, where = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, number)
    return _fragment_rows([(rows[0]["row"], rows[0]["doc_id"], seq, out, sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), distinct, total)])


def _fragment_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
        *(pa.array([getattr(r[3], f) for r in rows]) for f in _FIELDS),
        pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64()),
        pa.array([[{"pair": p, "n": n} for p, n in zip(r[6].tolist(), r[7].tolist())] for r in rows], _LINK),
    ]
    return pa.record_batch(columns, [c.split()[0] for c in PIECE.split(f", {LINKS}")[0].split(", ")] + ["links"])


def fragments(long: DataFrame, a_path: str, b_path: str, size: int = RANGE) -> DataFrame:
    """Fragments (``PIECE``) of the byte ranges of the texts of (row, doc_id, text), spread over tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splits(batches, "text", 1):
            row, ident, text = (batch.column(c)[0].as_py() for c in ("row", "doc_id", "text"))
            for seq, (part, low, high) in enumerate(ranges(text, size)):
                yield pa.record_batch([pa.array([v], t) for v, t in ((row, pa.int64()), (ident, pa.int64()), (seq, pa.int64()), (part, pa.string()), (low, pa.int64()), (high, pa.int64()))], ["row", "doc_id", "seq", "text", "low", "high"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(a_path, b_path)
        for batch in batches:
            for r in batch.to_pylist():
                made, links, n_a, n_b = fragment(parts, r["text"], r["low"], r["high"])
                yield _fragment_rows([(r["row"], r["doc_id"], r["seq"], made, n_a, n_b, *np.unique(links, return_counts=True))])

    return long.mapInArrow(cut, RANGES).repartition("row", "seq").mapInArrow(read, PIECE)


def composed(pieces: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """Rows of ``ALIGNED`` from fragments of documents of at most ``most`` ranges, by a tree of rounds."""
    while most > 1:
        pieces, most = _fold(pieces, "row", fan), -(-most // fan)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.to_pylist()):
                good = r["ok"]
                n, text = Fragment(*(r[f] for f in _FIELDS)).whole() if good else (0, "")
                links = batch.column("links").slice(i, 1) if good else pa.array([[]], _LINK)
                values = [r["row"], r["doc_id"], r["n_a"] if good else 0, r["n_b"] if good else 0, n, n]
                digest = hashlib.sha256(text.encode()).hexdigest() if good else ""
                yield pa.record_batch([*(pa.array([v], pa.int64()) for v in values), pa.array([digest]), links], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return pieces.mapInArrow(close, ALIGNED)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE, fan: int = FAN) -> DataFrame:
    """Rows of ``ALIGNED``: one per document row, with its distinct linked id pairs (``a << 32 | b``) and their numbers.

    Null and empty texts, and texts whose bytes either tokenizer changes, have no tokens, no links and the empty digest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > 2 * size
    number = F.monotonically_increasing_id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(a_path, b_path)
        for batch in splits(batches, "text"):
            yield _short(parts, batch)

    short = rows.where(~is_long).select(number.alias("row"), "*").mapInArrow(run, ALIGNED)
    longest = docs.agg(F.max(F.length(text_col))).first()[0] or 0
    if longest <= 2 * size:
        return short
    # Rows are told apart by number; those of long texts count down from -1.
    long = rows.where(is_long).select((-1 - number).alias("row"), "*")
    return short.union(composed(fragments(long, a_path, b_path, size), -(-longest // size), fan))


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE, fan: int = FAN, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per document row.

    ``n_best`` are the links whose id pair is linked most often of all pairs of its B id in the corpus, ``count_sum`` the
    sum of those numbers over the links. Repeated rows and null ids are rows of their own; an empty table gives no row;
    other columns are not read. The table of pairs is broadcast where it has at most ``broadcast_pairs`` rows and joined
    by pair beyond.
    """
    texts = staged(aligned(docs, a_path, b_path, id_col, text_col, size, fan), "aligned")
    links = texts.where("n_links > 0").select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.explode("links").alias("link")).select("*", "link.pair", "link.n").drop("link")
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1)))
    pairs = staged(counts.select("pair", "count", (F.col("count") == most).alias("best")), "pairs")
    known = F.broadcast(pairs) if pairs.count() <= broadcast_pairs else pairs
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    best, total = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)), F.sum(F.col("count") * F.col("n"))
    scored = links.join(known, "pair").groupBy(*own).agg(best.alias("n_best"), total.alias("count_sum"))
    bare = texts.where("n_links = 0").select(*own, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return scored.unionByName(bare).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
