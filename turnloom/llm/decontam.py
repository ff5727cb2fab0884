"""Benchmark decontamination by the q-gram lemma.

An item of n characters that occurs with at most e edits shares at least n - q + 1 - q * e of its q-grams with the text,
and their places differ by a shift that drifts by e at most. So shared q-grams are counted per document, item and
overlapping band of shifts (2 (e + 1) wide, every e + 1), bands that reach the bound are kept, and an alignment within the
band's diagonals decides. The count cannot miss an occurrence; repeats can only add regions, and equal ones are aligned
once.

An item longer than ``PASSAGE`` is also looked for by its overlapping passages of that length, each with its own budget,
so a copy of a part of it is found; the whole item comes first.

Characters are compared without case and with runs of white space as one blank. The edit budget is a share of the
length looked for, and for less than 40 characters at most what leaves a shared q-gram: (n - 8) // 8. The benchmark is
indexed by tasks in slices of bounded size, each a file in the shared folder and a pass over the documents; documents are
never shuffled for the search.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnloom.llm.arrow import splits
from turnloom.llm.shared import attempt_name, open_folder
from turnloom.sources.sinks import staged, work_dir

Q = 8
EDIT_SHARE = 0.1
#: Characters of a passage of a longer item and between the starts of two; a copied part of PASSAGE + STEP - 1 holds one.
PASSAGE, STEP = 512, 128
#: Characters of benchmark text (with passages) in a slice; a single longer item is a slice of its own.
SLICE_CHARS = 1 << 21
#: Bytes of documents that are searched together.
READ_BYTES = 1 << 19
_BITS = 20
_PLAIN = np.arange(0x3000, dtype=np.uint32)
for _c in range(0x3000):
    _l = chr(_c).lower()
    _PLAIN[_c] = 0x20 if chr(_c).isspace() else ord(_l) if len(_l) == 1 else _c


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points without case, white space as single blanks, none at the ends; and their places in ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() < 0x3000:
        points = _PLAIN.take(points)
    else:
        points = np.where(points < 0x3000, _PLAIN[np.minimum(points, 0x2FFF)], np.where(points == 0x3000, np.uint32(0x20), points))
    blank = points == 0x20
    if not len(points) or not (blank[0] or blank[-1] or (blank[1:] & blank[:-1]).any()):
        return points, np.arange(len(points))
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if blank[-1]:
        keep[len(points) - int(np.argmin(blank[::-1])) if not blank.all() else 0 :] = False
    keep[0] = not blank[0]
    at = np.flatnonzero(keep)
    return points[at], at


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams by doubling; ``q`` is a power of two."""
    if q & (q - 1):
        raise ValueError("q must be a power of two")
    h, width = points.astype(np.uint64), 1
    while width < q:
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        width *= 2
    return h


def _cell(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Slice:
    """q-gram index of some items and their passages; ``owner`` is the item of each text, ``whole`` tells items."""

    names: list
    owner: np.ndarray
    whole: np.ndarray
    texts: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    size: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    short: list[int]


def passages(points: np.ndarray) -> list[np.ndarray]:
    """The item itself, then its passages; the last one ends with the item."""
    last = len(points) - PASSAGE
    return [points] + ([points[a : a + PASSAGE] for a in [*range(0, last, STEP), last]] if last > 0 else [])


def build_slice(items: list[tuple[object, np.ndarray]], q: int, share: float) -> Slice:
    parts = [passages(t) for _, t in items]
    owner = np.repeat(np.arange(len(items)), [len(p) for p in parts])
    whole = np.append([True], owner[1:] != owner[:-1])
    texts = [t for p in parts for t in p]
    size = np.array([len(t) for t in texts], np.int64)
    # An item with room for no edit is found by its exact q-grams; one shorter than q is looked for as it is.
    edits = np.maximum(0, np.minimum((size * share).astype(np.int64), (size - q) // q))
    need = np.maximum(1, size - q + 1 - q * edits)
    all_grams = [_grams(t, q) for t in texts]
    grams = np.concatenate(all_grams) if all_grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams])
    place = np.concatenate([np.arange(len(g)) for g in all_grams]) if all_grams else np.zeros(0, np.int64)
    order = np.argsort(grams, kind="stable")
    grams, item, place = grams[order], item[order], place[order]
    distinct, first = np.unique(grams, return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[_cell(distinct)] = True
    return Slice([n for n, _ in items], owner, whole, texts, edits, need, size, distinct, np.append(first, len(grams)), item, place, bitmap, np.flatnonzero(size < q).tolist())


#: Candidates aligned together, and matches of positions and items that are held at once.
TOGETHER, HELD = 128, 1 << 21


@dataclass
class Candidate:
    """A text to look for (``item``) in ``points`` on the diagonals ``low`` to ``high`` (place in points less place in it)."""

    item: int
    points: np.ndarray
    low: int
    high: int


def _alignments(index: Slice, found: list[Candidate]) -> list[tuple[int, int, int] | None]:
    """Per candidate (edits, start, end) of its best place within the budget, leftmost first, or None.

    A cell of a row is a diagonal, so a row has as many cells as the band has diagonals, whatever the text. Candidates of
    about the same length go through the rows together; one whose whole row is over the budget is left out of the rest.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(found)
    order = sorted(range(len(found)), key=lambda c: int(index.size[found[c].item]))
    for at in range(0, len(order), TOGETHER):
        _align(index, found, np.array(order[at : at + TOGETHER]), out)
    return out


def _align(index: Slice, found: list[Candidate], rows: np.ndarray, out: list) -> None:
    size = np.array([index.size[found[c].item] for c in rows])
    edits = np.array([index.edits[found[c].item] for c in rows])
    low = np.array([found[c].low for c in rows])
    width = max(found[c].high - found[c].low for c in rows) + 1
    n = int(size.max())
    # Beyond the ends of a text stands a character that no item has; items are filled up with another one.
    text = np.full((len(rows), n + width), 0xFFFFFFFF, np.uint32)
    item = np.full((len(rows), n), 0xFFFFFFFE, np.uint32)
    for r, c in enumerate(rows):
        own, points = found[c], found[c].points
        a, b = max(0, own.low), min(len(points), own.high + int(size[r]))
        text[r, a - own.low : max(a, b) - own.low] = points[a:b]
        item[r, : size[r]] = index.texts[own.item]
    # Cost and leftmost start are one number, so that ties keep the smaller start.
    step = np.arange(width) << 32
    cell = np.repeat(np.arange(width)[None], len(rows), axis=0).astype(np.int64)
    inside = np.array([found[c].high - found[c].low + 1 for c in rows])
    over = np.int64(1 << 55)
    cell[np.arange(width)[None] >= inside[:, None]] = over
    live = np.arange(len(rows))
    for i in range(n):
        across = cell + ((text[live, i : i + width] != item[live, i, None]).astype(np.int64) << 32)
        across[:, :-1] = np.minimum(across[:, :-1], cell[:, 1:] + (1 << 32))
        cell = np.minimum.accumulate(across - step, axis=1) + step
        least = cell.min(axis=1)
        done = size[live] == i + 1
        for r in np.flatnonzero(done & (least >> 32 <= edits[live])).tolist():
            k = int(np.argmin(cell[r]))
            start = int(low[live[r]]) + int(least[r] & 0xFFFFFFFF)
            out[rows[live[r]]] = int(least[r] >> 32), start, int(low[live[r]]) + k + i + 1
        keep = ~done & (least >> 32 <= edits[live])
        if not keep.all():
            live, cell = live[keep], cell[keep]
            if not len(live):
                return


def _trimmed(hit: tuple[int, int, int], size: int) -> tuple[int, int, int] | None:
    """A place within the text; characters beyond its ends were no part of it."""
    edits, start, end = hit
    start, end = max(0, start), min(size, end)
    return (edits, start, end) if end > start else None


def _matches(at: np.ndarray, slot: np.ndarray, index: Slice) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position, text, place) of the q-grams at positions that texts share, at most about ``HELD`` at a time."""
    count = index.first[slot + 1] - index.first[slot]
    ends = np.cumsum(count)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HELD, side="right")))
        n = count[a:b]
        where = np.repeat(index.first[slot[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.repeat(at[a:b], n), index.item[where], index.place[where]
        a = b


def _candidates(points: np.ndarray, index: Slice, q: int) -> list[Candidate]:
    """Bands of shifts in which a text shares enough q-grams, each as the diagonals that an occurrence can take."""
    grams = _grams(points, q)
    at = np.flatnonzero(index.bitmap[_cell(grams)])
    if not len(at):
        return []
    slot = np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)
    real = index.grams[slot] == grams[at]
    at, slot = at[real], slot[real]
    # A text that falls short over the whole of ``points`` does so in every band.
    total = np.zeros(len(index.texts), np.int64)
    for _, item, _ in _matches(at, slot, index):
        total += np.bincount(item, minlength=len(total))
    enough = total >= index.need
    if not enough.any():
        return []
    chosen = np.flatnonzero(enough)
    ends = np.cumsum(total[chosen])
    found: dict[tuple[int, bytes, int], Candidate] = {}
    a = 0
    while a < len(chosen):
        # Some texts at a time, so that their matches are held within bounds too.
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HELD, side="right")))
        wanted = np.zeros(len(index.texts), bool)
        wanted[chosen[a:b]] = True
        parts = [(item[keep], (where - place)[keep]) for where, item, place in _matches(at, slot, index) if len(keep := np.flatnonzero(wanted[item]))]
        item, shift = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        _banded(points, index, item, shift, found)
        a = b
    return list(found.values())


def _banded(points: np.ndarray, index: Slice, item: np.ndarray, shift: np.ndarray, found: dict) -> None:
    """Adds the bands over the bound. Regions of equal characters are taken once, the leftmost: repeats align alike."""
    band = shift // (index.edits[item] + 1)
    key = np.concatenate([item, item]) << 40 | np.concatenate([band, band - 1]) + (1 << 38)
    order = np.argsort(key, kind="stable")
    key, both = key[order], np.concatenate([shift, shift])[order]
    first = np.flatnonzero(np.append([True], key[1:] != key[:-1]))
    number = np.diff(np.append(first, len(key)))
    good = number >= index.need[key[first] >> 40]
    if not good.any():
        return
    least, most = np.minimum.reduceat(both, first)[good], np.maximum.reduceat(both, first)[good]
    for i, low, high in sorted(set(zip((key[first][good] >> 40).tolist(), least.tolist(), most.tolist()))):
        e, n = int(index.edits[i]), int(index.size[i])
        # An occurrence leaves the diagonal of a shared q-gram by at most its edits.
        region = points[max(0, low - e) : high + e + n].tobytes()
        found.setdefault((i, region, high - low), Candidate(i, points, low - e, high + e))


def _exact(index: Slice, found: Candidate) -> tuple[int, int, int] | None:
    """The leftmost place where the text stands as it is, on the diagonals of the candidate."""
    n, text = int(index.size[found.item]), index.texts[found.item].tobytes()
    a = max(0, found.low)
    data = found.points[a : found.high + n].tobytes()
    at = data.find(text)
    while at >= 0 and at % 4:
        at = data.find(text, at + 1)
    return None if at < 0 else (0, a + at // 4, a + at // 4 + n)


def _found(texts: list[np.ndarray], index: Slice, q: int) -> list[dict[int, tuple[int, int, int]]]:
    """Per normalised text the best (edits, start, end) by item: of the whole item, else of its passages."""
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    later: list[tuple[int, Candidate]] = []
    pending: list[tuple[int, Candidate]] = []
    complete: set[tuple[int, int]] = set()

    def settle(row: int, candidate: Candidate, hit: tuple[int, int, int] | None) -> None:
        hit = hit and _trimmed(hit, len(candidate.points))
        if hit:
            own = int(index.owner[candidate.item])
            out[row][own] = min(out[row].get(own, hit), hit)
            if index.whole[candidate.item]:
                complete.add((row, own))

    for row, points in enumerate(texts):
        for i in index.short:
            # Shorter than a q-gram: looked for as it is.
            if index.size[i] and (hit := _exact(index, Candidate(i, points, 0, len(points)))):
                out[row][int(index.owner[i])] = hit
        for candidate in _candidates(points, index, q):
            (pending if index.whole[candidate.item] else later).append((row, candidate))
    for group in (pending, later):
        inexact = []
        for row, c in group:
            if not index.whole[c.item] and (row, int(index.owner[c.item])) in complete:
                continue
            hit = _exact(index, c)
            settle(row, c, hit)
            if hit is None:
                inexact.append((row, c))
        # An exact place settles an item; others are aligned only where there is none.
        inexact = [(row, c) for row, c in inexact if out[row].get(int(index.owner[c.item]), (1,))[0]]
        for (row, c), hit in zip(inexact, _alignments(index, [c for _, c in inexact])):
            settle(row, c, hit)
    return out


@dataclass(frozen=True)
class Index:
    """Slices of the benchmark as files in the shared folder, each built by a task."""

    folder: str
    names: tuple[str, ...]

    def load(self, name: str) -> Slice:
        system, path = open_folder(self.folder)
        with system.open_input_stream(f"{path}/{name}") as f:
            return Slice(**pickle.loads(f.read()))


def build_index(benchmark: DataFrame, id_col: str, text_col: str, q: int, share: float) -> Index:
    """The benchmark dealt to slices of about ``SLICE_CHARS``; only the names of their files reach the driver.

    Items without a visible character are left out, for nothing can hold them.
    """
    folder = work_dir(benchmark.sparkSession, "benchmark")
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # Passages of a long item overlap, so it counts by as much more.
    weight = F.length("text") * F.when(F.length("text") > PASSAGE, PASSAGE // STEP + 1).otherwise(1)
    chars = items.agg(F.sum(weight)).first()[0] or 0
    parts = max(1, -(-chars // SLICE_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                points, _ = normalised(text)
                if len(points):
                    held.append((ident, points))
        if held:
            system, path = open_folder(folder)
            name = attempt_name("slice")
            with system.open_output_stream(f"{path}/{name}") as f:
                f.write(pickle.dumps(vars(build_slice(held, q, share)), protocol=5))
            yield pa.record_batch([pa.array([name])], ["name"])

    written = items.repartition(parts).mapInArrow(run, "name string")
    return Index(folder, tuple(sorted(r["name"] for r in staged(written, "slices").collect())))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, share: float = EDIT_SHARE) -> DataFrame:
    """(doc_id, item_id, start, end, edits): one row per document row and item that it holds, whole or a passage,
    with the best region (of the whole item if that is there; fewest edits, then leftmost) in code points of the whole text.

    Null and empty texts hold nothing; repeated rows are reported each; an empty benchmark or table gives no row.
    """
    index = build_index(benchmark, item_col, item_text, q, share)
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long, edits long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for name in index.names:

        def run(batches: Iterator[pa.RecordBatch], name=name) -> Iterator[pa.RecordBatch]:
            part = index.load(name)
            for batch in splits(batches, "text", READ_BYTES):
                read = [normalised(t or "") for t in batch.column("text").to_pylist()]
                hits = _found([points for points, _ in read], part, q)
                rows = [
                    (ident, part.names[i], int(at[start]), int(at[end - 1]) + 1, edits)
                    for ident, (_, at), held in zip(batch.column("id").to_pylist(), read, hits)
                    for i, (edits, start, end) in held.items()
                ]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "start", "end", "edits"])

        out = out.union(rows.mapInArrow(run, out.schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` without the rows that hold an item or a passage of one; filtered where they lie.

    Null and empty texts stay; repeated rows are judged each; an empty benchmark leaves all rows.
    """
    index = build_index(benchmark, item_col, item_text, q, share)
    for name in index.names:

        def run(batches: Iterator[pa.RecordBatch], name=name) -> Iterator[pa.RecordBatch]:
            part = index.load(name)
            for batch in splits(batches, text_col, READ_BYTES):
                hits = _found([normalised(t or "")[0] for t in batch.column(text_col).to_pylist()], part, q)
                yield batch.filter(pa.array([not held for held in hits], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
