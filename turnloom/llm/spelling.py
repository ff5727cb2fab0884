"""Spelling variants: words at one edit, by k-d trees over letter-count vectors.

A word is a vector of letter counts. One replaced letter moves one count up and one down, one inserted letter moves one up:
the L1 distance is two at most, and between words of equal length each side is one at most. So the near words of a word
lie in a small box, searched per pair of lengths (equal, one more, one less) in k-d trees; what the boxes leave is
verified by the order of the letters.

The words are spread in two steps. A tree per length, fitted on a bounded sample of words, cuts the vectors into cells; a
cell is split further by hash where it holds more than a block. Every word goes to its own block as a member and, as a
probe, to the blocks of each cell whose box it can reach. Inside a block the members are cut into a k-d tree again and all
probes run down it together. A block gives one row per probe and not one per pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnloom.llm.arrow import splits
from turnloom.sources.sinks import staged

LEAST_LETTERS, LEAST_COUNT, TYPO_EVERY, FORM_TIMES = 6, 5, 199, 5
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Counts kept: a to z, and the other letters in six classes by code point. Sharing a class never moves words apart.
CLASSES = 32
#: Words of the sample on which the trees over cells are fitted, and characters of the members in a block.
SAMPLE, BLOCK_CHARS = 30_000, 1 << 16
#: Lengths with a tree of their own; the few longer words of a length make one cell.
TREE_LENGTHS = 64
#: Members of a leaf inside a block.
LEAF = 32


def _lowered(text: str) -> str:
    """A-Z in lower case, other letters as they are: what ``bytes.lower`` does to UTF-8."""
    return text.encode().lower().decode()


def planted(ident: int | None, run: str, every: int = TYPO_EVERY) -> str:
    """The run, or where ``every`` divides the crc32 of ``<id>:<run>`` the run without one of its code points.

    A null id is written as nothing.
    """
    h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = TYPO_EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of whole texts, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in splits(batches, "text"):
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(RUN.findall(_lowered(text or ""))).items():
                    # A shorter run gives no word, with or without the deletion.
                    if len(word) >= least_letters and len(word := planted(ident, word, every)) >= least_letters:
                        held[word] += n
            if len(held) > 200_000:
                yield _counted(held)
                held.clear()
        if held:
            yield _counted(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def points(words: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, one row per word."""
    if not words:
        return np.zeros((0, CLASSES), np.int32)
    flat = np.concatenate(points(words)).astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    lower = flat - ord("a")
    cls = np.where((lower >= 0) & (lower < 26), lower, 26 + flat % (CLASSES - 26))
    return np.bincount(row * CLASSES + cls, minlength=len(words) * CLASSES).reshape(len(words), CLASSES).astype(np.int32)


def codes(x: np.ndarray) -> np.ndarray:
    """Letter counts as 64 bits: whether a count is at least one, and at least two.

    A bit more or less is a count more or less, so bits on one side bound that side of the L1 distance from below.
    """
    bits = np.concatenate([x >= 1, x >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def _split(x: np.ndarray) -> tuple[int, int] | None:
    """(dimension, largest count of the left side) of the most even split; None if all vectors are equal."""
    best = None
    for d in np.flatnonzero(x.max(axis=0) > x.min(axis=0)).tolist():
        below = np.cumsum(np.bincount(x[:, d]))[:-1]
        at = int(np.argmin(np.abs(2 * below - len(x))))
        uneven = abs(2 * int(below[at]) - len(x))
        if 0 < below[at] < len(x) and (best is None or uneven < best[0]):
            best = uneven, d, at
    return best and best[1:]


class Cells:
    """A k-d tree over vectors: inner nodes (dimension, largest count on the left), leaves numbered as cells.

    Built as nested tuples: a leaf is a number, a node (dimension, count, left, right).
    """

    def __init__(self, sample: np.ndarray, cells: int):
        self.size = 0
        self.root = self._grow(sample, max(1, cells))

    def _grow(self, x: np.ndarray, cells: int):
        split = _split(x) if cells > 1 and len(x) > 1 else None
        if split is None:
            self.size += 1
            return self.size - 1
        d, at = split
        left = x[:, d] <= at
        return d, at, self._grow(x[left], cells // 2), self._grow(x[~left], cells - cells // 2)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.zeros(len(x), np.int64)
        self._down(self.root, x, np.arange(len(x)), lambda cell, rows: out.__setitem__(rows, cell))
        return out

    def _down(self, node, x, rows, emit):
        if not len(rows):
            return
        if isinstance(node, int):
            emit(node, rows)
            return
        d, at, left, right = node
        goes = x[rows, d] <= at
        self._down(left, x, rows[goes], emit)
        self._down(right, x, rows[~goes], emit)

    def reached(self, x: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that hold a vector with counts at most ``up`` more and ``down`` less in all.

        The box of a node is known by the bounds on its path; the excess over a bound adds up over dimensions.
        """
        found: list[tuple[np.ndarray, int]] = []

        def walk(node, rows, low, high, bounds):
            if not len(rows):
                return
            if isinstance(node, int):
                found.append((rows, node))
                return
            d, at, left, right = node
            lo, hi = bounds.get(d, (0, None))
            here = x[rows, d]
            # To the left the count must come down to ``at``, to the right up to ``at + 1``; an earlier bound of this
            # dimension is replaced by the narrower one.
            was_down = np.maximum(0, here - hi) if hi is not None else 0
            now_down = high + np.maximum(0, here - at) - was_down
            keep = now_down <= down
            walk(left, rows[keep], low[keep], now_down[keep], {**bounds, d: (lo, at)})
            now_up = low + np.maximum(0, at + 1 - here) - np.maximum(0, lo - here)
            keep = now_up <= up
            walk(right, rows[keep], now_up[keep], high[keep], {**bounds, d: (at + 1, hi)})

        zero = np.zeros(len(x), np.int64)
        walk(self.root, np.arange(len(x)), zero, zero.copy(), {})
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in found]), np.repeat([c for _, c in found], [len(r) for r, _ in found])


def trees(words: DataFrame, sample: int = SAMPLE, block_chars: int = BLOCK_CHARS) -> dict[int, Cells]:
    """A tree per length of at most ``TREE_LENGTHS``, fitted on about ``sample`` words drawn by hash.

    Only the sample (never more than twice as many) and one count per length come to the driver. The number of cells
    follows the counts.
    """
    sized = words.where(F.length("word") <= TREE_LENGTHS)
    counts = {r["l"]: r["n"] for r in sized.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("n")).collect()}
    share = 1 << 40 if sum(counts.values()) <= sample else (1 << 40) * sample // sum(counts.values())
    drawn = [r["word"] for r in sized.select("word").where(F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < share).limit(2 * sample).collect()]
    by_length: dict[int, list[str]] = {}
    for w in drawn:
        by_length.setdefault(len(w), []).append(w)
    # Leaves of fewer than eight sampled words would follow chance.
    return {l: Cells(vectors(by_length.get(l, [])), min(-(-n * l // block_chars), max(1, len(by_length.get(l, [])) // 8))) for l, n in counts.items()}


_PAIRS = ((0, 1, 1), (1, 1, 0), (-1, 0, 1))
_HELD = "length long, cell long, word string, n long"


def _members(words: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splits(batches, "word", 1 << 18):
            texts = batch.column("word").to_pylist()
            x, size = vectors(texts), np.array([len(w) for w in texts], np.int64)
            cell = np.zeros(len(texts), np.int64)
            for l in set(size.tolist()) & cells.keys():
                cell[size == l] = cells[l].own(x[size == l])
            yield pa.record_batch([pa.array(size), pa.array(cell), batch.column("word"), batch.column("n")], ["length", "cell", "word", "n"])

    return words.select("word", "n").mapInArrow(run, _HELD)


def _probes(words: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """Each word once per cell that it reaches, for members of its length, one more and one less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splits(batches, "word", 1 << 18):
            texts = batch.column("word").to_pylist()
            x, size = vectors(texts), np.array([len(w) for w in texts], np.int64)
            for l in sorted(set(size.tolist())):
                at = np.flatnonzero(size == l)
                for more, up, down in _PAIRS:
                    if l + more in cells:
                        row, cell = cells[l + more].reached(x[at], up, down)
                    elif l + more > TREE_LENGTHS:
                        row, cell = np.arange(len(at)), np.zeros(len(at), np.int64)
                    else:
                        continue
                    own = batch.take(pa.array(at[row]))
                    yield pa.record_batch([pa.array(np.full(len(row), l + more)), pa.array(cell), own.column("word"), own.column("n")], ["length", "cell", "word", "n"])

    return words.select("word", "n").mapInArrow(run, _HELD)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of two code point tables differ by exactly one edit; ``b`` has as many columns or one more or less."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


class Block:
    """The members of a block, all of one length, as a k-d tree over the codes of their counts.

    A node carries the box of its members: the bits that all of them have and those that any of them has.
    """

    def __init__(self, words: list[str], counts: np.ndarray):
        # Members in code point order, so of equal counts the smaller row is the smaller word.
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], counts[order]
        self.points = np.stack(points(self.words))
        self.codes = codes(vectors(self.words))
        self.root = self._grow(np.arange(len(words)))

    def _grow(self, rows: np.ndarray):
        own = self.codes[rows]
        box = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        if len(rows) > LEAF and box[0] != box[1]:
            having = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1)
            bit = int(np.argmin(np.abs(2 * having.sum(axis=0, dtype=np.int64) - len(rows))))
            right = having[:, bit] == 1
            return *box, self._grow(rows[~right]), self._grow(rows[right])
        return *box, rows, None

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probe, member) of all pairs at exactly one edit; the probes have one length."""
        x, at = codes(vectors(words)), np.stack(points(words))
        more = self.points.shape[1] - at.shape[1]
        up, down = next((u, d) for m, u, d in _PAIRS if m == more)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def within(low, here, high):
            return (np.bitwise_count(low & ~here) <= up) & (np.bitwise_count(here & ~high) <= down)

        def walk(node, rows):
            low, high, left, right = node
            rows = rows[within(low, x[rows], high)]
            if not len(rows):
                return
            if right is not None:
                walk(left, rows)
                walk(right, rows)
                return
            own = self.codes[left][None]
            for a in range(0, len(rows), 4096):
                p, m = np.nonzero(within(own, x[rows[a : a + 4096], None], own))
                p, m = rows[a + p], left[m]
                for b in range(0, len(p), 1 << 15):
                    sure = one_edit(at[p[b : b + (1 << 15)]], self.points[m[b : b + (1 << 15)]])
                    found.append((p[b : b + (1 << 15)][sure], m[b : b + (1 << 15)][sure]))

        walk(self.root, np.arange(len(words)))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


NEAREST = "word string, n long, near long, best_n long, best string"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come with their members first; probes follow and pass through in batches."""
    key, words, counts, block = None, [], [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("length", "cell", "part"))))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
        for a, b in zip(cuts, cuts[1:]):
            rows = batch.slice(a, b - a)
            if keys[a] != key:
                key, words, counts, block = keys[a], [], [], None
            probe = np.asarray(rows.column("probe"))
            split = int(np.searchsorted(probe, 1))
            words += rows.column("word").slice(0, split).to_pylist()
            counts += rows.column("n").slice(0, split).to_pylist()
            if split == len(probe) or not words:
                continue
            if block is None:
                block = Block(words, np.array(counts, np.int64))
            found = _nearest(block, rows.slice(split))
            if found is not None:
                yield found


def _nearest(block: Block, rows: pa.RecordBatch) -> pa.RecordBatch | None:
    texts, counts = rows.column("word").to_pylist(), np.asarray(rows.column("n"))
    size = np.array([len(t) for t in texts])
    out = []
    for l in set(size.tolist()):
        own = np.flatnonzero(size == l)
        p, m = block.near([texts[i] for i in own])
        if not len(p):
            continue
        order = np.lexsort((m, -block.n[m], p))
        p, m = p[order], m[order]
        first = np.flatnonzero(np.append([True], p[1:] != p[:-1]))
        near = np.diff(np.append(first, len(p)))
        for i, k, best in zip(own[p[first]].tolist(), near.tolist(), m[first].tolist()):
            out.append((texts[i], int(counts[i]), k, int(block.n[best]), block.words[best]))
    if not out:
        return None
    columns = list(zip(*out))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["word", "n", "near", "best_n", "best"])


def nearest(words: DataFrame, sample: int = SAMPLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, n_near, best_n, best) of the words with a near word: their number, and the one of largest count (ties: the
    smallest in code point order). ``words`` is a table (word, n) of distinct words, read several times.

    A cell with more than ``block_chars`` characters of members is dealt by hash to as many blocks as that makes, and its
    probes go to each of them, so no block grows with the words.
    """
    cells = trees(words, sample, block_chars)
    members = staged(_members(words, cells), "members")
    blocks = members.groupBy("length", "cell").agg(F.ceil(F.count("*") * F.first("length") / block_chars).cast("long").alias("blocks"))
    # One row per cell: as many as there are blocks of words, or fewer.
    held = members.join(blocks, ["length", "cell"]).withColumn("part", F.pmod(F.xxhash64("word"), "blocks"))
    asked = _probes(words, cells).join(blocks, ["length", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    names = ["length", "cell", "part", "word", "n"]
    rows = held.select(*names, F.lit(0).alias("probe")).union(asked.select(*names, F.lit(1).alias("probe")))
    found = rows.repartition("length", "cell", "part").sortWithinPartitions("length", "cell", "part", "probe").mapInArrow(_searched, NEAREST)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    joined = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return joined.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): forms followed to the last word by doubling.

    A form is at least ``FORM_TIMES`` as frequent as its word, so chains are short and have no loop; each round halves them.
    """
    step = forms.select("word", F.col("form").alias("root"))
    while True:
        far = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = staged(step.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = TYPO_EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = FORM_TIMES, sample: int = SAMPLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of the corpus.

    Null and empty texts have no words; repeated rows count each; an empty table gives no row; other columns are not read.
    """
    words = staged(word_counts(docs, id_col, text_col, every, least_letters, least_count), "words")
    best = nearest(words, sample, block_chars)
    good = F.col("best_n") >= times * F.col("n")
    known = staged(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
