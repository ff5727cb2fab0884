"""MinHash near-duplicates with tensored banding.

A table key joins one value of a first small collection of minhash groups with one of a second: ``tables`` values on
each side give ``tables ** 2`` keys for ``2 * tables * rows`` minhashes instead of ``2 * tables ** 2 * rows``. With 10
tables of 2 rows a pair of similarity 0.8 shares no key with probability 0.00007, one of 0.85 with 0.000005.

Steps, each written to the shared folder where it is used twice:

1. Sketches of whole texts (Arrow batches, no shuffle). Rows with equal shingle sets become one class (smallest id);
   counts combine before the shuffle, so a huge group of copies costs one row per task.
2. Keys of the class representatives. Each batch first reduces a key to its smallest id and links the others to that,
   so a hot key crosses the shuffle once per batch. Sorted runs then link each id to the first of its run. Nothing is
   gathered per key.
3. One link per id is confirmed on full shingle sets; most groups are complete then.
4. Keys whose members still lie in different components are compared in full: members meet in blocks of bounded size,
   every pair once. A pair is checked on its sets if its sketches agree in at least half of the positions (one at the
   threshold fails that with probability 0.00002) and its set sizes allow the similarity. The check is made inside the
   block, so what leaves it is a forest of links, not pairs. Of a set of more than HEAD items a sample decides there; if
   confirmation refutes one of those guesses, the pairs with such a set are compared once more without a forest.

The result is one row per document; copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnloom.llm.arrow import binaries, mixed, splits, utf8
from turnloom.llm.components import components
from turnloom.llm.shingles import shingle_sets
from turnloom.sources.sinks import staged

BLOCK = 2048
#: Items of a set that meet in a block: two blocks hold 64 MB of them at most.
HEAD = 2048
#: Words of the bitmap that spares documents without a candidate the set construction; a full bitmap spares none.
FILTER_WORDS = 1 << 18


@dataclass(frozen=True)
class NearDup:
    width: int = 5
    percent: int = 80
    tables: int = 10
    rows: int = 2

    @property
    def hashes(self) -> int:
        return 2 * self.tables * self.rows


def _signatures(sets: np.ndarray, offsets: np.ndarray, hashes: int) -> np.ndarray:
    """(rows, hashes) upper 32 bits of the minima; rows without shingles must be left out."""
    factors = np.random.default_rng(77).integers(1, 1 << 63, (hashes, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(offsets) - 1, hashes), np.uint32)
    for j, (a, b) in enumerate(factors):
        x = sets * a
        x ^= x >> np.uint64(32)
        x *= b
        out[:, j] = np.minimum.reduceat(x, offsets[:-1]) >> np.uint64(32)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, how: NearDup) -> DataFrame:
    """(id, n, f1, f2, sig): set size, 128-bit set fingerprint, minhashes. Null or wordless text: n = 0."""
    width, hashes = how.width, how.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splits(batches, "text"):
            sets, at = shingle_sets(*utf8(batch.column("text")), width)
            n = np.diff(at)
            full = np.flatnonzero(n)
            prints = np.zeros((2, len(n)), np.uint64)
            sig = np.zeros((len(n), hashes), np.uint32)
            if len(full):
                heads = at[:-1][full]
                prints[0, full] = np.add.reduceat(mixed(sets), heads)
                prints[1, full] = np.bitwise_xor.reduceat(mixed(sets + np.uint64(0x5851F42D4C957F2D)), heads)
                sig[full] = _signatures(sets, np.append(heads, len(sets)), hashes)
            data = sig.view(np.uint8).reshape(-1)
            yield pa.record_batch([batch.column("id"), pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), binaries(data, np.arange(len(n) + 1) * hashes * 4)], ["id", "n", "f1", "f2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, f1 long, f2 long, sig binary")


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    data, at = utf8(column)
    return data[at[0] : at[-1]].view(np.uint32).reshape(-1, hashes)


def _values(sig: np.ndarray, how: NearDup) -> np.ndarray:
    """(rows, 2, tables): the values of the tables of both collections."""
    parts = sig.astype(np.uint64).reshape(len(sig), 2, how.tables, how.rows)
    value = np.zeros(parts.shape[:3], np.uint64)
    for r in range(how.rows):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + parts[..., r])
    return value


def _keys(sig: np.ndarray, how: NearDup) -> np.ndarray:
    """(rows, tables ** 2) keys: every value of the first collection with every one of the second."""
    value = _values(sig, how)
    number = np.arange(how.tables**2, dtype=np.uint64).reshape(how.tables, how.tables)
    return mixed(value[:, 0, :, None] * np.uint64(3) + value[:, 1, None, :] * np.uint64(0xD6E8FEB86659FD93) + number).reshape(len(sig), -1)


def _runs(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and ids ordered by both, and for each position the place where its run of equal keys begins."""
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    return key, ident, np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))


def _table_rows(reps: DataFrame, how: NearDup, links: bool) -> DataFrame:
    """Per batch: (key, smallest id) of every key, or with ``links`` the distinct (smallest id, other id) of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(_matrix(batch.column("sig"), how.hashes), how)
            ident = np.repeat(np.asarray(batch.column("id")), keys.shape[1])
            key, ident, begin = _runs(keys.reshape(-1), ident)
            here = np.arange(len(key))
            if links:
                other = ident[begin] != ident
                a, b = np.unique(np.stack([ident[begin][other], ident[other]]), axis=1)
            else:
                a, b = key[begin == here].view(np.int64), ident[begin == here]
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return reps.select("id", "sig").mapInArrow(run, "a long, b long")


def _first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (key a, id b): link each id to the first of its key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ident = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
        fresh = np.concatenate(([last is None or last[0] != key[0]], key[1:] != key[:-1]))
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
        first = np.where(begin < 0, ident[0] if last is None else last[1], ident[np.maximum(begin, 0)])
        last = key[-1], first[-1]
        other = first != ident
        if other.any():
            a, b = np.unique(np.stack([first[other], ident[other]]), axis=1)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def candidates(reps: DataFrame, how: NearDup) -> DataFrame:
    """(a, b), a < b: per key, links to its smallest id, direct or through the smallest id of a batch."""
    shared = _table_rows(reps, how, links=False).repartition("a").sortWithinPartitions("a", "b")
    across = shared.mapInArrow(_first_of_run, "a long, b long")
    return _table_rows(reps, how, links=True).union(across).distinct()


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashed ids (at most FILTER_WORDS rows reach the driver, whatever the input)."""
    h = F.xxhash64("id")
    rows = ids.select(F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) AS int))").alias("bit")).groupBy("w").agg(F.expr("bit_or(bit)").alias("bits"))
    words = np.zeros(FILTER_WORDS, np.int64)
    table = rows.toArrow()
    words[table.column("w").to_numpy()] = table.column("bits").to_numpy()
    return words


def _sets_of(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, how: NearDup) -> DataFrame:
    """(id, items): full shingle sets, sorted 64-bit hashes, of the given ids. Texts are not shuffled: the bitmap drops
    most other documents at the scan; those it lets through are harmless."""
    words, width = docs.sparkSession.sparkContext.broadcast(_filter_words(ids)), how.width
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long")).alias("h")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splits(batches, "text"):
            h = np.asarray(batch.column("h")).view(np.uint64)
            hit = (words.value.view(np.uint64)[(h >> np.uint64(6)) % np.uint64(FILTER_WORDS)] >> (h % np.uint64(64))) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            if not batch.num_rows:
                continue
            sets, at = shingle_sets(*utf8(batch.column("text")), width)
            yield pa.record_batch([batch.column("id"), binaries(sets.view(np.uint8), at * 8)], ["id", "items"])

    # A repeated id gives its class once; equal ids with other texts are linked by their id, see near_duplicates.
    return staged(rows.mapInArrow(run, "id long, items binary"), "sets")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets.

    A pair carries the set of ``b`` to the set of ``a``; an ``a`` with many partners is spread over salts of 256 partners.
    """
    percent = how.percent
    pairs = staged(pairs, "pairs")
    shares = staged(pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / 256).cast("long").alias("s")), "shares")
    salted = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "s").alias("salt"), "b")
    members = salted.join(sets, salted["b"] == sets["id"]).select("a", "salt", "b", "items")
    owners = shares.join(sets, shares["a"] == sets["id"]).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            data, offsets = utf8(batch.column("items"))
            found = []
            for i in range(batch.num_rows):
                items = data[offsets[i] : offsets[i + 1]].view(np.uint64)
                if b[i] is None:
                    own = [*(own if at == (a[i], salt[i]) else []), items.copy()]
                    at = a[i], salt[i]
                elif any(_similar(x, items, percent) for x in own):
                    found.append((a[i], b[i]))
            if found:
                yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    rows = members.union(owners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long").distinct()


def _alike(sig: np.ndarray, before: np.ndarray, n: np.ndarray, label: np.ndarray, own: np.ndarray, i: int, how: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Later rows that ``i`` has to be compared with, and in how many minhashes they agree: other label, sizes that allow
    the similarity, half of the minhashes equal, none of the values ``before``, those of the earlier tables of either
    collection, shared: so a pair is compared in the first key that it shares only.

    ``sig`` and ``before`` have a column per row. ``own``, which the rows are ordered by, tells the block of a row; where
    two blocks meet, only rows of different blocks are compared.
    """
    start = int(np.searchsorted(own, own[-1])) if own[0] != own[-1] else 0
    if start and i >= start:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    rest = slice(max(i + 1, start), None)
    agree = (sig[:, rest] == sig[:, i, None]).sum(axis=0, dtype=np.uint8)
    ok = (agree >= (how.hashes + 1) // 2) & (label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= how.percent * np.maximum(n[rest], n[i]))
    ok &= ~(before[:, rest] == before[:, i, None]).any(axis=0)
    at = np.flatnonzero(ok)
    return at + rest.start, agree[at].astype(np.int64)


def _heads_similar(heads: list[np.ndarray], n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether the set of ``i`` may be similar to each of the others, told from the HEAD smallest items of each.

    Exact where both sets are whole. Else the smaller items up to the last that both heads cover are an even sample of the
    union, and pairs down to 4.5 standard deviations under the threshold pass.
    """
    mine, most = heads[i], np.uint64(0xFFFFFFFFFFFFFFFF)
    last = lambda k: heads[k][-1] if n[k] > HEAD else most
    limit = np.array([min(last(i), last(k)) for k in others], np.uint64)
    sizes = np.array([len(heads[k]) for k in others])
    items = np.concatenate([heads[k] for k in others])
    covered = items <= np.repeat(limit, sizes)
    found = mine[np.minimum(np.searchsorted(mine, items), len(mine) - 1)] == items
    starts = np.cumsum(sizes) - sizes
    common = np.add.reduceat((found & covered).astype(np.int64), starts)
    union = np.searchsorted(mine, limit, side="right") + np.add.reduceat(covered.astype(np.int64), starts) - common
    p = percent / 100
    slack = np.where(limit == most, 0.0, 4.5 * np.sqrt(p * (1 - p) * np.maximum(union, 1)))
    return np.where(limit == most, 100 * common >= percent * union, common >= p * union - slack)


def _unsettled(reps: DataFrame, label: DataFrame, sets: DataFrame, how: NearDup, again: bool) -> DataFrame:
    """(a, b, guessed): links between different components whose members share a key.

    Members of an unsettled key meet block against block, first by minhashes only; members with a partner then meet
    once more with their sets, of which at most HEAD items are taken. What is found similar joins the groups of the block
    at once, so that a block gives no more links than it has rows, while no pair of different groups goes unchecked. Pairs
    of whole sets are settled before those with a longer set, which are guesses. With ``again`` only pairs with a
    longer set are compared, and every similar one is given.
    """
    hashes = how.hashes
    named = staged(reps.join(label, "id").select("id", "n", "sig", "label"), "named")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_matrix(batch.column("sig"), hashes), how)
                where = np.repeat(np.arange(batch.num_rows), keys.shape[1])
                number = np.tile(np.arange(keys.shape[1]), batch.num_rows)
                yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(number), *(batch.column(c).take(pa.array(where)) for c in ("id", "n", "label"))], ["key", "number", "id", "n", "label"])

    rows = named.select("id", "n", "sig", "label").mapInArrow(keyed, "key long, number long, id long, n long, label long")
    split = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c"), F.max("n").alias("top")).where("lo != hi")
    split = staged((split.where(F.col("top") > HEAD) if again else split).select("key", F.ceil(F.col("c") / BLOCK).cast("long").alias("s")), "keys")
    block = rows.drop("n").join(split, "key").withColumn("own", F.pmod(F.xxhash64("id"), "s"))
    meets = block.select("key", "number", "id", "own", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda y: F.struct(F.least("own", y).alias("x"), F.greatest("own", y).alias("y")))).alias("p"))
    full = meets.select("key", "p.x", "p.y", "own", "number", "id").join(named, "id")

    def columns(group: pa.Table) -> tuple:
        sig = _matrix(pa.concat_arrays(group.column("sig").chunks), hashes)
        value = _values(sig, how)
        one, two = divmod(group.column("number")[0].as_py(), how.tables)
        before = np.concatenate((value[:, 0, :one], value[:, 1, :two]), axis=1)
        return *(np.ascontiguousarray(x.T) for x in (sig, before)), *(np.asarray(group.column(c)) for c in ("n", "label", "own", "id"))

    def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("key", "x", "y")):
            sig, before, n, label, own, _ = columns(group)
            hit = np.zeros(len(n), bool)
            for i in range(len(n) - 1):
                at, _ = _alike(sig, before, n, label, own, i, how)
                if again and n[i] <= HEAD:
                    at = at[n[at] > HEAD]
                hit[at] = True
                hit[i] |= len(at) > 0
            if hit.any():
                yield from group.select(["key", "x", "y", "own", "number", "id"]).filter(pa.array(hit)).to_batches()

    order = ("key", "x", "y", "own", "id")
    met = full.repartition("key", "x", "y").sortWithinPartitions(*order)
    needed = staged(met.mapInArrow(with_partner, "key long, x long, y long, own long, number long, id long"), "needed")
    heads = sets.select("id", F.expr("octet_length(items) div 8").alias("n"), F.substring("items", 1, 8 * HEAD).alias("head"))
    whole = needed.join(named.drop("n"), "id").join(heads, "id")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("key", "x", "y")):
            sig, before, n, label, own, ident = columns(group)
            heads = [h for chunk in group.column("head").chunks for data, at in [utf8(chunk)] for h in np.split(data[at[0] : at[-1]].view(np.uint64), (at[1:-1] - at[0]) // 8)]
            _, team = np.unique(label, return_inverse=True)
            longer, out = n > HEAD, []
            for guessed in (True,) if again else (False, True):
                if guessed and not longer.any():
                    continue
                for i in range(len(n) - 1):
                    if longer[i] and not guessed:
                        continue
                    at, agree = _alike(sig, before, n, label, own, i, how)
                    at = at[np.argsort(-agree, kind="stable")]
                    at = at[(longer[at] | longer[i]) == guessed]
                    step = 8
                    while len(at := at[team[at] != team[i]]):
                        some, at, step = at[:step], at[step:], min(2 * step, 256)
                        for j in some[_heads_similar(heads, n, i, some, how.percent)]:
                            if team[j] != team[i]:
                                out.append((min(ident[i], ident[j]), max(ident[i], ident[j]), guessed))
                                if not again:
                                    team[team == team[j]] = team[i]
            if out:
                a, b, c = zip(*out)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["a", "b", "guessed"])

    met = whole.repartition("key", "x", "y").sortWithinPartitions(*order)
    return met.mapInArrow(links, "a long, b long, guessed boolean").distinct()


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Groups of equal key columns from ordered batches; a group holds two blocks at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)) for c in by])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[-1] != part.column(c)[0] for c in by):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: NearDup = NearDup()) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of ``docs``, components of the similarity links.

    ``component_id`` is the smallest id reachable. Rows that repeat an id are one vertex. A null or wordless text has an
    empty set and is linked with nothing; a row with a null id takes no part and has null ``component_id`` and ``kept``
    true. An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    sketch = staged(sketches(docs, id_col, text_col, how), "sketch")
    sets = sketch.where("id IS NOT NULL AND n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep != top").select("f1", "f2", "n", "rep")
    same = staged(sets, "copies")
    classes = staged(sketch.where("id IS NOT NULL AND n > 0").join(same, ["f1", "f2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), F.when(F.coalesce("rep", "id") == F.col("id"), F.col("sig")).alias("sig")), "classes")
    reps = classes.where("sig IS NOT NULL").select("id", "n", "sig")
    pairs = staged(candidates(reps, how), "candidates")
    near = staged(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "near")
    full = _sets_of(docs, id_col, text_col, near, how)
    # Ids that hold several texts, or a copy under another id, are links already.
    known = classes.where("rep != id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = staged(confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), full, how), "links")
    for again in (False, True):
        label = components(links).withColumnRenamed("id", "v")
        label = staged(near.join(label, near["id"] == label["v"], "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
        found = staged(_unsettled(reps, label, full, how, again), "found")
        sure = staged(confirmed(found.select("a", "b").distinct(), full, how), "sure")
        links = staged(links.union(sure), "links")
        if found.where("guessed").join(sure, ["a", "b"], "left_anti").isEmpty():
            break
    label = components(links.union(known)).alias("l")
    rows = sketch.select("id", F.col("n").alias("n_shingles")).alias("d").join(label, F.col("d.id") == F.col("l.id"), "left")
    rows = rows.select(F.col("d.id").alias("id"), "n_shingles", F.coalesce("label", "d.id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))

