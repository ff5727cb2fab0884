"""Adaptive context-mixing range coder for token ids, for many lanes in step.

A block is cut into lanes of equal length. All lanes share one model and advance together: the ids at one position of
every lane are coded with the model as it was before that position, then the model learns them. So a block adapts like
a sequential coder while each step is a handful of NumPy operations. Blocks start from an empty model.

Three predictions are summed with weights: the id last seen after the two ids before it (order 2), the one last seen
after the id before it (order 1), each with all of its share on that id, and adaptive counts of all ids (order 0). The
probability of an id is the weighted sum of what the orders give it, and one interval of that sum codes it. Weights are
kept per confidence of the two contexts and their agreement; each order earns the share it had in the probability of
the id that came. All arithmetic is in integers, or in doubles where the integer part is certain, so that every
machine decodes alike.
"""

from __future__ import annotations

import numpy as np

LANES = 8192
_STEPS = 512
_CONTEXTS = 1 << 20
_GAIN = 24
_REFRESH = 4
_U = np.uint64
_TOP, _SECOND, _BOTTOM = _U(1 << 48), _U(1 << 32), _U(1 << 44)
_MASK, _WORD, _SHIFT = _U((1 << 44) - 1), _U(16), _U(48)
# Weights times counts stay under 2 ** 37, far below the smallest range of a lane (2 ** 44).
_WEIGHT_UNIT = 1 << 12
_COUNT_LIMIT = 1 << 24
_CREDIT = 1 << 10
_CREDIT_LIMIT = 1 << 24
_SLOT_BITS = 16
#: How sure a guess is, 0 to 7, after a miss (first eight) or a hit.
_SURER = np.concatenate([np.arange(8) >> 1, np.minimum(np.arange(8) + 1, 7)]).astype(np.int32)


class _Model:
    def __init__(self, alphabet: int, lanes: int):
        self.counts, self.total = np.ones(alphabet, np.int64), alphabet
        self.cumulative = np.zeros(alphabet + 1, np.int64)
        # The id last seen in a context, and in the lowest three bits how sure it is; narrow, as both are read at random.
        kind = np.int32 if alphabet <= 1 << 28 else np.int64
        self.seen1, self.seen2 = np.zeros(alphabet, kind), np.zeros(_CONTEXTS, kind)
        self.credit = np.full((128, 3), _CREDIT, np.int64)
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.recent, self.slots = 0, [], None

    def look(self) -> None:
        """Predictions of every lane at this position, with the mass that each order puts on its own."""
        if self.step % _REFRESH == 0:
            # Counts are read here only, so the ids of all steps since are counted at once.
            if self.recent:
                recent = np.concatenate(self.recent)
                np.add.at(self.counts, recent, _GAIN)
                self.total, self.recent = self.total + _GAIN * len(recent), []
            # No count falls below one, so halving ends only above the size of the alphabet.
            while self.total > max(_COUNT_LIMIT, 2 * len(self.counts)):
                self.counts = (self.counts + 1) >> 1
                self.total = int(self.counts.sum())
            np.cumsum(self.counts, out=self.cumulative[1:])
            self.slots = None
        self.step += 1
        self.at2 = (self.last * 40503 + self.before * 10007) & (_CONTEXTS - 1)
        seen1, seen2 = self.seen1.take(self.last), self.seen2.take(self.at2)
        self.guess1, self.guess2 = seen1 >> 3, seen2 >> 3
        self.c1, self.c2 = seen1 & 7, seen2 & 7
        # At most 127, so eight bits hold it.
        self.context = ((self.c2 << 4) + (self.c1 << 1) + (self.guess1 == self.guess2)).astype(np.int64)
        weights = np.maximum(1, self.credit * _WEIGHT_UNIT // self.credit.sum(axis=1, keepdims=True))
        masses = weights * self.total
        self.weight0 = weights[:, 0].take(self.context)
        self.mass1, self.mass2 = masses[:, 1].take(self.context), masses[:, 2].take(self.context)
        self.unit = masses.sum(axis=1).take(self.context)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of every lane's id in the mixture, in units of ``unit``."""
        narrow = ids.astype(self.seen1.dtype)
        start = self.weight0 * self.cumulative.take(ids) + self.mass1 * (self.guess1 < narrow) + self.mass2 * (self.guess2 < narrow)
        self.hit1, self.hit2 = self.guess1 == narrow, self.guess2 == narrow
        self.parts = self.weight0 * self.counts.take(ids), self.mass1 * self.hit1, self.mass2 * self.hit2
        return start, self.parts[0] + self.parts[1] + self.parts[2]

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose interval holds ``value``: both point masses are taken out in id order, the rest is order 0.

        What lies in a point mass falls on the end of its id's share of order 0, and what lies above it moves down by it.
        """
        near, far = np.minimum(self.guess1, self.guess2), np.maximum(self.guess1, self.guess2)
        # Products in place of np.where, whose branches cannot be foretold here.
        low = self.mass1 + (self.mass2 - self.mass1) * (self.guess1 > self.guess2)
        rest = value
        for guess, mass in ((near, low), (far, self.mass1 + self.mass2 - low)):
            end = self.weight0 * self.cumulative.take(guess + 1) - 1
            rest = rest - np.minimum(np.maximum(rest - end, 0), mass)
        # Numbers below 2 ** 37 over one below 2 ** 13: a quotient in doubles never rounds up to an integer.
        return self._placed((rest / self.weight0).astype(np.int64))

    def _placed(self, sought: np.ndarray) -> np.ndarray:
        """The id at a place of order 0: the one at the start of the place's slot, or one behind it, which is searched."""
        if self.slots is None:
            self.shift = max(0, self.total.bit_length() - _SLOT_BITS)
            # Slot k starts at k << shift; an id is repeated for all slots that start in it.
            edges = (self.cumulative + ((1 << self.shift) - 1)) >> self.shift
            self.slots = np.repeat(np.arange(len(self.counts), dtype=np.int32), np.diff(edges))
        found = self.slots.take(sought >> self.shift).astype(np.int64)
        behind = np.flatnonzero(self.cumulative.take(found + 1) <= sought)
        if len(behind):
            # Neighbours in order share most of the way through the table.
            order = np.sort(sought.take(behind) * len(sought) + behind)
            place, lane = np.divmod(order, len(sought))
            found[lane] = np.searchsorted(self.cumulative, place, side="right") - 1
        return found

    def learn(self, ids: np.ndarray) -> None:
        """Uses the parts that ``interval`` found for the same ids."""
        self.recent.append(ids)
        # Where neither guess came true, order 0 earned all.
        at = np.flatnonzero(self.hit1 | self.hit2)
        context = self.context.take(at)
        self.credit[:, 0] += (np.bincount(self.context, minlength=128) - np.bincount(context, minlength=128)) * _CREDIT
        parts = [part.take(at) for part in self.parts]
        whole = parts[0] + parts[1] + parts[2]
        for order, part in enumerate(parts):
            # Parts are below 2 ** 38, so a quotient in doubles never rounds up to an integer, and the sums are exact.
            earned = np.floor(part * _CREDIT / whole)
            self.credit[:, order] += np.bincount(context, weights=earned, minlength=128).astype(np.int64)
        full = self.credit.sum(axis=1) > _CREDIT_LIMIT
        if full.any():
            self.credit[full] = (self.credit[full] + 1) >> 1
        narrow = ids.astype(self.seen1.dtype)
        for guess, hit, seen, c, at in ((self.guess1, self.hit1, self.seen1, self.c1, self.last), (self.guess2, self.hit2, self.seen2, self.c2, self.at2)):
            # A guess that came true is the id; one that failed is kept while it is sure.
            known = narrow + (guess - narrow) * (c > 1)
            seen[at] = (known << 3) | _SURER.take(c + hit * np.int32(8))
        self.before, self.last = self.last, ids


class _Coder:
    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, (1 << 64) - 1, _U)

    def narrow(self, part: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        self.low += part * start.view(_U)
        self.range = part * width.view(_U)

    def _fixed(self, low: np.ndarray, span: np.ndarray, lanes: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the upper 16 bits of each lane are fixed, the bits that can change, and the lanes whose range was cut for it."""
        differ = low ^ (low + span)
        ready = differ < _TOP
        small = np.flatnonzero((span < _BOTTOM) > ready)
        if len(small):
            self.range[small if isinstance(lanes, slice) else lanes[small]] = (~low[small] + _U(1)) & _MASK
            ready[small] = True
        return ready, differ, small

    def settle(self):
        """Masks or lists of lanes whose upper 16 bits are fixed, again and again; the caller moves one word for each.

        The first is a mask of all lanes. A lane that was not ready stays so until the next step.
        """
        ready, differ, small = self._fixed(self.low, self.range, slice(None))
        yield ready
        shift = ready * _WORD
        # All lanes are shifted, many of them by a word: cheaper than picking them out.
        self.low <<= shift
        self.range <<= shift
        again = ready & ((differ < _SECOND) | (self.range < _BOTTOM))
        again[small] = True
        lanes = np.flatnonzero(again)
        while len(lanes):
            ready = self._fixed(self.low[lanes], self.range[lanes], lanes)[0]
            lanes = lanes[ready]
            if len(lanes):
                yield lanes
                self.low[lanes] <<= _WORD
                self.range[lanes] <<= _WORD


def encode(ids: np.ndarray, alphabet: int, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint16, lane after lane) and the number of words of each lane."""
    # A lane learns nothing of its own step, so short blocks take fewer lanes rather than fewer steps.
    lanes = max(1, min(lanes, len(ids) // _STEPS))
    steps = -(-len(ids) // lanes) if len(ids) else 0
    grid = np.zeros(lanes * steps, ids.dtype)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, steps).T.copy()
    model, coder, out = _Model(alphabet, lanes), _Coder(lanes), []
    every = np.arange(lanes, dtype=np.uint16)
    for row in grid:
        x = row.astype(np.int64)
        model.look()
        coder.narrow(coder.range // model.unit.view(_U), *model.interval(x))
        for ready in coder.settle():
            at = np.flatnonzero(ready) if ready.dtype == bool else ready
            out.append((at.astype(np.uint16), (coder.low.take(at) >> _SHIFT).astype(np.uint16)))
        model.learn(x)
    for _ in range(4):
        out.append((every, (coder.low >> _SHIFT).astype(np.uint16)))
        coder.low <<= _WORD
    lane = np.concatenate([a for a, _ in out])
    words = np.concatenate([w for _, w in out])
    return words[np.argsort(lane, kind="stable")], np.bincount(lane, minlength=lanes)


def decode(words: np.ndarray, per_lane: np.ndarray, length: int, alphabet: int) -> np.ndarray:
    """The ids that ``encode`` was given."""
    lanes = len(per_lane)
    steps = -(-length // lanes) if length else 0
    model, coder = _Model(alphabet, lanes), _Coder(lanes)
    words = np.append(words, np.zeros(1, words.dtype))
    place = np.cumsum(per_lane) - per_lane
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _WORD) | words[place]
        place += 1
    grid = np.empty((steps, lanes), np.uint32)
    for t in range(steps):
        model.look()
        unit = model.unit.view(_U)
        part = coder.range // unit
        x = model.find(np.minimum((code - coder.low) // part, unit - _U(1)).view(np.int64))
        coder.narrow(part, *model.interval(x))
        for ready in coder.settle():
            if ready.dtype == bool:
                code <<= ready * _WORD
                code |= words.take(place) * ready
                place += ready
            else:
                code[ready] = (code[ready] << _WORD) | words[place[ready]]
                place[ready] += 1
        model.learn(x)
        grid[t] = x
    return grid.T.reshape(-1)[:length]
