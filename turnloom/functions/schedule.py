"""Scalar recursions of the interpolation schedule, for one block or one list of block summaries.

A step maps t to ``min(hi, max(lo, c*t + d))`` with ``c >= 0``. Such maps compose to a map of
the same kind, which is what lets blocks be summarised before they are walked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

INF = math.inf
Map = tuple[float, float, float, float]
IDENTITY: Map = (1.0, 0.0, -INF, INF)


def apply_map(f: Map, x: float) -> float:
    c, d, lo, hi = f
    return min(hi, max(lo, c * x + d if c else d))


def compose(first: Map, then: Map) -> Map:
    c, d = first[0] * then[0], then[0] * first[1] + then[1]
    return c, d, apply_map(then, first[2]), apply_map(then, first[3])


@dataclass(frozen=True)
class Schedule:
    t_start: float = 0.4
    t_end: float = 1.0
    alpha: float = 5e-4
    beta: float = 0.99
    adaptive: bool = True

    def __post_init__(self) -> None:
        if not (0.0 <= self.t_start < 1.0 and 0.0 < self.t_end <= 1.0 and 0.0 <= self.alpha <= 1.0):
            raise ValueError("need 0 <= t_start < 1, 0 < t_end <= 1, 0 <= alpha <= 1")

    def target(self, step: float, total: float) -> float:
        return self.t_start + (self.t_end - self.t_start) * step / total

    def after(self, momentum: float, prev: float, loss: float) -> float:
        change = (prev - loss) / (prev + 1e-15)
        return self.beta * momentum + (1.0 - self.beta) * change

    def momenta(self, losses: list[float], prev: float | None, momentum: float) -> Iterator[tuple[float, bool]]:
        """(momentum, whether the row only seeds) per logged loss."""
        for loss in losses:
            seeds = prev is None or math.isinf(prev)
            if not seeds:
                momentum = self.after(momentum, prev, loss)
            yield momentum, seeds
            prev = loss

    def gain(self, momentum: float) -> float:
        return self.alpha / (1.0 + math.exp(-momentum)) if momentum > -700 else 0.0

    def step_map(self, gain: float, target: float) -> Map:
        return (1.0 - gain, gain, target, self.t_end) if self.adaptive else (0.0, target, -INF, INF)

    def momentum_summary(self, losses: list[float]) -> tuple[float, float, float, float]:
        """(first loss, last loss, factor, addend): the block's effect once its first row is done."""
        start_at_zero = list(self.momenta(losses[1:], losses[0], 0.0))
        folded = sum(not seeds for _, seeds in start_at_zero)
        return losses[0], losses[-1], self.beta**folded, start_at_zero[-1][0] if start_at_zero else 0.0

    def entering_momenta(self, blocks: list[dict]) -> list[tuple[int, float | None, float]]:
        """(block, loss before it, momentum before it) for the summaries of a run in order."""
        out, prev, momentum = [], None, 0.0
        for e in blocks:
            out.append((e["b"], prev, momentum))
            (momentum, _), = self.momenta([e["first"]], prev, momentum)
            momentum, prev = e["factor"] * momentum + e["addend"], e["last"]
        return out

    def block_map(self, losses: list[float], targets: list[float], prev: float | None, momentum: float) -> Map:
        whole = IDENTITY
        for (m, seeds), target in zip(self.momenta(losses, prev, momentum), targets):
            if not seeds:
                whole = compose(whole, self.step_map(self.gain(m), target))
        return whole

    def entering_t(self, blocks: list[dict]) -> list[tuple[int, float]]:
        out, t = [], self.t_start
        for e in blocks:
            out.append((e["b"], t))
            t = apply_map((e["c"], e["d"], e["lo"], e["hi"]), t)
        return out

    def walk(
        self, losses: list[float], targets: list[float], prev: float | None, momentum: float, t: float
    ) -> Iterator[tuple[float, float, float | None]]:
        """(t, momentum, delta) after each logged loss."""
        for (m, seeds), target in zip(self.momenta(losses, prev, momentum), targets):
            if seeds:
                yield t, m, None
                continue
            gain = self.gain(m)
            delta = gain * (1.0 - t)
            t = apply_map(self.step_map(gain, target), t)
            yield t, m, delta
