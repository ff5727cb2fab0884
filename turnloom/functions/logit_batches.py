"""The position scores of ``operators.divergence`` over Arrow batches.

Same definitions as the array expressions there, worked out for many positions at once.
Array lambdas are interpreted element by element, which is too slow for vocabularies of tens
of thousands; here each batch is a matrix. Rows are taken in slices so that the temporaries
stay small whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_ELEMENTS = 2_000_000


def _log_softmax(z: np.ndarray) -> np.ndarray:
    shifted = z - z.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def _standardized(z: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (z - z.mean(axis=1, keepdims=True)) / (1e-7 + z.std(axis=1, ddof=1, keepdims=True))


class Slice:
    """Logits of some positions, with what several measures share worked out once."""

    def __init__(self, zs: np.ndarray, zt: np.ndarray, label: np.ndarray | None, mask: np.ndarray | None) -> None:
        self.zs, self.zt, self.label, self.mask = zs, zt, label, mask
        self.ls, self.lt = _log_softmax(zs), _log_softmax(zt)
        self.s, self.t = np.exp(self.ls), np.exp(self.lt)
        self.inf_s = np.isinf(zs)
        self.inf = self.inf_s | np.isinf(zt)
        self.clean = not self.inf.any()

    def total(self, values: np.ndarray, only_student: bool = False) -> np.ndarray:
        """Row sums; elements with an infinite logit count as zero."""
        if not self.clean:
            values = np.where(self.inf_s if only_student else self.inf, 0.0, values)
        return values.sum(axis=1)

    def log_mix(self, weight_teacher: float) -> np.ndarray:
        return np.log(weight_teacher * self.t + (1.0 - weight_teacher) * self.s)

    def fkl(self) -> np.ndarray:
        return -self.total(self.t * self.ls, only_student=True)

    def rkl(self) -> np.ndarray:
        return self.total(self.s * (self.ls - self.lt))

    def tvd(self) -> np.ndarray:
        return 0.5 * self.total(np.abs(self.t - self.s))

    def js(self, beta: float = 0.1) -> np.ndarray:
        lm = self.log_mix(beta)
        return (1.0 - beta) * self.total(self.s * (self.ls - lm)) + beta * self.total(self.t * (self.lt - lm))

    def sfkl(self, weight: float = 0.1) -> np.ndarray:
        return -self.total(self.t * self.log_mix(weight))

    def srkl(self, weight: float = 0.1) -> np.ndarray:
        return self.total(self.s * (self.ls - self.log_mix(1.0 - weight)))

    def adaptive_kl(self, threshold: float = 0.5, corrected: bool = False) -> np.ndarray:
        gap = np.abs(self.t - self.s)
        if corrected:
            order = np.lexsort((gap, self.t), axis=1)
            ordered, gap = np.take_along_axis(self.t, order, 1), np.take_along_axis(gap, order, 1)
        else:
            ordered = np.sort(self.t, axis=1)
        in_head = np.cumsum(ordered, axis=1) >= threshold
        head, tail = (gap * in_head).sum(axis=1), (gap * ~in_head).sum(axis=1)
        return (head * self.fkl() + tail * self.rkl()) / (head + tail)

    def ctkd(self, tau: float) -> np.ndarray:
        t = np.exp(_log_softmax(self.zt / tau))
        return -tau * tau * self.total(t * _log_softmax(self.zs / tau), only_student=True)

    def interp(self, t: float = 0.4) -> np.ndarray:
        target = np.exp(_log_softmax((1.0 - t) * self.zs + t * self.zt))
        return -self.total(target * self.ls, only_student=True)

    def lm(self) -> np.ndarray:
        out = np.full(len(self.ls), np.nan)
        rows = np.flatnonzero(self.mask)
        out[rows] = -self.ls[rows, self.label[rows]]
        return out

    def dkd(self, alpha: float = 1.0, beta: float = 0.5, tau: float = 1.0, pad_id: int = 0, standardize: bool = False) -> np.ndarray:
        rows = np.arange(len(self.zs))
        target = np.where(self.mask == 1, self.label, pad_id)
        zs, zt = ((_standardized(z) if standardize else z) / tau for z in (self.zs, self.zt))

        def kl(log_p: np.ndarray, log_q: np.ndarray) -> np.ndarray:
            p = np.exp(log_p)
            return np.where(p > 0, p * (log_p - log_q), 0.0).sum(axis=1)

        def hit_or_rest(z: np.ndarray) -> np.ndarray:
            p = np.exp(_log_softmax(z))
            hit = p[rows, target].copy()
            p[rows, target] = 0.0
            return np.log(np.stack([hit, p.sum(axis=1)], axis=1))

        def rest_only(z: np.ndarray) -> np.ndarray:
            z = z.copy()
            z[rows, target] -= 1000.0
            return _log_softmax(z)

        binary = kl(hit_or_rest(zt), hit_or_rest(zs))
        return tau**2 * (alpha * binary + beta * kl(rest_only(zt), rest_only(zs))) * self.mask


def _matrix(lists: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)


def scorer(kinds: dict[str, dict]) -> Callable[..., pa.Array]:
    """Batch function: student lists, teacher lists [, next label, mask] -> struct of scores."""

    def score(student: pa.Array, teacher: pa.Array, *aligned: pa.Array) -> pa.Array:
        n = len(student)
        out = {k: np.full(n, np.nan) for k in kinds}
        label, mask = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in aligned) if aligned else (None, None)
        widths = pc.list_value_length(student).to_numpy(zero_copy_only=False)
        with np.errstate(divide="ignore", invalid="ignore"):
            for width in np.unique(widths):
                same = np.flatnonzero(widths == width)
                step = max(1, SLICE_ELEMENTS // max(int(width), 1))
                for at in range(0, len(same), step):
                    rows = same[at : at + step]
                    part = Slice(
                        _matrix(student, rows, int(width)), _matrix(teacher, rows, int(width)),
                        None if label is None else label[rows], None if mask is None else mask[rows],
                    )
                    for kind, params in kinds.items():
                        out[kind][rows] = getattr(part, kind)(**params)
        masked = {"lm": None if mask is None else mask == 0}
        arrays = [pa.array(v, pa.float64(), mask=masked.get(k)) for k, v in out.items()]
        return pa.StructArray.from_arrays(arrays, names=list(out))

    return score
