"""ROUGE-L helper for Arrow batches: Porter stems and longest common subsequence."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiou")

# Irregular stems and suffix tables of the published algorithm (with the
# extensions its common Python implementation has).
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """Consonant/vowel string; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in _VOWELS or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc_end(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return len(word) > 2 and shape[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("ss") or not w.endswith("s"):
        return w
    return w[:-1]


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
            stem = w[: -len(suffix)]
            break
    else:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_end(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    if _measure(stem) == 1 and _cvc_end(stem):
        return stem + "e"
    return stem


def _final_y(w: str) -> str:
    """y -> i after a consonant that is not the word's first letter."""
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        return w[:-1] + "i"
    return w


def _swap(w: str, table) -> str:
    for suffix, new in table:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            # "logi" counts its own l as part of the stem.
            enough = _measure(w[:-3]) > 0 if suffix == "logi" else _measure(stem) > 0
            return stem + new if enough else w
    return w


def _long_forms(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _long_forms(w[:-4] + "al")
    return _swap(w, STEP2)


def _residue(w: str) -> str:
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            ok = _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t"))
            return stem if ok else w
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc_end(stem)):
            return stem
    return w


def _final_l(w: str) -> str:
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _long_forms, lambda w: _swap(w, STEP3), _residue, _final_e, _final_l):
        word = step(word)
    return word


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one machine-word-parallel pass per item of ``b``."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def f_measure(lcs: int, n_target: int, n_pred: int) -> float:
    if not lcs:
        return 0.0
    precision, recall = lcs / n_pred, lcs / n_target
    return 2 * precision * recall / (precision + recall)
