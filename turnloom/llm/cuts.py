"""Places in a text where every tokenizer of this package cuts, so that the parts can be encoded apart.

Such a place is before a blank that follows a character other than white space and ``▁``. Byte-level patterns start a
piece there, because no piece goes from a non-blank to a blank; vocabularies whose pieces hold a blank at their start only
(:func:`starts_only`) never merge across it (a ``▁`` in the text is a blank to them).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

CUT = re.compile(r"(?<=[^\s▁]) ")


def parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, each but the first starting with the blank of its cut.

    A run without a cut stays whole, however long it is.
    """
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def starts_only(pieces: Iterable[str], blank: str = "▁") -> bool:
    """No piece has a blank after another character."""
    return not any(blank in p.lstrip(blank) for p in pieces)
