"""Whole texts to ids with the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut where the vocabulary's own splitting rule always cuts, so the ids of the pieces, joined, are those of the
whole text. Ids are little-endian unsigned 32-bit integers in ``bytes``: joining and checksums need no Python integers.
A text that holds a special token, or white space for which the cut is not certain, goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from turnloom.llm.arrow import utf8

#: Distinct pieces kept per generation; the older of two generations is dropped when the newer one is full.
CACHE_PIECES = 150_000
#: Distinct pieces, and their bytes, of a table that goes on from slice to slice; all are hashed once a slice.
TABLE_PIECES, TABLE_BYTES = 400_000, 1 << 24
#: White space other than blanks and line ends, and separators on which libraries disagree.
_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_DOUBLE_SPACE = ("  ", "\n\n", " \n", "\n ")
#: White space that no text has which is cut here.
_BETWEEN = "\x1c"
#: Signs that part from the letters before them; an apostrophe may not.
_MARKS = ",.;:!?*$&%#@+=~^_|/\\()[]{}<>\"`-"

#: Pieces that the library gets at once.
_AT_ONCE = 1 << 14
#: Kinds of bytes: letters of one byte, second bytes of the letters from U+00C0 to U+00FF, marks, and where pieces begin.
_LETTER, _SECOND, _MARK, _BLANK, _LINE = 1, 2, 3, 4, 5
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = _SECOND
_KINDS[list(_MARKS.encode())] = _MARK
_KINDS[32], _KINDS[10] = _BLANK, _LINE
#: Bytes of those letters.
_OF_LETTERS = (_KINDS == _LETTER) | (_KINDS == _SECOND) | (np.arange(256) == 0xC3)


def _byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Piece -> ids as bytes, in two generations."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.encode(piece, self)
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


def _joined(pieces: pa.StringArray, between: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), between)[0].as_py()


class _Table:
    """Pieces of one vocabulary in the order of their first sight, with their ids: one array each, no Python objects.

    Pieces of a slice are told apart and met with those known before in one hashing; only new ones are encoded. A table
    that has outgrown its limits goes on with the pieces of the slice at hand.
    """

    def __init__(self, encode):
        self.encode, self.names = encode, pa.array([], pa.string())
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def look(self, pieces: pa.StringArray) -> np.ndarray:
        """The place of each piece in this table; ``ids[starts[k]:starts[k + 1]]`` are the ids of place k."""
        if len(self.names) > TABLE_PIECES or self.names.nbytes > TABLE_BYTES:
            kept = np.unique(pc.drop_null(pc.index_in(pieces, self.names)).to_numpy())
            self.ids, self.starts = taken(self.ids, self.starts, kept)
            self.names = self.names.take(pa.array(kept))
        known = len(self.names)
        met = pa.concat_arrays([self.names, pieces]).dictionary_encode()
        if len(met.dictionary) > known:
            ids, sizes = self.encode(met.dictionary.slice(known))
            self.names, self.ids = met.dictionary, np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return np.asarray(met.indices)[known:]


def taken(ids: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some places, one after another, and where each place's begin."""
    counts = np.diff(starts)[places]
    ends = np.concatenate(([0], np.cumsum(counts)))
    # Id k of a place lies at the start of the place plus k.
    return ids[np.repeat(starts[places] - ends[:-1], counts) + np.arange(ends[-1])], ends


class Encoder:
    """``Encoder(path)(text)``: the ids of ``text`` as bytes, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        # Lower case, no white space and word ends, or plain byte-level pieces that carry the space before them.
        self.lower = self.model.end_of_word_suffix is not None
        # What ``_whole`` looks for, in a text of a column.
        edges = [] if self.lower else [*_DOUBLE_SPACE, r"\A[ \n]", r"[ \n]\z"]
        self.odd = "|".join([f"[{_RARE_SPACE}]", *map(re.escape, added), *edges])
        self.bare, self.spaced = _Pieces(self._bare), _Pieces(self._spaced)
        self.table = _Table(self._new)
        # Ids that a blank or a line end begins.
        entries = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens, self.ends = (np.zeros(max(entries.values(), default=0) + 1, bool) for _ in range(2))
        for starts, byte in ((self.opens, 32), (self.ends, 10)):
            starts[[i for entry, i in entries.items() if entry[:1] == self.letters[byte]]] = True
        self.points = np.array([ord(self.letters[b]) for b in range(256)], "<u4")
        self.unruled = Tokenizer(self.model)
        self.unruled.pre_tokenizer = WhitespaceSplit()

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _bare(self, piece: str, cache: _Pieces) -> bytes:
        if piece.isalpha():
            if not self.lower:
                return self._word(piece)
            if "Σ" not in piece and "İ" not in piece and unicodedata.is_normalized("NFC", piece):
                return self._word(piece.lower())
        elif (head := piece.rstrip(_MARKS)) != piece and head.isalpha():
            return cache[head] + cache[piece[len(head) :]]
        return self._library(piece)

    def _spaced(self, piece: str, cache: _Pieces) -> bytes:
        if "\n" in piece:
            head, *rest = piece.split("\n")
            line = self.bare["\n"]
            return line.join([cache[head], *(self.bare[x] for x in rest)])
        if piece.isalpha():
            return self._word(" " + piece)
        if (head := piece.rstrip(_MARKS)) != piece and head.isalpha():
            return cache[head] + self.bare[piece[len(head) :]]
        return self._library(" " + piece)

    def _whole(self, text: str) -> bool:
        """Whether the text holds what is not certain to be cut, so that the library must see all of it."""
        if "<" in text and self.special.search(text) or any(c in text for c in _RARE_SPACE):
            return True
        return not self.lower and (text[0].isspace() or text[-1].isspace() or any(x in text for x in _DOUBLE_SPACE))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self._whole(text):
            return self._library(text)
        if self.lower:
            return b"".join(map(self.bare.__getitem__, text.split()))
        head, *rest = text.split(" ")
        line = self.bare["\n"]
        return line.join([self.bare[x] for x in head.split("\n")]) + b"".join(map(self.spaced.__getitem__, rest))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin; a null text is empty.

        The texts are cut into pieces as they lie in their buffer, equal pieces are found there and looked up once.
        """
        odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, self.odd), False))
        whole = {i: self._library(texts[i].as_py()) for i in odd.tolist()}
        data, at = utf8(pc.if_else(pa.array(np.isin(np.arange(len(texts)), list(whole))), "", texts) if whole else texts)
        first, last = int(at[0]), int(at[-1])
        data = data[first:last]
        cut = np.zeros(len(data) + 1, bool)
        if self.lower:
            # A piece ends behind white space.
            cut[1:] = (data == 32) | (data == 10)
        else:
            # A piece begins at the blank before it, at a line end and behind one, and at a mark behind a letter.
            kind = _KINDS[data]
            letter = (kind == _LETTER) | (kind == _SECOND)
            letter[1:] &= (kind[1:] == _LETTER) | (data[:-1] == 0xC3)
            cut[:-1] = kind >= _BLANK
            cut[1:-1] |= (kind[:-1] == _LINE) | (kind[1:] == _MARK) & letter[:-1]
        cut[at - first] = True
        bounds = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.StringArray.from_buffers(max(0, len(bounds) - 1), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        if self.lower:
            pieces = pieces.dictionary_encode()
            found, index = self._found(pieces.dictionary), np.asarray(pieces.indices)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            ids, ends = taken(np.frombuffer(b"".join(found), "<u4"), np.concatenate(([0], np.cumsum(sizes))), index)
        else:
            index = self.table.look(pieces)
            ids, ends = taken(self.table.ids, self.table.starts, index)
        starts = ends[np.searchsorted(bounds, at - first)]
        return self._placed(ids, starts, whole) if whole else (ids, starts)

    def _found(self, pieces: pa.StringArray) -> list[bytes]:
        """The ids of each piece; one string for all, split again, is made faster than a string each."""
        if not len(pieces):
            return []
        return list(map(self.bare.__getitem__, _joined(pc.utf8_rtrim(pieces, " \n"), _BETWEEN).split(_BETWEEN)))

    def _new(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has.

        The library gets many pieces as one text, which ids that a blank begins or those of line ends part again: words
        of plain letters with the blank before them without the splitting rule, which leaves them whole; other pieces
        with their blanks in a row or as a line each. Without as many parts each piece goes there by itself.
        """
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        first = data[at[:-1]]
        other = np.add.reduceat(~_OF_LETTERS[data[at[0] : at[-1]]], at[:-1] - at[0], dtype=np.int32)
        blank = first == 32
        plain = blank & (other == 1) & (np.diff(at) > 1)
        groups = [np.flatnonzero(g) for g in (plain, blank & ~plain, ~blank & (first != 10), first == 10)]
        ids, counts = [], []
        for places, parted in zip(groups, (self._words, self._spaces, self._lines, lambda part: None)):
            for a in range(0, len(places), _AT_ONCE):
                part = pieces.take(pa.array(places[a : a + _AT_ONCE]))
                found = parted(part)
                if found is None:
                    each = [self._library(x) for x in part.to_pylist()]
                    found = np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) >> 2
                ids.append(found[0])
                counts.append(found[1])
        sizes, order = np.concatenate(counts), np.concatenate(groups)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return taken(np.concatenate(ids), np.concatenate(([0], np.cumsum(sizes))), back)[0], sizes[back]

    def _words(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray] | None:
        data, at = utf8(pieces)
        # Each byte as the vocabulary writes it, and a blank that the words are parted at in place of the rule.
        points = np.insert(self.points[data[at[0] : at[-1]]], at[:-1] - at[0], 32)
        return self._parted(self.unruled, points.tobytes().decode("utf-32-le"), self.opens, len(pieces))

    def _spaces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray] | None:
        return self._parted(self.tokenizer, _joined(pieces, ""), self.opens, len(pieces))

    def _lines(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray] | None:
        found = self._parted(self.tokenizer, "\n" + _joined(pieces, "\n"), self.ends, len(pieces))
        return found and (np.delete(found[0], np.cumsum(found[1]) - found[1]), found[1] - 1)

    def _parted(self, tokenizer, text: str, opens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of ``text`` and how many each part has, if as many parts as expected begin with an id in ``opens``."""
        if self.special.search(text):
            return None
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(opens[ids])
        return (ids, np.diff(np.append(at, len(ids)))) if len(at) == parts and not at[0] else None

    @staticmethod
    def _placed(ids: np.ndarray, starts: np.ndarray, whole: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of whole texts put in their places, which are empty so far."""
        parts, before = [], 0
        sizes = np.diff(starts)
        for i in sorted(whole):
            parts += [ids[before : starts[i]], np.frombuffer(whole[i], "<u4")]
            before, sizes[i] = starts[i], len(whole[i]) // 4
        return np.concatenate([*parts, ids[before:]]), np.concatenate(([0], np.cumsum(sizes)))


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file. The package travels to the workers by value with each task, so what
    shall outlive a task is kept in a module that the worker itself holds."""
    kept = sys.modules.setdefault("turnloom_worker_state", types.ModuleType("turnloom_worker_state")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
