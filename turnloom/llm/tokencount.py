"""Token counts of whole texts by the whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that give exactly their own token are
proven. A text is cut into its pre-tokens, the pieces inside which merges happen. A pre-token that is a proven string
counts one without being encoded; only the others are merged, and their counts are kept in a table of bounded size.

Two kinds of vocabulary are read: byte-level BPE of the ``tokenizers`` library (``.json``) and BPE of ``sentencepiece``
(``.model``). Both are counted as the library does by default: special strings of a ``.json`` file inside a text are one
token each, those of a ``.model`` file are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from turnloom.llm import cuts
from turnloom.llm.bpe import _byte_letters

LIMIT = 1024
#: Counts kept beside the proven strings; when full, the table starts again from the proven ones.
KEPT = 400_000
#: Characters whose pre-tokens are found at once.
PART = 1 << 20
#: Characters below this whose class is tested against the library; a text with another one is cut by the library.
TESTED = 0x3000
#: The published byte-level pattern; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counts(dict):
    """Pre-token -> number of tokens: the proven strings, and others once they are merged."""

    def __init__(self, proven: list[str], merge):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.merge, self.merged = proven, merge, 0

    def __missing__(self, piece: str) -> int:
        if self.merged >= KEPT:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
            self.merged = 0
        self.merged += 1
        n = self[piece] = self.merge(piece)
        return n


class ByteLevel:
    """Counter for a byte-level ``tokenizers`` file without normaliser."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.pattern = regex.compile(PATTERN)
        self.odd = re.compile(f"[^{self._tested()}]")
        self.counts = Counts(self.proven(), self._merge)

    def _tested(self) -> str:
        """A character class: the characters that the library puts into the class that the pattern gives them."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        ranges, first = [], None
        for c in range(TESTED + 1):
            probe = f"a{chr(c)}a1{chr(c)}1 {chr(c)}!" if c < TESTED else ""
            same = bool(probe) and [b - a for _, (a, b) in cut(probe)] == list(map(len, self.pattern.findall(probe)))
            if same and first is None:
                first = c
            elif not same and first is not None:
                ranges.append(f"\\U{first:08x}-\\U{c - 1:08x}")
                first = None
        return "".join(ranges)

    def proven(self) -> list[str]:
        """The vocabulary's strings that are valid text and give their own token, and only that, when encoded alone."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ids, texts = list(vocabulary.values()), self.tokenizer.decode_batch([[i] for i in vocabulary.values()], skip_special_tokens=False)
        alone = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [t for t, i, e in zip(texts, ids, alone) if e.ids == [i]]

    def _merge(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def __call__(self, text: str) -> int:
        # Special strings stand apart before anything else is cut; the text after one starts anew.
        spans, total, at = self.special.finditer(text), 0, 0
        for found in spans:
            total += 1 + self._plain(text[at : found.start()])
            at = found.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        count = self.counts.__getitem__
        total = 0
        for part in cuts.parts(text, PART):
            if self.odd.search(part):
                pieces = [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            else:
                pieces = self.pattern.findall(part)
            total += sum(map(count, pieces))
        return total


class Pieces:
    """Counter for a ``sentencepiece`` BPE file. Pre-tokens are the parts between safe cuts: no merge crosses one."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # A probe shows that the model keeps every blank and adds one at the start.
        probe = self.model.encode("a  b ", out_type=str)
        if not cuts.starts_only(names) or "".join(probe) != "▁a▁▁b▁":
            raise ValueError(f"{path} merges across blanks or changes them")
        self.blank = 1 if "▁" in names else len(" ".encode())
        texts = [n[1:].replace("▁", " ") for n in names if n.startswith("▁") and len(n) > 1]
        alone = self.model.encode(texts, num_threads=1)
        self.counts = Counts([t for t, e in zip(texts, alone) if len(e) == 1 and "▁" + t.replace(" ", "▁") == names[e[0]]], self._merge)

    def _merge(self, piece: str) -> int:
        # The empty piece is a blank at the end of the text; alone, the library would give nothing for it.
        return len(self.model.encode(piece)) if piece else self.blank

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        count, total = self.counts.__getitem__, 0
        for n, part in enumerate(cuts.parts(text, PART)):
            total += sum(map(count, cuts.CUT.split(part[1:] if n else part)))
        return total


def counter(path: str) -> ByteLevel | Pieces:
    """One counter, with its proof, per worker and file; it outlives the task."""
    kept = sys.modules.setdefault("turnloom_worker_state", types.ModuleType("turnloom_worker_state")).__dict__
    name = f"count {path}"
    if name not in kept:
        kept[name] = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    return kept[name]


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text column; null counts as empty."""

    @F.arrow_udf("long")
    def count(batch: pa.Array) -> pa.Array:
        tokens = counter(path)
        return pa.array([tokens(t.as_py() or "") for t in batch], pa.int64())

    return count(text)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row, in place, without a shuffle.

    Null and empty texts have no bytes and no tokens; repeated rows and null ids are counted each; an empty table gives no
    row; other columns are not read. Texts are cut in parts of ``PART`` characters at safe places, so a very long text
    needs no list of all its pre-tokens; a run without a blank is one part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
