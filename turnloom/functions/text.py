"""Column expressions over roles and plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Role vocabulary, think-span and transcript patterns, punctuation set.
ROLE_ALIASES = {
    "assistant": "assistant",
    "bot": "assistant",
    "gpt": "assistant",
    "model": "assistant",
    "tool": "tool",
    "function": "tool",
    "system": "system",
    "developer": "developer",
    "user": "user",
    "human": "user",
}
PREFIX_ROLES = ("system", "developer")
THINK_SPAN = r"(?sU)<think>\s*.*?\s*</think>\s*"
TRANSCRIPT_MESSAGE = (
    r"(?sd)<\|start\|>assistant"
    r"(?:<\|channel\|>([^<]+))?"
    r"(?:<\|recipient\|>[^<]+)?"
    r"<\|message\|>(.*?)(?=(?:<\|end\|>|<\|return\|>|$))"
)
SPECIAL_TOKEN = r"<\|[^>]+\|>"
CHANNEL_WORDS = r"assistant(?:analysis|commentary|final)+"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# str.strip()/str.split() whitespace; the four separators are not in Java's Unicode \s.
_WS = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(text, f"(?U)^{_WS}+|{_WS}+$", "")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"(?U){_WS}+", " "))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Map a key column through a small literal dictionary; null when absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def role_or_null(raw: Column, preserve_developer: bool = False) -> Column:
    """Canonical role, null when the raw role is not in the vocabulary."""
    aliases = dict(ROLE_ALIASES)
    if not preserve_developer:
        aliases["developer"] = "system"
    return lookup(aliases, F.lower(strip(F.coalesce(raw, F.lit("none")))))


def canonical_role(raw: Column, preserve_developer: bool = False) -> Column:
    """Canonical role; an unknown role fails the job."""
    message = F.concat(F.lit("unsupported role: "), F.coalesce(raw, F.lit("null")))
    return F.coalesce(role_or_null(raw, preserve_developer), F.raise_error(message))


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(text, THINK_SPAN, "")


def apply_thinking(text: Column, mode: str) -> Column:
    """Only the mode ``false`` removes think spans, and then trims as well."""
    return strip(strip_thinking(text)) if mode == "false" else text


def clean_generated(text: Column) -> Column:
    return strip(strip_thinking(text))


def prompt_join(prompt: Column, extra: Column) -> Column:
    """Prompt and input parted by a blank line when both are there."""
    return F.concat_ws(
        "\n\n", F.nullif(prompt.cast("string"), F.lit("")), F.nullif(extra.cast("string"), F.lit(""))
    )


def visible_text(raw: Column) -> Column:
    """Visible part of a channel-marked transcript.

    All bodies of the final channel win; without one, the other bodies; without any
    message, the raw text minus special tokens and run-together channel words.
    """
    pieces = F.zip_with(
        F.regexp_extract_all(raw, F.lit(TRANSCRIPT_MESSAGE), F.lit(1)),
        F.regexp_extract_all(raw, F.lit(TRANSCRIPT_MESSAGE), F.lit(2)),
        lambda channel, body: F.struct(
            strip(channel).alias("channel"),
            strip(F.regexp_replace(body, SPECIAL_TOKEN, "")).alias("body"),
        ),
    )
    bare = F.regexp_replace(F.regexp_replace(raw, SPECIAL_TOKEN, ""), CHANNEL_WORDS, "")

    def joined(parts: Column) -> Column:
        return strip(F.array_join(F.transform(parts, lambda p: p["body"]), "\n"))

    def choose(spoken: Column) -> Column:
        final = F.filter(spoken, lambda p: p["channel"] == "final")
        picked = F.when(F.exists(spoken, lambda p: p["channel"] == "final"), final).otherwise(spoken)
        return F.when(F.size(spoken) > 0, joined(picked)).otherwise(strip(bare))

    return bind(F.filter(pieces, lambda p: p["body"] != ""), choose)


def norm_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single blanks; articles stay."""
    return collapse_whitespace(F.translate(F.lower(text), ASCII_PUNCTUATION, ""))


def words(text: Column) -> Column:
    """Whitespace tokens."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")
