"""Role-tag templates: messages -> one string, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from turnloom.config import PrepConfig
from turnloom.functions.text import PREFIX_ROLES, apply_thinking, lookup

ROLES = ("system", "developer", "user", "assistant", "tool")


@dataclass(frozen=True)
class Template:
    """Text around each message by role, the generation prompt, and the family switch.

    ``harmony`` marks the family that keeps the developer role, takes a reasoning effort
    and wants all leading system text in one developer message.
    """

    prefix: dict[str, str] = field(default_factory=lambda: {r: f"<|{r}|>\n" for r in ROLES})
    suffix: dict[str, str] = field(default_factory=lambda: {r: "\n<|end|>\n" for r in ROLES})
    generation: str = "<|assistant|>\n"
    harmony: bool = False

    def marker_words(self, side: dict[str, str], role: str) -> list[str]:
        return side[role].split()

    def cost(self, role: str) -> int:
        """Word tokens a message of this role costs beside its own text."""
        return len(self.marker_words(self.prefix, role)) + len(self.marker_words(self.suffix, role))

    @property
    def min_cost(self) -> int:
        return min(self.cost(r) for r in ROLES)

    @property
    def generation_words(self) -> list[str]:
        return self.generation.split()


PLAIN = Template({r: "" for r in ROLES}, {r: "\n" for r in ROLES}, "")
GENERIC = Template()
HARMONY = Template(harmony=True)


def prefix_length(messages: Column) -> Column:
    """Number of leading system/developer messages; later ones belong to the body."""
    first_other = F.array_position(
        F.transform(messages, lambda m: m["role"].isin(*PREFIX_ROLES)), F.lit(False)
    )
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(messages)).cast("int")


def prefix_split(messages: Column) -> tuple[Column, Column]:
    n = prefix_length(messages)
    return F.slice(messages, 1, n), F.slice(messages, n + 1, F.size(messages) - n)


def merge_prefix(messages: Column, thinking: str = "auto") -> Column:
    """Harmony family: non-empty leading texts become one developer message, all-empty ones go.

    Works on struct<role, text, ...>; the merged message keeps role and text only.
    """
    head, body = prefix_split(messages)
    texts = F.filter(
        F.transform(head, lambda m: apply_thinking(m["text"], thinking)), lambda t: t != ""
    )
    merged = F.array_join(texts, "\n\n")
    rest = F.transform(body, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    developer = F.array(F.struct(F.lit("developer").alias("role"), merged.alias("text")))
    return F.when(merged != "", F.concat(developer, rest)).otherwise(rest)


def render(messages: Column, template: Template, cfg: PrepConfig, generation: bool) -> Column:
    """Rendered text; with thinking off, think spans go and the whole text is trimmed."""
    body = F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                lookup(template.prefix, m["role"]), m["text"], lookup(template.suffix, m["role"])
            ),
        ),
        "",
    )
    pieces = [body]
    if template.harmony and cfg.reasoning_effort != "auto":
        lead = f"{template.prefix['system']}Reasoning: {cfg.reasoning_effort}{template.suffix['system']}"
        pieces.insert(0, F.lit(lead))
    if generation:
        pieces.append(F.lit(template.generation))
    return apply_thinking(F.concat(*pieces), cfg.enable_thinking)


def chat_pair(messages: Column, template: Template, cfg: PrepConfig) -> tuple[Column, Column, Column]:
    """(prompt text, full text, response text) of messages that end with an assistant turn."""
    if template.harmony:
        messages = merge_prefix(messages, cfg.enable_thinking)
    last = F.try_element_at(messages, F.lit(-1))
    ended = F.when(
        F.coalesce(last["role"] == "assistant", F.lit(False)), messages
    ).otherwise(F.raise_error(F.lit("the last message must be from the assistant")))
    before = F.slice(ended, 1, F.greatest(F.size(ended) - 1, F.lit(0)))
    return (
        render(before, template, cfg, generation=True),
        render(ended, template, cfg, generation=False),
        apply_thinking(last["text"], cfg.enable_thinking),
    )
