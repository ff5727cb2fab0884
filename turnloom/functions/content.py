"""Column expressions over mixed-type message content held as VARIANT.

A content value may be null, a string, a number or a list whose items are strings or
objects. Kept parts have the shape ``struct<modality, text, raw variant>``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnloom.functions.text import apply_thinking, lookup, strip

# Placeholders and the key probes that reveal a part's modality, in order.
PLACEHOLDERS = {
    "image": "[IMAGE]",
    "video": "[VIDEO]",
    "audio": "[AUDIO]",
    "document": "[DOCUMENT]",
}
MODALITY_KEYS = (
    ("image", ("image", "image_url")),
    ("video", ("video", "video_url")),
    ("audio", ("audio", "audio_url")),
    ("document", ("document", "file")),
    ("text", ("text",)),
)
PART_TYPE = "struct<modality:string,text:string,raw:variant>"


def _member(obj: Column, key: str) -> Column:
    """Member as VARIANT: SQL NULL when the key is missing, variant null when it holds null."""
    return F.try_variant_get(obj, f"$.{key}", "variant")


def kind(value: Column) -> Column:
    """One of null, string, list, object, boolean, scalar."""
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(shape == "STRING", "string")
        .when(shape.startswith("ARRAY"), "list")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape == "BOOLEAN", "boolean")
        .otherwise("scalar")
    )


def scalar_text(value: Column) -> Column:
    """Text of a single value: strings as they are, True/False/None spelled that way."""
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | F.is_variant_null(value), "None")
        .when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text))
        .otherwise(F.coalesce(text, F.to_json(value)))
    )


def part_modality(part: Column) -> Column:
    """Explicit ``type`` first, else the first telling key, else ``unknown``."""
    declared = _member(part, "type")
    named = F.when(declared.isNotNull(), F.lower(strip(scalar_text(declared))))
    probe = F
    for modality, keys in MODALITY_KEYS:
        found = _member(part, keys[0]).isNotNull()
        for key in keys[1:]:
            found = found | _member(part, key).isNotNull()
        probe = probe.when(found, modality)
    return F.coalesce(F.nullif(named, F.lit("")), probe.otherwise("unknown"))


def placeholder(modality: Column) -> Column:
    base = F.split_part(modality, F.lit("."), F.lit(1))
    return F.coalesce(lookup(PLACEHOLDERS, base), F.concat(F.lit("["), F.upper(base), F.lit("]")))


def parts_of(value: Column) -> Column:
    """Items of a list value as parts; string items become text parts."""

    def one(item: Column) -> Column:
        is_string = kind(item) == "string"
        modality = (
            F.when(is_string, "text")
            .when(kind(item) == "object", part_modality(item))
            .otherwise(F.lit(None).cast("string"))
        )
        own_text = _member(item, "text")
        text = F.when(is_string, F.try_variant_get(item, "$", "string")).when(
            modality == "text", F.when(own_text.isNull(), "").otherwise(scalar_text(own_text))
        )
        return F.struct(modality.alias("modality"), text.alias("text"), item.alias("raw"))

    items = F.try_variant_get(value, "$", "array<variant>")
    # The JSON null inside a list arrives as SQL NULL; it is as unsupported as a number.
    return F.transform(items, one)


def text_part(text: Column) -> Column:
    """One-element part list around plain text."""
    return F.array(
        F.struct(F.lit("text").alias("modality"), text.alias("text"), F.lit(None).cast("variant").alias("raw"))
    ).cast(f"array<{PART_TYPE}>")


def part_error(parts: Column, mode: str) -> Column:
    """Reason why a part list is not allowed in the given mode, null when it is fine."""
    reason = F.when(
        F.exists(parts, lambda p: p["modality"].isNull()), "unsupported content item type"
    )
    if mode == "strict":
        reason = reason.when(
            F.exists(parts, lambda p: p["modality"] != "text"), "multimodal content in strict mode"
        )
    if mode == "preserve":
        reason = reason.when(
            F.exists(parts, lambda p: p["modality"] == "unknown"), "unsupported multimodal content item"
        )
    return reason


def render_parts(parts: Column, mode: str) -> Column:
    """Text of a part list; other modalities become placeholders or vanish (text-only)."""
    if mode == "text-only":
        parts = F.filter(parts, lambda p: p["modality"] == "text")
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p["modality"] == "text", p["text"]).otherwise(placeholder(p["modality"])),
        ),
        "",
    )


def text_simple(parts: Column) -> Column:
    """Preset variant: only parts declared as text count, everything else is dropped."""
    declared = F.filter(
        parts, lambda p: F.try_variant_get(p["raw"], "$.type", "string") == "text"
    )
    return F.array_join(
        F.transform(declared, lambda p: F.coalesce(F.try_variant_get(p["raw"], "$.text", "string"), F.lit(""))), ""
    )


def render_response(value: Column, mode: str, thinking: str) -> Column:
    """Response text of a raw content value."""
    rendered = (
        F.when(kind(value) == "null", "")
        .when(kind(value) == "list", render_parts(parts_of(value), mode))
        .otherwise(scalar_text(value))
    )
    return apply_thinking(rendered, thinking)


def _ref(part: Column, names: tuple[str, str]) -> Column:
    """First usable reference of a part; an empty one falls back to the second key."""
    first, second = (_member(part["raw"], n) for n in names)
    blank = F.to_json(first).isin('""', "[]", "{}", "0", "false", "null")

    def as_text(v: Column) -> Column:
        return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))

    usable = F.when(first.isNotNull() & ~blank, as_text(first))
    return F.coalesce(usable, F.when(~F.is_variant_null(second), as_text(second)))


def media_refs(messages: Column, media: str) -> Column:
    """References of one medium (``image`` or ``video``) over all messages in order, null if none."""
    names = (media, f"{media}_url")

    def of_message(message: Column) -> Column:
        hits = F.filter(
            F.coalesce(message["parts"], F.array().cast(f"array<{PART_TYPE}>")),
            lambda p: p["raw"].isNotNull() & p["modality"].startswith(media),
        )
        return F.filter(F.transform(hits, lambda p: _ref(p, names)), lambda r: r.isNotNull())

    refs = F.flatten(F.transform(messages, of_message))
    return F.when(F.size(refs) > 0, refs)
