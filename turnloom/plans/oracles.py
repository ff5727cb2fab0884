"""The registered queries once more, as SQL over the same tables (checked with DuckDB)."""

from __future__ import annotations

from turnloom.plans.fixtures import RAW_ROLE

ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
#: Used several times by one query, and dear to repeat.
MATERIALIZED = ("page_count", "contents", "items", "parts", "emb_count", "lg", "al")


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def oracle(name: str, needs: tuple[str, ...], body: str) -> None:
    order: list[str] = []

    def add(n: str) -> None:
        for dep in CTES[n][0]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({CTES[n][1]})" for n in order)
    ORACLES[name] = f"WITH RECURSIVE {head}\n{body}" if order else body


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def unthink(x: str) -> str:
    return rf"regexp_replace({x}, '<think>\s*.*?\s*</think>\s*', '', 'gs')"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def pad_right(x: str, n: int, fill: int) -> str:
    return f"list_concat({x}[1:{n}], list_transform(range(greatest({n} - len({x}), 0)), lambda z: {fill}))"


def pad_left(x: str, n: int, fill: int) -> str:
    return f"list_concat(list_transform(range(greatest({n} - len({x}), 0)), lambda z: {fill}), {x}[1:{n}])"


def tail(x: str, k: str) -> str:
    return f"{x}[greatest(len({x}) - ({k}), 0) + 1 : len({x})]"


def unit(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) / 4294967296.0)"


def place(seed: int, key: str) -> str:
    return f"(row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) - 1)"


def capped(size: int) -> str:
    return f"least({size}, greatest(1, count(*) OVER () - 1))"


# --- messages ------------------------------------------------------------------------

cte("raw", (), f"SELECT conv_id, turn, text, {RAW_ROLE} AS raw FROM conversations")
ROLE = """CASE {r} WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'gpt' THEN 'assistant'
  WHEN 'model' THEN 'assistant' WHEN 'tool' THEN 'tool' WHEN 'function' THEN 'tool' WHEN 'system' THEN 'system'
  WHEN 'developer' THEN '{d}' WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' END"""
_key = f"lower({strip('raw')})"
cte(
    "canon", ("raw",),
    f"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text,
    {ROLE.format(r=_key, d='system')} AS role, {ROLE.format(r=_key, d='developer')} AS role_h FROM raw""",
)
cte(
    "pairs", (),
    """SELECT a.conv_id, a.turn, u.text AS user_text, a.text AS answer_text, s.text AS system_text FROM conversations a
    LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
    LEFT JOIN conversations s ON s.conv_id = a.conv_id AND s.turn = a.turn - 2 AND s.role = 'system' WHERE a.role = 'assistant'""",
)
cte(
    "alpaca", ("pairs",),
    """SELECT conv_id, turn, split_part(user_text, chr(10), 1) AS instruction,
    substr(user_text, length(split_part(user_text, chr(10), 1)) + 2) AS input, answer_text AS output, system_text AS system FROM pairs""",
)
cte(
    "alpaca_prompt", ("alpaca",),
    """SELECT *, CASE WHEN coalesce(instruction, '') <> '' AND coalesce(input, '') <> '' THEN instruction || chr(10) || chr(10) || input
    ELSE coalesce(nullif(instruction, ''), input, '') END AS prompt FROM alpaca""",
)


def triple(source: str, system: str, prompt: str, answer: str) -> str:
    """(conv_id, turn, i, role, text) of [system] + user + assistant."""
    has = f"CASE WHEN coalesce({system}, '') <> '' THEN 1 ELSE 0 END"
    return f"""SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, 'system' AS role, {system} AS text FROM {source} WHERE coalesce({system}, '') <> ''
    UNION ALL SELECT conv_id, turn, CAST({has} AS BIGINT), 'user', coalesce({prompt}, '') FROM {source}
    UNION ALL SELECT conv_id, turn, CAST({has} + 1 AS BIGINT), 'assistant', coalesce({answer}, '') FROM {source}"""


cte("alpaca_rows", ("alpaca_prompt",), triple("alpaca_prompt", "system", "prompt", "output"))

oracle("src_files", (), "SELECT *, 'jsonl' AS loader FROM conversations UNION ALL SELECT *, 'parquet' FROM conversations")
oracle("src_split_files", (), "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM conversations")
oracle(
    "src_preset", ("canon",),
    "SELECT f.fixture, conv_id, i, text FROM canon, (VALUES ('chosen'), ('messages')) f(fixture)",
)
oracle(
    "src_turns_to_messages", (),
    """SELECT conv_id, count(*) AS n,
    md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""",
)
oracle(
    "detect_format", (),
    """SELECT f.layout, CASE WHEN f.lists THEN count(DISTINCT conv_id) ELSE count(*) FILTER (WHERE role = 'assistant') END AS n FROM conversations,
    (VALUES ('messages', true), ('chosen', true), ('sharegpt', true), ('alpaca', false), ('prompt-response', false)) f(layout, lists)
    GROUP BY f.layout, f.lists""",
)
oracle("norm_messages", ("canon",), "SELECT conv_id, i, role, text FROM canon")
oracle("norm_chosen", ("canon",), "SELECT conv_id, i, role, text FROM canon")
oracle("norm_sharegpt", ("canon",), "SELECT conv_id, i, role_h AS role, text FROM canon")
oracle("norm_alpaca", ("alpaca_rows",), "SELECT * FROM alpaca_rows")
oracle("norm_prompt_response", ("pairs",), triple("pairs", "system_text", "user_text", "answer_text"))
oracle("prompt_join", ("alpaca_prompt",), "SELECT conv_id, turn, prompt FROM alpaca_prompt")
oracle(
    "system_prepend", ("alpaca_rows",),
    "SELECT conv_id, turn, count(*) AS n, min_by(role, i) AS first_role FROM alpaca_rows GROUP BY conv_id, turn",
)
oracle("role_canon", ("canon",), "SELECT conv_id, turn, role, role_h AS role_harmony FROM canon")
oracle(
    "last_is_assistant", (),
    "SELECT conv_id, max_by(role, turn) = 'assistant' AS ends_with_assistant FROM conversations GROUP BY conv_id",
)
oracle(
    "drop_source_cols", ("alpaca_rows",),
    "SELECT conv_id, turn, md5(string_agg(text, '|' ORDER BY i)) AS digest FROM alpaca_rows GROUP BY conv_id, turn",
)
oracle("assistant_free_drop", ("canon",), "SELECT DISTINCT conv_id FROM canon WHERE role = 'assistant'")

# --- content -------------------------------------------------------------------------

_T, _U = "CAST(to_json(text) AS VARCHAR)", "CAST(to_json(url) AS VARCHAR)"
cte("page_count", (), "SELECT count(*) AS n FROM pages")
cte(
    "contents", ("page_count",),
    f"""SELECT conv_id, turn, k, text, CAST(CASE k WHEN 0 THEN {_T} WHEN 1 THEN 'null' WHEN 2 THEN CAST(turn AS VARCHAR)
    WHEN 3 THEN '[' || {_T} || ', " tail"]'
    WHEN 4 THEN '[{{"type":"text","text":' || {_T} || '}},{{"type":"image_url","image_url":{{"url":' || {_U} || '}}}}]'
    WHEN 5 THEN '[{{"text":' || {_T} || '}},{{"image":' || {_U} || '}},"x"]'
    WHEN 6 THEN '[{{"type":" Video.MP4 ","video":' || {_U} || '}},{{"type":"text","text":' || {_T} || '}}]'
    WHEN 7 THEN '[{{"file":' || {_U} || '}},{{"audio_url":' || {_U} || '}},{{"type":"","image":"","image_url":' || {_U} || '}}]'
    WHEN 8 THEN '"[\\"hi\\"]"' WHEN 9 THEN '[]' ELSE '[{{"foo":1}},{{"type":"text","text":' || {_T} || '}}]' END AS JSON) AS c
    FROM (SELECT *, (conv_id + turn) % 11 AS k, conv_id % n AS page_id FROM conversations CROSS JOIN page_count)
    JOIN (SELECT page_id, url FROM pages) USING (page_id)""",
)
cte(
    "items", ("contents",),
    """SELECT conv_id, turn, unnest(json_extract(c, '$[*]')) AS item,
    CAST(generate_subscripts(json_extract(c, '$[*]'), 1) - 1 AS BIGINT) AS i FROM contents WHERE json_type(c) = 'ARRAY'""",
)
cte(
    "parts", ("items",),
    """SELECT conv_id, turn, i, item, modality, CASE WHEN json_type(item) = 'VARCHAR' THEN item->>'$'
      WHEN modality = 'text' THEN coalesce(item->>'$.text', '') END AS ptext,
      CASE split_part(modality, '.', 1) WHEN 'image' THEN '[IMAGE]' WHEN 'video' THEN '[VIDEO]' WHEN 'audio' THEN '[AUDIO]'
      WHEN 'document' THEN '[DOCUMENT]' ELSE '[' || upper(split_part(modality, '.', 1)) || ']' END AS mark
    FROM (SELECT *, CASE WHEN json_type(item) = 'VARCHAR' THEN 'text'
      ELSE coalesce(nullif(lower(trim(item->>'$.type')), ''), CASE
        WHEN json_exists(item, '$.image') OR json_exists(item, '$.image_url') THEN 'image'
        WHEN json_exists(item, '$.video') OR json_exists(item, '$.video_url') THEN 'video'
        WHEN json_exists(item, '$.audio') OR json_exists(item, '$.audio_url') THEN 'audio'
        WHEN json_exists(item, '$.document') OR json_exists(item, '$.file') THEN 'document'
        WHEN json_exists(item, '$.text') THEN 'text' ELSE 'unknown' END) END AS modality FROM items)""",
)


def rendered(part: str, keep: str = "true") -> str:
    """(conv_id, turn, text): list parts joined, scalars as text, null as ''."""
    return f"""SELECT c.conv_id, c.turn, CASE json_type(c.c) WHEN 'ARRAY' THEN coalesce(p.s, '') WHEN 'NULL' THEN '' ELSE c.c->>'$' END AS text,
    json_type(c.c) AS jt, coalesce(p.n_media, 0) AS n_media, coalesce(p.n_unknown, 0) AS n_unknown, coalesce(p.n, 0) AS n
    FROM contents c LEFT JOIN (SELECT conv_id, turn, string_agg({part}, '' ORDER BY i) FILTER (WHERE {keep}) AS s, count(*) AS n,
      count(*) FILTER (WHERE modality <> 'text') AS n_media, count(*) FILTER (WHERE modality = 'unknown') AS n_unknown
      FROM parts GROUP BY conv_id, turn) p USING (conv_id, turn)"""


_shown = "CASE WHEN modality = 'text' THEN ptext ELSE mark END"
cte("shown", ("contents", "parts"), rendered(_shown))
oracle("part_modality", ("parts",), "SELECT conv_id, turn, i, modality FROM parts")
oracle("part_placeholder", ("parts",), "SELECT conv_id, turn, i, mark AS placeholder FROM parts")
oracle("content_placeholder", ("shown",), "SELECT conv_id, turn, text FROM shown")
oracle("render_response", ("shown",), "SELECT conv_id, turn, text FROM shown")
oracle(
    "content_text_only", ("contents", "parts"),
    f"SELECT conv_id, turn, text FROM ({rendered('ptext', chr(109) + 'odality = ' + repr('text'))})",
)
oracle(
    "content_strict", ("shown",),
    "SELECT conv_id, turn, n_media = 0 AS ok, CASE WHEN n_media = 0 THEN text END AS text FROM shown",
)
oracle(
    "content_preserve", ("parts", "shown"),
    "SELECT p.conv_id, p.turn, p.i, p.modality, p.ptext AS text FROM parts p JOIN shown s USING (conv_id, turn) WHERE s.n_unknown = 0",
)
oracle(
    "content_wrap", ("parts", "shown"),
    """SELECT s.conv_id, s.turn, CAST(CASE jt WHEN 'ARRAY' THEN n WHEN 'NULL' THEN 0 ELSE 1 END AS BIGINT) AS n_parts,
    CASE WHEN jt = 'ARRAY' THEN p.modality WHEN jt <> 'NULL' THEN 'text' END AS first_modality,
    CASE WHEN jt = 'ARRAY' THEN p.ptext WHEN jt <> 'NULL' THEN s.text END AS first_text
    FROM shown s LEFT JOIN (SELECT * FROM parts WHERE i = 0) p USING (conv_id, turn)""",
)
oracle(
    "content_text_simple", ("contents", "parts"),
    """SELECT c.conv_id, c.turn, CASE json_type(c.c) WHEN 'ARRAY' THEN coalesce(p.s, '') WHEN 'VARCHAR' THEN c.c->>'$' END AS text
    FROM contents c LEFT JOIN (SELECT conv_id, turn, string_agg(coalesce(item->>'$.text', ''), '' ORDER BY i) AS s FROM parts
    WHERE json_type(item) = 'OBJECT' AND item->>'$.type' = 'text' GROUP BY conv_id, turn) p USING (conv_id, turn)""",
)


def refs(media: str) -> str:
    a, b = f"item->'$.{media}'", f"item->'$.{media}_url'"

    def text(v: str) -> str:
        return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN ({v})->>'$' ELSE CAST({v} AS VARCHAR) END"

    return f"""string_agg(CASE WHEN ({a}) IS NOT NULL AND CAST({a} AS VARCHAR) NOT IN ('""', '[]', '{{}}', '0', 'false', 'null')
      THEN {text(a)} ELSE {text(b)} END, '|' ORDER BY i) FILTER (WHERE modality LIKE '{media}%' AND json_type(item) = 'OBJECT')"""


oracle(
    "media_refs", ("contents", "parts"),
    f"""SELECT c.conv_id, c.turn, p.images, p.videos FROM contents c LEFT JOIN
    (SELECT conv_id, turn, {refs('image')} AS images, {refs('video')} AS videos FROM parts GROUP BY conv_id, turn) p USING (conv_id, turn)""",
)

oracle(
    "content_typed", (),
    """SELECT conv_id, turn, mode, NOT (mode = 'strict' AND k = 1) AS ok,
    CASE k WHEN 0 THEN text WHEN 1 THEN CASE mode WHEN 'text-only' THEN text ELSE text || '[IMAGE]' END ELSE '' END AS text,
    CASE WHEN mode = 'preserve' THEN CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) END AS n_parts
    FROM (SELECT *, (conv_id + turn) % 3 AS k FROM conversations),
    (VALUES ('placeholder'), ('text-only'), ('strict'), ('preserve')) f(mode)""",
)

# --- think spans, transcripts, templates ---------------------------------------------

cte(
    "thinking", (),
    """SELECT a.conv_id, a.turn, CASE WHEN a.role = 'assistant' AND b.text IS NOT NULL
    THEN '<think>' || chr(10) || b.text || chr(10) || '</think>' || chr(10) || chr(10) || a.text ELSE a.text END AS text
    FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""",
)
oracle(
    "strip_thinking", ("thinking",),
    f"SELECT conv_id, turn, {strip(unthink('text'))} AS off, CAST(length(text) AS BIGINT) AS n_on FROM thinking",
)
oracle("clean_generated", ("thinking",), f"SELECT conv_id, turn, {strip(unthink('text'))} AS text FROM thinking")
cte(
    "transcripts", (),
    """SELECT a.conv_id, a.turn, CASE a.conv_id % 4
      WHEN 0 THEN an || fi WHEN 1 THEN an || '<|start|>assistant<|message|>' || a.text
      WHEN 2 THEN 'assistantanalysisfinal<|end|>' || a.text ELSE fi || an || fi END AS raw
    FROM (SELECT *, '<|start|>assistant<|channel|> final <|message|> ' || text || '<|return|>' AS fi FROM conversations) a
    JOIN (SELECT conv_id, turn, '<|start|>assistant<|channel|>analysis<|message|>' || text || '<|end|>' AS an FROM conversations) b
    ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
_MSG = r"<\|start\|>assistant(?:<\|channel\|>([^<]+))?(?:<\|recipient\|>[^<]+)?<\|message\|>(.*?)(?:<\|end\|>|<\|return\|>|$)"
cte(
    "spoken", ("transcripts",),
    f"""SELECT conv_id, turn, i, {strip("coalesce(ch, '')")} AS ch, {strip(r"regexp_replace(body, '<\|[^>]+\|>', '', 'g')")} AS body FROM (
    SELECT conv_id, turn, unnest(regexp_extract_all(raw, '(?s){_MSG}', 1)) AS ch, unnest(regexp_extract_all(raw, '(?s){_MSG}', 2)) AS body,
    generate_subscripts(regexp_extract_all(raw, '(?s){_MSG}', 2), 1) AS i FROM transcripts)""",
)
_bare = strip(r"regexp_replace(regexp_replace(raw, '<\|[^>]+\|>', '', 'g'), 'assistant(?:analysis|commentary|final)+', '', 'g')")
oracle(
    "visible_text", ("transcripts", "spoken"),
    f"""SELECT t.conv_id, t.turn, coalesce({strip('s.fin')}, {strip('s.oth')}, {_bare}) AS text FROM transcripts t LEFT JOIN (
    SELECT conv_id, turn, string_agg(body, chr(10) ORDER BY i) FILTER (WHERE ch = 'final') AS fin, string_agg(body, chr(10) ORDER BY i) AS oth
    FROM spoken WHERE body <> '' GROUP BY conv_id, turn) s USING (conv_id, turn)""",
)
cte(
    "firsts", ("canon",),
    "SELECT conv_id, coalesce(min(i) FILTER (WHERE role NOT IN ('system', 'developer')), count(*)) AS k FROM canon GROUP BY conv_id",
)
oracle(
    "prefix_split", ("canon", "firsts"),
    """SELECT conv_id, k AS n_prefix, count(*) - k AS n_body, min_by(role, i) FILTER (WHERE i >= k) AS first_body_role
    FROM canon JOIN firsts USING (conv_id) GROUP BY conv_id, k""",
)
cte(
    "merged", ("canon", "firsts"),
    """SELECT conv_id, k, string_agg(text, chr(10) || chr(10) ORDER BY i) FILTER (WHERE i < k AND text <> '') AS lead
    FROM canon JOIN firsts USING (conv_id) GROUP BY conv_id, k""",
)
oracle(
    "prefix_merge", ("canon", "merged"),
    """SELECT conv_id, CAST(0 AS BIGINT) AS i, 'developer' AS role, lead AS text FROM merged WHERE lead IS NOT NULL
    UNION ALL SELECT conv_id, i - k + CASE WHEN lead IS NULL THEN 0 ELSE 1 END, role_h, text FROM canon JOIN merged USING (conv_id) WHERE i >= k""",
)
_line = "'<|' || {r} || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10)"
_gen = "'<|assistant|>' || chr(10)"
cte(
    "renders", ("canon",),
    f"SELECT conv_id, string_agg({_line.format(r='role')}, '' ORDER BY i) AS r FROM canon GROUP BY conv_id",
)
oracle(
    "render_template", ("renders",),
    f"""SELECT conv_id, md5(r || {_gen}) AS with_prompt, md5(r) AS without_prompt,
    md5('<|system|>' || chr(10) || 'Reasoning: low' || chr(10) || '<|end|>' || chr(10) || r || {_gen}) AS low_effort,
    md5({strip(unthink('r || ' + _gen))}) AS no_thinking FROM renders""",
)
oracle(
    "chat_pair", ("canon",),
    f"""SELECT conv_id, md5(coalesce(string_agg({_line.format(r='role')}, '' ORDER BY i) FILTER (WHERE i < last), '') || {_gen}) AS prompt,
    md5(string_agg({_line.format(r='role')}, '' ORDER BY i)) AS "full", max_by(text, i) AS response
    FROM canon JOIN (SELECT conv_id, max(i) AS last FROM canon WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id)
    WHERE i <= last GROUP BY conv_id""",
)

# --- tokens --------------------------------------------------------------------------

cte("w", (), r"SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations")
_SPECIAL = "('<pad>', '<unk>', '<|system|>', '<|developer|>', '<|user|>', '<|assistant|>', '<|tool|>', '<|end|>')"
cte(
    "vocab", ("w",),
    f"""SELECT token, n, 7 + row_number() OVER (ORDER BY n DESC, token) AS id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(ws) AS token FROM w) WHERE token NOT IN {_SPECIAL}
    GROUP BY token)""",
)
cte(
    "ids", ("w", "vocab"),
    """SELECT conv_id, turn, list(coalesce(v.id, 1) ORDER BY x.i) AS ids
    FROM (SELECT conv_id, turn, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM w) x LEFT JOIN vocab v USING (token) GROUP BY conv_id, turn""",
)
cte(
    "msg", ("w", "ids"),
    """SELECT w.conv_id, w.turn, w.role, w.text, len(ws) AS n, len(ws) + 2 AS cost, coalesce(ids, []) AS ids,
    list_concat([CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 4 ELSE 5 END], list_concat(coalesce(ids, []), [7])) AS mids,
    coalesce(sum(len(ws) + 2) OVER (PARTITION BY w.conv_id ORDER BY w.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM w LEFT JOIN ids USING (conv_id, turn)""",
)
cte("bodies", (), "SELECT conv_id, min(turn) AS first FROM conversations WHERE role NOT IN ('system', 'developer') GROUP BY conv_id")
cte("starts", ("bodies",), "SELECT conv_id, first AS s FROM bodies UNION SELECT conv_id, turn + 1 FROM conversations WHERE role = 'assistant'")
cte(
    "head", ("msg", "bodies"),
    """SELECT conv_id, first, coalesce(sum(cost) FILTER (WHERE turn < first), 0) AS p,
    coalesce(flatten(list(mids ORDER BY turn) FILTER (WHERE turn < first)), []) AS hids FROM msg JOIN bodies USING (conv_id) GROUP BY conv_id, first""",
)
cte(
    "picks", ("msg", "head", "starts"),
    """SELECT t.conv_id, t.turn, t.n, t.cost, t.mids, t.ids, t.text, t.before, h.first, h.p, h.hids, max(s.s) AS last,
    min(s.s) FILTER (WHERE h.p + t.before - m.before + 1 <= 64 AND h.p + t.before - m.before + t.cost <= 320) AS fit
    FROM msg t JOIN head h USING (conv_id) JOIN starts s ON s.conv_id = t.conv_id AND s.s <= t.turn
    JOIN msg m ON m.conv_id = s.conv_id AND m.turn = s.s
    WHERE t.role = 'assistant' AND t.n <= 256 GROUP BY ALL""",
)
cte(
    "whole", ("picks", "msg"),
    """SELECT p.*, coalesce(x.hist, []) AS hist FROM picks p LEFT JOIN (
    SELECT p.conv_id, p.turn, flatten(list(m.mids ORDER BY m.turn)) AS hist FROM picks p JOIN msg m
    ON m.conv_id = p.conv_id AND m.turn >= coalesce(p.fit, p.last) AND m.turn < p.turn GROUP BY p.conv_id, p.turn) x USING (conv_id, turn)""",
)
cte(
    "samples", ("whole",),
    f"""SELECT *, CASE WHEN fit IS NOT NULL THEN all_full WHEN n > 0 AND {tail('all_full', 'n')} = ids THEN list_concat(prompt_ids, ids)
    ELSE {tail('all_full', 'len(prompt_ids) + n')} END AS input_ids
    FROM (SELECT *, CASE WHEN fit IS NOT NULL THEN all_prompt ELSE {tail('all_prompt', '64')} END AS prompt_ids FROM (
    SELECT conv_id, turn, conv_id || '-' || turn AS sample_id, fit AS start, fit, n, ids, text AS response,
    CASE WHEN fit IS NULL THEN 'trunc' WHEN fit = first THEN 'full' ELSE 'window' END AS kind,
    list_concat(list_concat(hids, hist), [5]) AS all_prompt, list_concat(list_concat(hids, hist), mids) AS all_full FROM whole))""",
)
oracle("vocab_build", ("vocab",), "SELECT token, n, id FROM vocab")
oracle("tokenize", ("msg",), f"SELECT conv_id, turn, {joined('ids')} AS ids FROM msg")
oracle("token_len", ("w",), "SELECT conv_id, turn, CAST(len(ws) AS BIGINT) AS n FROM w")
oracle("labels_copy", ("samples",), f"SELECT sample_id, {joined('input_ids')} AS labels FROM samples")
oracle(
    "pad_right", ("samples",),
    f"SELECT sample_id, {joined(pad_right('input_ids', 200, 0))} AS input_ids, {joined(pad_right('input_ids', 200, -100))} AS labels FROM samples",
)
oracle("pad_left", ("samples",), f"SELECT sample_id, {joined(pad_left('prompt_ids', 48, 0))} AS prompt_ids FROM samples")
oracle(
    "attn_mask", ("samples",),
    f"SELECT sample_id, array_to_string(list_transform({pad_left('prompt_ids', 64, 0)}, lambda v: CASE WHEN v <> 0 THEN 1 ELSE 0 END), ' ') AS mask FROM samples",
)
cte(
    "generated", ("samples",),
    """SELECT sample_id, prompt_ids AS p, coalesce(input_ids[len(prompt_ids) + 1 : len(input_ids)], []) AS r FROM samples""",
)
oracle(
    "pack_generated", ("generated",),
    f"""SELECT sample_id, {joined(pad_right('pr', 320, 0))} AS input_ids,
    array_to_string(list_transform({pad_right('pr', 320, 0)}, lambda v: CASE WHEN v <> 0 THEN 1 ELSE 0 END), ' ') AS attention_mask,
    {joined(pad_right('lab', 320, -100))} AS labels, {joined(pad_right('ty', 320, 0))} AS token_types FROM (
    SELECT sample_id, list_concat(p, r) AS pr, list_concat(list_transform(p, lambda v: -100), r) AS lab, list_transform(p, lambda v: v % 2) AS ty FROM generated)""",
)
oracle("cut_generated", ("generated",), f"SELECT sample_id, {joined('r')} AS ids FROM generated")
cte("sample_batches", ("samples",), f"SELECT *, {place(42, 'sample_id')} AS rank, count(*) OVER () AS total FROM samples")
oracle(
    "count_tokens", ("sample_batches",),
    """SELECT rank // 8 AS batch_id, CAST(sum(least(len(input_ids), 320)) AS BIGINT) AS tokens FROM sample_batches GROUP BY 1""",
)
oracle(
    "flatten_lists", ("w",),
    """SELECT conv_id, CAST(len(f) AS BIGINT) AS n, md5(array_to_string(f, ' ')) AS digest
    FROM (SELECT conv_id, flatten(list(ws ORDER BY turn)) AS f FROM w GROUP BY conv_id)""",
)

# --- expansion -----------------------------------------------------------------------

_COUNTS = """SELECT conv_id, turn, start, kind, CAST(len(prompt_ids) AS BIGINT) AS n_prompt, CAST(len(input_ids) AS BIGINT) AS n_full,
  CAST(n AS BIGINT) AS n_response FROM samples"""
oracle("flagship", ("samples",), _COUNTS)
oracle("stream_expand", ("samples",), _COUNTS)
oracle("assistant_explode", (), "SELECT conv_id, turn FROM conversations WHERE role = 'assistant'")
oracle(
    "start_candidates", ("starts",),
    """SELECT c.conv_id, c.turn, count(*) AS n_starts, max(s) AS last_start FROM conversations c JOIN starts s ON s.conv_id = c.conv_id AND s.s <= c.turn
    WHERE c.role = 'assistant' GROUP BY c.conv_id, c.turn""",
)
oracle(
    "fits_budget", ("msg",),
    "SELECT conv_id, turn, before + cost <= 320 AND before + 1 <= 64 AND n <= 256 AS fits FROM msg WHERE role = 'assistant'",
)
oracle(
    "candidate_windows", ("msg", "head", "starts"),
    """SELECT conv_id, turn, n_starts, s AS start, CAST(np AS BIGINT) AS n_prompt, CAST(nf AS BIGINT) AS n_full, fits FROM (
    SELECT *, np <= 64 AND nf <= 320 AND n <= 256 AS fits, count(*) OVER (PARTITION BY conv_id, turn) AS n_starts, max(s) OVER (PARTITION BY conv_id, turn) AS last FROM (
    SELECT t.conv_id, t.turn, t.n, s.s, h.p + t.before - m.before + 1 AS np, h.p + t.before - m.before + t.cost AS nf
    FROM msg t JOIN head h USING (conv_id) JOIN starts s ON s.conv_id = t.conv_id AND s.s <= t.turn JOIN msg m ON m.conv_id = s.conv_id AND m.turn = s.s
    WHERE t.role = 'assistant')) WHERE fits OR s = last""",
)
oracle(
    "window_first_fit", ("samples",),
    "SELECT conv_id, turn, start, CAST(len(prompt_ids) AS BIGINT) AS n_prompt FROM samples WHERE start IS NOT NULL",
)
oracle(
    "truncate_fallback", ("samples",),
    f"SELECT sample_id, {joined('prompt_ids')} AS prompt_ids, {joined('input_ids')} AS input_ids FROM samples WHERE kind = 'trunc'",
)
oracle("drop_long_response", ("w",), "SELECT conv_id, turn, CAST(len(ws) AS BIGINT) AS n FROM w WHERE role = 'assistant' AND len(ws) <= 256")
for _name in ("expand_samples", "expand_samples_exact"):
    oracle(
        _name, ("samples",),
        f"""SELECT conv_id, turn, start, kind, {joined('prompt_ids')} AS prompt_ids, {joined('input_ids')} AS input_ids,
        {joined('input_ids')} AS labels, response FROM samples""",
    )
oracle(
    "prepare_corpus", ("samples",),
    f"""SELECT sample_id, split, kind, CAST(len(prompt_ids) AS BIGINT) AS n_prompt, CAST(len(input_ids) AS BIGINT) AS n_full FROM samples JOIN (
    SELECT conv_id, CASE WHEN {place(42, 'conv_id')} < {capped(20)} THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations))
    USING (conv_id)""",
)

# --- store, split, batches -----------------------------------------------------------

cte("store", ("samples",), f"SELECT *, CASE WHEN {place(42, 'sample_id')} < {capped(20)} THEN 'test' ELSE 'train' END AS split FROM samples")
oracle("sink_chunks", ("store",), "SELECT split, count(*) AS n, CAST(sum(len(input_ids)) AS BIGINT) AS tokens FROM store GROUP BY split")
oracle(
    "src_prepared", ("store",),
    f"SELECT sample_id, {joined('input_ids')} AS input_ids, {joined('prompt_ids')} AS prompt_ids, response FROM store WHERE split = 'test'",
)
oracle(
    "eval_size", (),
    """SELECT lang, least(2000, greatest(1, n - 1)) AS "default", least(50, greatest(1, n - 1)) AS fifty,
    least(greatest(1, CAST(floor(n * CAST(0.02 AS DOUBLE)) AS BIGINT)), greatest(1, n - 1)) AS by_ratio
    FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""",
)
oracle("split_exact", (), f"SELECT doc_id, CASE WHEN {place(42, 'doc_id')} < {capped(123)} THEN 'test' ELSE 'train' END AS split FROM documents")
oracle(
    "split_given", (),
    """SELECT 'train' AS split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
    UNION ALL SELECT 'test', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark""",
)
cte(
    "doc_ranks", (),
    f"""SELECT 'train' AS loader, doc_id, {place(42, 'doc_id')} AS rank, count(*) OVER () AS total FROM documents
    UNION ALL SELECT 'val', doc_id, row_number() OVER (ORDER BY doc_id) - 1, count(*) OVER () FROM documents""",
)
oracle(
    "shuffle_batches", ("doc_ranks",),
    "SELECT loader, doc_id, rank // 48 AS batch_id, rank % 48 AS slot FROM doc_ranks WHERE rank < total - total % 48",
)
oracle(
    "limit_batches", ("doc_ranks",),
    """SELECT "limit", count(*) AS n, max(b) AS last_batch FROM (
    SELECT rank // 48 AS b, total // 48 AS nb FROM doc_ranks WHERE loader = 'train' AND rank < total - total % 48),
    (VALUES ('quarter'), ('five')) f("limit") WHERE CASE "limit" WHEN 'five' THEN b < 5 ELSE b < floor(nb * 0.25) END GROUP BY "limit" """,
)
oracle(
    "collate", ("sample_batches",),
    f"""SELECT rank // 8 AS batch_id, rank % 8 AS slot, {joined(pad_right('input_ids', 320, 0))} AS input_ids,
    {joined(pad_right('input_ids', 320, -100))} AS labels,
    array_to_string(list_transform({pad_right('input_ids', 320, 0)}, lambda v: CASE WHEN v <> 0 THEN 1 ELSE 0 END), ' ') AS attention_mask,
    {joined(pad_left('prompt_ids', 64, 0))} AS prompt_ids, response FROM sample_batches WHERE rank < total - total % 8""",
)
cte(
    "sided", ("sample_batches",),
    """SELECT rank // 8 AS batch_id, rank % 8 AS slot, pixels, CASE WHEN len(pixels) > 0 THEN [[1, len(pixels)]] ELSE [] END AS grid,
    list_transform(input_ids, lambda v, i: CASE WHEN i % 5 <> 0 THEN 1 ELSE 0 END) AS ma, list_transform(input_ids, lambda v: v % 3) AS ty,
    list_transform(prompt_ids, lambda v, i: CASE WHEN i % 5 <> 0 THEN 1 ELSE 0 END) AS pma, list_transform(prompt_ids, lambda v: v % 3) AS pty
    FROM (SELECT *, list_transform(list_filter(input_ids, lambda v: v % 7 = 0), lambda v: [v % 5, v % 2]) AS pixels FROM sample_batches)
    WHERE rank < total - total % 8""",
)
_PAIRS = "array_to_string(list_transform(flatten(list({x} ORDER BY slot)), lambda v: array_to_string(v, ' ')), '|')"
_OFFSETS = "'0 ' || string_agg(CAST({x} AS VARCHAR), ' ' ORDER BY slot)"
oracle(
    "collate_sides", ("sided",),
    f"""SELECT batch_id, string_agg({joined(pad_right('ma', 320, 0))}, '|' ORDER BY slot) AS mask, string_agg({joined(pad_right('ty', 320, 0))}, '|' ORDER BY slot) AS types,
    string_agg({joined(pad_left('pma', 64, 0))}, '|' ORDER BY slot) AS prompt_mask, string_agg({joined(pad_left('pty', 64, 0))}, '|' ORDER BY slot) AS prompt_types,
    {_PAIRS.format(x='pixels')} AS pixels, {_OFFSETS.format(x='pe')} AS pixel_offsets, {_PAIRS.format(x='grid')} AS grids, {_OFFSETS.format(x='ge')} AS grid_offsets
    FROM (SELECT *, sum(len(pixels)) OVER w AS pe, sum(len(grid)) OVER w AS ge FROM sided WINDOW w AS (PARTITION BY batch_id ORDER BY slot)) GROUP BY batch_id""",
)

# --- logits --------------------------------------------------------------------------

cte("emb", (), "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS z FROM embeddings")
cte("emb_count", (), "SELECT count(*) AS n FROM embeddings")
cte(
    "lg", ("emb", "emb_count"),
    """SELECT a.vec_id // 16 AS sample_id, a.vec_id % 16 AS pos, a.z AS zs, b.z AS zt, CASE WHEN a.vec_id % 16 < 4 THEN -100 ELSE a.label END AS label
    FROM (SELECT *, (vec_id + 1) % n AS next_id FROM emb CROSS JOIN emb_count) a JOIN emb b ON b.vec_id = a.next_id""",
)
cte(
    "al", ("lg",),
    """SELECT p.sample_id, p.pos, p.zs, p.zt, q.label AS nl, CASE WHEN q.label <> -100 THEN 1 ELSE 0 END AS mask,
    range(1, len(p.zs) + 1) AS ix FROM lg p JOIN lg q ON q.sample_id = p.sample_id AND q.pos = p.pos + 1""",
)


def log_softmax_cte(name: str, source: str, columns: dict[str, str]) -> None:
    """CTE that adds a log-softmax column per (new name -> logit expression)."""
    zs = ", ".join(f"{e} AS z_{n}" for n, e in columns.items())
    ms = ", ".join(f"list_max(z_{n}) AS m_{n}" for n in columns)
    ls = ", ".join(f"m_{n} + ln(list_sum(list_transform(z_{n}, lambda x: exp(x - m_{n})))) AS e_{n}" for n in columns)
    out = ", ".join(f"list_transform(z_{n}, lambda x: x - e_{n}) AS {n}" for n in columns)
    cte(name, (source,), f"SELECT *, {out} FROM (SELECT *, {ls} FROM (SELECT *, {ms} FROM (SELECT *, {zs} FROM {source})))")


def dot(expr: str) -> str:
    """Sum over positions i (1-based) of the vocabulary."""
    return f"list_sum(list_transform(ix, lambda i: {expr}))"


log_softmax_cte("dl", "al", {"ls": "zs", "lt": "zt"})
cte("d", ("dl",), "SELECT *, list_transform(ls, lambda x: exp(x)) AS s, list_transform(lt, lambda x: exp(x)) AS t FROM dl")
FKL, RKL = f"(-{dot('t[i] * ls[i]')})", f"({dot('s[i] * (ls[i] - lt[i])')})"
EXPR = {
    "fkl": FKL,
    "rkl": RKL,
    "tvd": dot("abs(t[i] - s[i])") + " * 0.5",
    "js": f"0.9 * {dot('s[i] * (ls[i] - ln(0.1 * t[i] + 0.9 * s[i]))')} + 0.1 * {dot('t[i] * (lt[i] - ln(0.1 * t[i] + 0.9 * s[i]))')}",
    "sfkl": f"-{dot('t[i] * ln(0.1 * t[i] + 0.9 * s[i])')}",
    "srkl": dot("s[i] * (ls[i] - ln(0.9 * t[i] + 0.1 * s[i]))"),
}
cte(
    "gaps", ("d",),
    """SELECT *, len(list_filter(list_transform(ix, lambda i: list_sum(st[1:i])), lambda c: c < 0.5)) AS below FROM (
    SELECT *, list_sort(t) AS st, list_transform(ix, lambda i: abs(t[i] - s[i])) AS gap,
    list_transform(list_sort(list_transform(ix, lambda i: {'p': t[i], 'g': abs(t[i] - s[i])})), lambda r: r.g) AS sgap FROM d)""",
)


def adaptive(g: str) -> str:
    head = f"coalesce(list_sum({g}[below + 1 : len({g})]), 0)"
    rest = f"coalesce(list_sum({g}[1 : below]), 0)"
    return f"({head} * {FKL} + {rest} * {RKL}) / ({head} + {rest})"


_TAU = "(1 + 20 / (1 + exp(CAST(-1 AS DOUBLE))))"
log_softmax_cte("temp", "al", {"ls": f"list_transform(zs, lambda x: x / {_TAU})", "lt": f"list_transform(zt, lambda x: x / {_TAU})"})
log_softmax_cte(
    "interp", "al", {"ls": "zs", "lt": "list_transform(ix, lambda i: 0.6 * zs[i] + 0.4 * zt[i])"}
)
_tgt = "CASE WHEN mask = 1 THEN nl ELSE 0 END"
cte("al_tgt", ("al",), f"SELECT *, {_tgt} AS tgt FROM al")
cte(
    "al_std", ("al_tgt",),
    """SELECT * REPLACE (list_transform(zs, lambda x: (x - list_avg(zs)) / (1e-7 + list_stddev_samp(zs))) AS zs,
    list_transform(zt, lambda x: (x - list_avg(zt)) / (1e-7 + list_stddev_samp(zt))) AS zt) FROM al_tgt""",
)
_off = "list_transform(ix, lambda i: {z}[i] - CASE WHEN i - 1 = tgt THEN 1000 ELSE 0 END)"
for _n, _src in (("dkd", "al_tgt"), ("dkd_std", "al_std")):
    log_softmax_cte(_n, _src, {"ls": "zs", "lt": "zt", "os": _off.format(z="zs"), "ot": _off.format(z="zt")})
_ps, _pt = "exp(ls[tgt + 1])", "exp(lt[tgt + 1])"
_rs, _rt = dot("CASE WHEN i - 1 = tgt THEN 0 ELSE exp(ls[i]) END"), dot("CASE WHEN i - 1 = tgt THEN 0 ELSE exp(lt[i]) END")
DKD = f"""({_pt} * (ln({_pt}) - ln({_ps})) + {_rt} * (ln({_rt}) - ln({_rs}))
  + 0.5 * {dot("CASE WHEN exp(ot[i]) > 0 THEN exp(ot[i]) * (ot[i] - os[i]) ELSE 0 END")}) * mask"""


def mean(expr: str) -> str:
    return f"sum(CASE WHEN mask = 1 THEN {expr} ELSE 0 END) / nullif(sum(mask), 0)"


def measure(name: str, source: str, value: str) -> None:
    oracle(name, (source,), f"SELECT sample_id, round({value}, 6) + 0.0 AS value FROM {source} GROUP BY sample_id")


_LM = "avg(CASE WHEN mask = 1 THEN -ls[nl + 1] END)"
for _name, _kind in (
    ("div_fkl", "fkl"), ("div_rkl", "rkl"), ("div_tvd", "tvd"), ("div_js", "js"), ("div_skew_fkl", "sfkl"), ("div_skew_rkl", "srkl"),
):
    measure(_name, "d", mean(EXPR[_kind]))
measure("lm_loss", "d", _LM)
measure("div_adaptive", "gaps", mean(adaptive("gap")))
measure("div_adaptive_corrected", "gaps", mean(adaptive("sgap")))
_CT = f"-{_TAU} * {_TAU} * {dot('exp(lt[i]) * ls[i]')}"
measure("div_temperature", "temp", mean(_CT))
measure("div_interp", "interp", mean(f"-{dot('exp(lt[i]) * ls[i]')}"))
measure("div_decoupled", "dkd", f"sum({DKD}) / count(*)")
measure("logit_standardize", "dkd_std", f"sum({DKD}) / count(*)")
oracle("logit_align", ("al",), "SELECT sample_id, pos, CAST(nl AS BIGINT) AS next_label, CAST(mask AS BIGINT) AS mask FROM al")
log_softmax_cte("dl_all", "lg", {"ls": "zs"})
oracle(
    "logit_softmax", ("dl_all",),
    "SELECT sample_id, pos, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS i, round(exp(unnest(ls)), 6) + 0.0 AS p FROM dl_all",
)
oracle(
    "loss_combine", ("d",),
    f"""SELECT sample_id, round(lm, 6) + 0.0 AS lm_loss, round(di, 6) + 0.0 AS distil_loss, round(0.3 * lm + 0.7 * di, 6) + 0.0 AS loss
    FROM (SELECT sample_id, {_LM} AS lm, {mean(RKL)} AS di FROM d GROUP BY sample_id)""",
)
for _k, _src, _v in (
    ("k_d", "d", ", ".join(f"round({mean(e)}, 6) + 0.0 AS {n}" for n, e in EXPR.items()) + f", round({_LM}, 6) + 0.0 AS lm"),
    ("k_gap", "gaps", f"round({mean(adaptive('gap'))}, 6) + 0.0 AS adaptive_kl"),
    ("k_temp", "temp", f"round({mean(_CT)}, 6) + 0.0 AS ctkd"),
    ("k_int", "interp", "round(" + mean("-" + dot("exp(lt[i]) * ls[i]")) + ", 6) + 0.0 AS interp"),
    ("k_dkd", "dkd", f"round(sum({DKD}) / count(*), 6) + 0.0 AS dkd"),
):
    cte(_k, (_src,), f"SELECT sample_id, {_v} FROM {_src} GROUP BY sample_id")
for _name in ("div_dispatch", "div_expressions"):
    oracle(
        _name, ("k_d", "k_gap", "k_temp", "k_int", "k_dkd"),
        "SELECT * FROM k_d JOIN k_gap USING (sample_id) JOIN k_temp USING (sample_id) JOIN k_int USING (sample_id) JOIN k_dkd USING (sample_id)",
    )

# --- run logs ------------------------------------------------------------------------

cte(
    "rl", (),
    f"""SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS total,
    value AS loss, {unit(0, 'event_id')} AS r, event_id FROM events""",
)
oracle(
    "best_step", ("rl",),
    """SELECT run, step, loss FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss DESC, step) AS k FROM rl) WHERE k = 1""",
)
_sig = "(1 / (1 + exp(-m2)))"
cte(
    "sched", ("rl",),
    f"""SELECT run, step, total, loss AS prev, CAST(0 AS DOUBLE) AS m, CAST(0.4 AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS delta FROM rl WHERE step = 0
    UNION ALL SELECT run, step, total, loss, m2, least(1.0, greatest(0.4 + 0.6 * CAST(step AS DOUBLE) / total, t + 5e-4 * {_sig} * (1 - t))),
    5e-4 * {_sig} * (1 - t) FROM (SELECT r.run, r.step, r.total, r.loss, f.t,
      CAST(0.99 AS DOUBLE) * f.m + (1 - CAST(0.99 AS DOUBLE)) * ((f.prev - r.loss) / (f.prev + 1e-15)) AS m2 FROM sched f JOIN rl r ON r.run = f.run AND r.step = f.step + 1)""",
)
oracle(
    "interp_schedule", ("sched",),
    "SELECT run, step, round(t, 6) + 0.0 AS t, CASE WHEN abs(m) < 1e9 THEN round(m, 6) + 0.0 ELSE m END AS momentum, round(delta, 6) + 0.0 AS delta_t FROM sched",
)
oracle(
    "stream_interp_schedule", ("sched",),
    "SELECT run, step, round(t, 6) + 0.0 AS t, CASE WHEN abs(m) < 1e9 THEN round(m, 6) + 0.0 ELSE m END AS momentum, false AS late FROM sched",
)
oracle(
    "cosine_curriculum", ("rl",),
    """SELECT run, step, round((cos(CAST(least(greatest(step - 2, 0), 10) AS DOUBLE) * pi() / 10) + 1) * 0.5 * 0.75 + 0.25, 6) + 0.0 AS lambda FROM rl""",
)
oracle(
    "threshold_update", ("rl",),
    """SELECT run, step, round(least(CAST(1.0 AS DOUBLE), CAST(0.1 AS DOUBLE) * sum(hit) OVER (PARTITION BY run ORDER BY step)), 6) + 0.0 AS threshold
    FROM (SELECT *, CASE WHEN loss >= max(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS hit FROM rl)""",
)
cte(
    "margin", ("rl",),
    """SELECT run, step, loss AS mark, 0 AS hits FROM rl WHERE step = 0
    UNION ALL SELECT r.run, r.step, CASE WHEN r.loss >= f.mark + 0.5 THEN r.loss ELSE f.mark END, f.hits + CASE WHEN r.loss >= f.mark + 0.5 THEN 1 ELSE 0 END
    FROM margin f JOIN rl r ON r.run = f.run AND r.step = f.step + 1""",
)
oracle("threshold_margin", ("margin",), "SELECT run, step, round(least(CAST(1.0 AS DOUBLE), CAST(0.1 AS DOUBLE) * hits), 6) + 0.0 AS threshold FROM margin")
oracle(
    "sample_route", ("rl",),
    """SELECT f.ratio, run, step, stored, CASE WHEN r < 0.7 * CASE f.ratio WHEN 'constant' THEN 0.5
      WHEN 'increasing' THEN CAST(step AS DOUBLE) / total ELSE 1 - CAST(step AS DOUBLE) / total END OR (r < 0.7 AND stored < 100) THEN 'fresh'
      WHEN r < 0.7 THEN 'replay' ELSE 'data' END AS route
    FROM (SELECT *, CAST(least(100, 8 * coalesce(sum(CASE WHEN r < 0.7 THEN 1 ELSE 0 END) OVER
      (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS stored FROM rl),
    (VALUES ('constant'), ('increasing'), ('decreasing')) f(ratio)""",
)
_kept = """SELECT user_id % 4 AS shard, event_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts DESC, event_id DESC) <= 200"""
oracle(
    "replay_keep", (),
    f"SELECT * FROM (SELECT CAST(-1 AS BIGINT) AS shard, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) UNION ALL {_kept}",
)
oracle("stream_replay_keep", (), _kept)
oracle("replay_sample", (), "SELECT event_id FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 64")
oracle(
    "teacher_swap", ("doc_ranks",),
    f"""SELECT doc_id AS sample_id, batch_id, sw AS from_teacher, md5(CASE WHEN sw THEN 'teacher ' || quality ELSE text END) AS digest FROM (
    SELECT b.doc_id, b.batch_id, d.text, l.quality, {unit(3, 'b.batch_id')} < 0.5 AND l.doc_id IS NOT NULL AS sw
    FROM (SELECT doc_id, rank // 16 AS batch_id FROM doc_ranks WHERE loader = 'train') b
    JOIN documents d USING (doc_id) LEFT JOIN labels l ON l.doc_id = b.doc_id)""",
)

# --- evaluation ----------------------------------------------------------------------

cte(
    "preds", (),
    """SELECT a.conv_id % 2 AS eval_set, a.conv_id, a.turn, CASE WHEN (a.conv_id + a.turn) % 3 = 0 THEN translate(a.text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ..!' ELSE coalesce(b.text, '') END AS pred,
    a.text AS target FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'""",
)


def answer(x: str) -> str:
    punct = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    return rf"trim(regexp_replace(translate(lower({x}), '{punct}', ''), '\s+', ' ', 'g'))"


oracle("norm_answer", ("preds",), f"SELECT conv_id, turn, {answer('pred')} AS answer FROM preds")
oracle(
    "exact_match", ("preds",),
    f"SELECT eval_set, round(avg(CASE WHEN {answer('pred')} = {answer('target')} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS exact_match FROM preds GROUP BY eval_set",
)
oracle(
    "rouge_tokens", ("preds",),
    "SELECT conv_id, turn, trim(regexp_replace(lower(target), '[^a-z0-9]+', ' ', 'g')) AS tokens FROM preds",
)
oracle(
    "metric_names", ("rl",),
    """SELECT run, step, 'train/p_loss' AS name, round(loss, 6) + 0.0 AS value FROM rl
    UNION ALL SELECT run, step, 'train/p_r', round(r, 6) + 0.0 FROM rl WHERE r < 0.5""",
)
