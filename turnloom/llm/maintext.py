"""Main text of web pages by tree scoring.

Tags are read into a light tree; menus, headers, footers, asides and invisible parts are cut. Forms and what a class or
id names as notice, advert, comments and the like are cut if their own text is poor or not the page's main part. Every text block passes points (one, one per comma, up to three for length, less its share of link text) to its
container, half to the next and ever less further up. The best container, or the article element around it, is kept with
those siblings that score at least a fifth as much or are long plain paragraphs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnloom.llm.arrow import splits

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_UNSEEN = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CUT = frozenset("nav footer aside button select dialog svg canvas object audio video menu head input label".split())
#: Cut by ``_decide`` only, like what has a cut word.
_FORMS = frozenset("form fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KEEP = frozenset("html body main article".split())
_CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination paywall popup promo promotion promoted recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: What these words name is left out however much plain text it has, unless it is the page's main part.
_STRICT_WORDS = _COMMENT_WORDS | frozenset("ad ads advert adverts advertisement advertising adsense consent cookie cookies gdpr banner newsletter notice notices overlay popup promo promoted promotion sidebar sponsor sponsored".split())
_GOOD_WORDS = frozenset("article body content entry main post story text".split())
#: A header without a name of its own below one of these belongs to the text, not to the site.
_TEXT_WORDS = frozenset("article content entry post story".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_SCOPE = frozenset("table ul ol dl div section article main body html blockquote".split())
#: Plain characters under which a named part or form is poor, and those that it needs for each input field.
_POOR, _FIELD = 80, 150
_SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)


class _Node:
    __slots__ = ("tag", "above", "points", "cut", "block", "chars", "links", "link_chars", "words", "soft", "inner", "over", "strict", "comments", "plain", "linked", "own", "fields", "main", "kept")

    def __init__(self, tag: str, above: _Node | None, attributes: str):
        self.tag, self.above, self.points, self.chars, self.links, self.link_chars = tag, above, 0.0, 0, 0, 0
        self.block, self.words = tag in _BLOCK, frozenset()
        # The nearest form or named part that this is or lies in, and whether an article lies between.
        self.soft, self.inner = (above.soft, above.inner) if above else (None, False)
        self.cut = bool(above and above.cut) or tag in _CUT
        role = ""
        for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "class" or name == "id" and tag != "p":
                self.words |= {w.lower() for w in _WORD.findall(value)}
            elif name == "role":
                role = value.lower()
            elif name == "hidden" and m.start() and attributes[m.start() - 1].isspace() or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                self.cut = True
        if tag not in _KEEP:
            named = self.words & _CUT_WORDS
            if role in _CUT_ROLES - {"form", "dialog"}:
                self.cut = True
            named = named if tag not in _HEADINGS and (named & _COMMENT_WORDS or not self.words & _GOOD_WORDS) else frozenset()
            if not self.cut and (named or tag in _FORMS or role in ("form", "dialog")):
                self.over, self.soft, self.inner = self.soft, self, False
                self.strict, self.comments = bool(named & _STRICT_WORDS), bool(named & _COMMENT_WORDS)
                self.plain = self.linked = self.own = self.fields = self.main = 0
            if tag == "header" and not self.of_text():
                self.cut = True
        elif tag in ("article", "main"):
            self.inner = not self.words & _COMMENT_WORDS

    def of_text(self) -> bool:
        """In an article or main element, or in a part that is named as text and not as something to cut."""
        at = self.above
        while at is not None:
            if at.tag in ("article", "main") or at.tag not in _KEEP and at.words & _TEXT_WORDS and not at.words & _CUT_WORDS:
                return True
            at = at.above
        return False


def _decide(parts: list[_Node]) -> None:
    """Sets ``kept`` of forms and named parts, given in page order; ``free`` is the plain text so far outside them.

    Rich ones are kept: enough plain text for their links and fields. Those of strict words are kept only as the main
    part: more plain text than all that is free, and for comments more in an article or hardly any free text.
    """
    for part in reversed(parts[1:]):
        part.plain += part.own
        if part.over is not None:
            part.over.plain, part.over.linked, part.over.fields, part.over.main = part.over.plain + part.plain, part.over.linked + part.linked, part.over.fields + part.fields, part.over.main + part.main
    free = parts[0].own
    for part in parts[1:]:
        rich = part.plain >= _POOR and part.linked <= part.plain / 2
        if part.comments:
            main = part.main > free or free < _POOR
        else:
            main = part.plain > free
        part.kept = (part.over is None or part.over.kept) and rich and (main or not part.strict and part.plain >= _FIELD * part.fields)
        if part.kept:
            free += part.own


def _blocks(page: str) -> list[tuple[str, int, _Node]]:
    """(text, characters of it inside links, container) of every block in page order; cut parts are left out."""
    at, node, found = 0, _Node("html", None, ""), []
    text: list[tuple[str, int, _Node | None]] = []
    anchor = 0
    lower = None
    # What lies in no form or named part counts for the root.
    root = node
    root.own = 0
    parts = [root]

    def close_block() -> None:
        nonlocal text
        if text:
            found.append((text, holder(node)))
            text = []

    def holder(n: _Node) -> _Node:
        while not n.block and n.above is not None:
            n = n.above
        return n

    def add(raw: str) -> None:
        if raw and not node.cut:
            piece = html.unescape(raw) if "&" in raw else raw
            size, part = len(" ".join(piece.split())), node.soft
            text.append((piece, size if anchor else 0, part))
            if not anchor:
                (part or root).own += size
                if part is not None and node.inner:
                    part.main += size
            elif part is not None:
                part.linked += size

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            step, up = node, []
            while step is not None and step.tag != tag:
                up.append(step)
                step = step.above
            if step is None or step.above is None or tag not in _SCOPE and any(n.tag in _SCOPE for n in up):
                if tag == "p" or tag in _BLOCK and step is not None:
                    close_block()
                continue
            if step.block or any(n.block for n in up):
                close_block()
            anchor -= sum(n.tag == "a" for n in [*up, step])
            node = step.above
            continue
        if tag in _RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            if end < 0:
                at = len(page)
                break
            at = page.find(">", end) + 1 or len(page)
            if tag == "textarea" and node.soft is not None:
                node.soft.fields += 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                close_block()
            elif tag == "input" and node.soft is not None and not _UNSEEN.search(m[3]):
                node.soft.fields += 1
            continue
        if tag in _BLOCK:
            close_block()
            step, goal = node, None
            while step.above is not None and step.tag not in _SCOPE:
                if step.tag in _CLOSES.get(tag, ()) or step.tag == "p" or step.tag[0] == "h" and step.tag[1:].isdigit() and tag[0] == "h" and tag[1:].isdigit():
                    goal = step
                step = step.above
            if goal is not None:
                while node is not goal.above:
                    anchor -= node.tag == "a"
                    node = node.above
        node = _Node(tag, node, m[3])
        if node.soft is node:
            parts.append(node)
        elif tag == "select" and node.soft is not None:
            node.soft.fields += 1
        anchor += tag == "a"
    if at < len(page):
        add(page[at:])
    close_block()
    _decide(parts)
    blocks = []
    for pieces, box in found:
        pieces = [x for x in pieces if x[2] is None or x[2].kept]
        joined = " ".join("".join(x[0] for x in pieces).split())
        if joined:
            blocks.append((joined, min(sum(x[1] for x in pieces), len(joined)), box))
    return blocks


def main_text(page: str) -> str:
    blocks = _blocks(page)
    touched: dict[int, _Node] = {}
    for text, linked, node in blocks:
        plain = 1 - linked / len(text)
        points = (1 + text.count(",") + text.count("，") + text.count("、") + min(3, len(text) // 100)) * plain
        box = node.above if node.tag in ("p", "pre", "blockquote", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "figcaption") and node.above is not None else node
        for share in _SHARES:
            if box is None:
                break
            box.points += points * share
            touched[id(box)] = box
            box = box.above
        up = node
        while up is not None:
            up.chars += len(text)
            up.link_chars += linked
            up = up.above
    if not touched:
        return ""
    best = max(touched.values(), key=lambda n: (n.points * (1 - n.link_chars / max(1, n.chars)), n.tag in ("article", "main")))
    whole = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.above
    top = whole or best
    kept = []
    for text, linked, node in blocks:
        menu = _menu(node, top)
        if menu:
            continue
        step = node
        while step is not None and step is not top and step.above is not top.above:
            step = step.above
        if step is None:
            continue
        if step is not top:
            plain = linked < len(text) / 4
            if whole is not None and step.tag not in ("article", "main"):
                continue
            if not (step.points >= best.points / 5 and plain or step.tag == "p" and plain and len(text) > 80 or step.tag in ("h1", "h2") and plain):
                continue
        kept.append(text)
    return "\n".join(kept)


def _menu(node: _Node, top: _Node) -> bool:
    """In a list, table or division that is nearly all link text; a numbered list of an article is its references."""
    while node is not None and node is not top:
        if node.tag == "ol" and top.tag in ("article", "main"):
            return False
        if node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.chars and node.link_chars > 0.8 * node.chars:
            return True
        node = node.above
    return False


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row; empty text for a null or empty page or one without an article.

    Pages are parsed where they lie; no shuffle. Whole pages are read, nothing is cut by length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splits(batches, "html"):
            texts = [main_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
