"""Web pages as small trees in arrays: a forgiving reader of tags, text runs as leaves."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Comments and declarations; or a tag: name, then attributes, in whose quoted values > does not end it.
_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?|[^=>])*+)(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

# Elements of HTML by how they nest and show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = RAW | frozenset("head template noscript svg canvas object audio video select datalist option button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - frozenset("body caption dd dt html li tbody td tfoot th thead tr".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_WALLS = frozenset("table td th caption button".split())
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass
class Page:
    """Nodes in document order, parents before children. A node is an element (its tag, names from its attributes) or a
    text run (tag '#text', the text with white space made single); hidden text is no node."""

    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    spaces: list[tuple[bool, bool]] = field(default_factory=list)


def _named(attributes: str) -> str:
    return " ".join(f"{m[1].lower()}={unescape(m[2] or m[3] or m[4] or '')}" for m in _NAMED.finditer(attributes)) if "=" in attributes else ""


def read_page(html: str | None) -> Page:
    """The tree of a page. Paragraphs, items and cells end where the next begins; end tags that fit nothing open are
    passed over; what is open at the end ends there. Text in scripts, styles, forms' own fields and the head is left out."""
    page, html = Page(), html or ""
    page.parents.append(-1)
    page.tags.append("#page")
    page.names.append("")
    page.texts.append("")
    page.spaces.append((False, False))
    open_nodes, open_tags, hidden, at = [0], ["#page"], 0, 0

    def add(tag: str, names: str, text: str, spaces: tuple[bool, bool]) -> int:
        page.parents.append(open_nodes[-1])
        page.tags.append(tag)
        page.names.append(names)
        page.texts.append(text)
        page.spaces.append(spaces)
        return len(page.tags) - 1

    def close(depth: int) -> None:
        nonlocal hidden
        hidden -= sum(t in HIDDEN for t in open_tags[depth:])
        del open_nodes[depth:], open_tags[depth:]

    def close_open(tags: set | frozenset, walls: set | frozenset) -> None:
        for depth in range(len(open_tags) - 1, 0, -1):
            if open_tags[depth] in tags:
                return close(depth)
            if open_tags[depth] in walls:
                return None

    def say(raw: str) -> None:
        if raw and not hidden:
            text = unescape(raw) if "&" in raw else raw
            if clean := " ".join(text.split()):
                add("#text", "", clean, (text[0].isspace(), text[-1].isspace()))
            elif page.tags[-1] == "#text":
                page.spaces[-1] = (page.spaces[-1][0], True)
            else:
                add("#space", "", "", (True, True))

    while found := _MARKUP.search(html, at):
        say(html[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for depth in range(len(open_tags) - 1, 0, -1):
                if open_tags[depth] == tag:
                    close(depth)
                    break
                if open_tags[depth] in (BLOCK if tag not in BLOCK else _WALLS if tag not in _TABLE else ()):
                    break  # such an end tag fits nothing within the block, or the cell
            continue
        if tag in _ENDS_P:
            close_open({"p"}, _WALLS)
        if tag in _CLOSES:
            close_open(*_CLOSES[tag])
        if tag in RAW:
            end = _ENDS[tag].search(html, at)
            at = end.start() if end else len(html)
        node = add(tag, _named(found[3] or ""), "", (False, False))
        if tag not in VOID:
            open_nodes.append(node)
            open_tags.append(tag)
            hidden += tag in HIDDEN
    say(html[at:])
    return page


def blocks(page: Page, keep: list[bool]) -> str:
    """The kept text runs as text: blocks joined by two line ends, white space within a block as one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    block_of = [0] * len(page.tags)
    last = 0
    for k, tag in enumerate(page.tags):
        parent = page.parents[k]
        mine = k if tag in BLOCK else (block_of[parent] if parent >= 0 else 0)
        block_of[k] = mine
        if tag in BLOCK or mine != last:
            flush()
        last = mine
        if tag == "#text" and keep[k]:
            before, after = page.spaces[k]
            line.append(f"{' ' * before}{page.texts[k]}{' ' * after}")
        elif tag in ("br", "#space", "#text"):
            line.append(" ")
    flush()
    return "\n\n".join(out)
