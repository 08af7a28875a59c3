"""Trees of block elements and their texts from HTML as browsers read it: unclosed, misnested and cut-off tags."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# ---- fixed values: element kinds of HTML --------------------------------------------------------
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style template noscript noembed noframes iframe textarea title svg math select object canvas audio video xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an element of the first kind ends those of the second, up to one of the third
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tr": ("tr td th caption", "table"), "tbody": ("tbody thead tfoot tr td th caption", "table"),
    "thead": ("tbody thead tfoot tr td th caption", "table"), "tfoot": ("tbody thead tfoot tr td th caption", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
CELLS = frozenset("td th table caption".split())
PARAGRAPH = frozenset(("p",))
# ------------------------------------------------------------------------------------------------

TOKEN = re.compile(
    r"<!--(?:(?!-->|--!>)[\s\S])*+(?:-->|--!>|\Z)"  # comments
    r"|<!\[CDATA\[(?:(?!\]\]>)[\s\S])*+(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</[^a-zA-Z>][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')?+|[^>=]++)*+)(?:>|\Z)"""
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


@dataclass
class Tree:
    """Nodes with parents first: elements, and leaves (tag '#text') with a block's text."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    texts: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])  # characters of a leaf inside links


def parse(html: str) -> Tree:
    """The tree of a page. Character references are decoded, white space of a block becomes single spaces.

    A leaf is the text of a block element up to its next block element; inline elements leave no trace
    but `linked`. Comments, scripts, styles and other unseen elements have no text. A null page is empty.
    """
    html = html or ""
    tree = Tree()
    tags, parents, attributes = tree.tags, tree.parents, tree.attributes
    stack = [0]
    open_now: Counter = Counter()  # elements on the stack by tag
    run: list[str] = []
    linked = 0
    link = -1  # stack height at which a link was opened

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                tags.append("#text")
                parents.append(stack[-1])
                attributes.append("")
                tree.texts.append(text)
                tree.linked.append(min(linked, len(text)))
            run.clear()
            linked = 0

    def add_text(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        run.append(text)
        if link >= 0:
            linked += len(text)

    def pop_to(height: int) -> None:
        nonlocal link
        flush()
        open_now.subtract(tags[s] for s in stack[height:])
        del stack[height:]
        if link > height:
            link = -1

    def open_(name: str, raw: str) -> None:
        tags.append(name)
        parents.append(stack[-1])
        attributes.append(raw.strip())
        tree.texts.append("")
        tree.linked.append(0)
        stack.append(len(tags) - 1)
        open_now[name] += 1

    def close(kinds: frozenset, until: frozenset) -> None:
        if not any(open_now[k] > 0 for k in kinds):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = tags[stack[i]]
            if tag in kinds:
                height = i
                while height > 1 and tags[stack[height - 1]] in kinds:
                    height -= 1
                pop_to(height)
                return
            if tag in until:
                return

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            add_text(html[at:])
            break
        if m.start() > at:
            add_text(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                link = -1
            elif name in BLOCKS and name not in ("html", "body") and (open_now[name] > 0 or name in HEADINGS and any(open_now[h] > 0 for h in HEADINGS)):
                for i in range(len(stack) - 1, 0, -1):
                    tag = tags[stack[i]]
                    if tag == name or (name in HEADINGS and tag in HEADINGS):
                        pop_to(i)
                        break
                    if tag in CELLS and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                        break
            continue
        if name in UNSEEN and not m.group(3).endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name == "a":
            link = len(stack)
        elif name == "br":
            run.append(" ")
        elif name in BLOCKS:
            if name in ("html", "body"):
                if name == "body" and len(stack) == 1:
                    flush()
                    open_(name, m.group(3))
                continue
            flush()
            if name in ENDS:
                close(*ENDS[name])
            elif name in HEADINGS and tags[stack[-1]] in HEADINGS:
                pop_to(len(stack) - 1)
            close(PARAGRAPH, CELLS)
            if name != "hr":
                open_(name, m.group(3))
    flush()
    return tree


def attributes_of(raw: str) -> dict[str, str]:
    """Name -> decoded value of an element's attributes, the first of equal names."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape("".join(values)))
    return out
