"""Trees of block elements from HTML as it comes, with the texts in them.

Parsing forgives: missing and superfluous end tags, unclosed paragraphs and lists, cut-off pages. Inline elements
do not end a text; block elements do. A text that is an element's only content is held by the element itself,
others by a node of their own among its children. Elements nested deeper than DEEPEST become siblings. Nodes are in an order in which parents come before children.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Elements without content, of unparsed content, never shown as text, within a line, and those that a
# start tag closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_SILENT = frozenset(
    "script style xmp iframe noembed noframes textarea title head template noscript svg math object canvas audio video select button".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp slot small "
    "span strike strong sub sup time tt u var img input wbr br embed area param source track link meta picture map".split()
)
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_CONTROLS = frozenset("input select button textarea".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li dt dd main menu nav ol p pre search section summary table ul".split()
)
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
# An end tag or a start tag that closes a paragraph does not reach beyond these.
_WALLS = frozenset("table td th button object template".split())

_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?)*+)>"""
)
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in _RAW}
_NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s/"'])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

TEXT = "#text"
DEEPEST = 512


@dataclass
class Tree:
    """Nodes of a page: tags, numbers of parents (-1 for the root), attribute tokens, controls; and texts by node."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    # For each text in page order: its node, the text, and how many of its characters are links.
    owners: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def attribute_tokens(attributes: str) -> list[str]:
    """Lower-case parts of class, id and role, each told apart by case, digits and marks."""
    found = []
    for name, *values in _NAMED.findall(attributes):
        prefix = "role=" if name.lower() == "role" else ""
        for part in _PARTS.findall(next(filter(None, values), "")):
            found.append(prefix + part.lower())
    if _HIDDEN.search(attributes):
        found.append("hidden")
    return found


class _Builder:
    def __init__(self) -> None:
        self.tree = Tree()
        self.stack = [self._node("body", -1, [])]
        self.children = [0]
        self.lone: dict[int, int] = {}  # Text held by an element itself.
        self.pieces: list[str] = []
        self.link_pieces: list[str] = []
        self.link_level = 0  # Elements open where the link began; 0 outside links.
        self.silent: list[str] = []
        self.unseen: Counter[str] = Counter()  # Elements open within silent ones.
        self.open: Counter[str] = Counter()  # Elements open otherwise, by tag.
        self.deeper: Counter[str] = Counter()  # Elements open below the deepest level.

    def _node(self, tag: str, parent: int, tokens: list[str]) -> int:
        tree = self.tree
        tree.tags.append(tag)
        tree.parents.append(parent)
        tree.tokens.append(tokens)
        tree.controls.append(0)
        return len(tree.tags) - 1

    def _child(self, tag: str, parent: int, tokens: list[str]) -> int:
        """A node below `parent`; a text that the parent held itself gets a node of its own."""
        text = self.lone.pop(parent, None)
        if text is not None:
            self.tree.owners[text] = self._node(TEXT, parent, [])
            self.children.append(0)
        node = self._node(tag, parent, tokens)
        self.children.append(0)
        self.children[parent] += 1
        return node

    def text(self, raw: str) -> None:
        if self.silent or not raw:
            return
        if "&" in raw:
            raw = unescape(raw)
        self.pieces.append(raw)
        if self.link_level:
            self.link_pieces.append(raw)

    def flush(self) -> None:
        """End the current text, if there is one."""
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        linked = len(" ".join("".join(self.link_pieces).split())) if self.link_pieces else 0
        self.pieces, self.link_pieces = [], []
        if not text:
            return
        tree, owner = self.tree, self.stack[-1]
        number = len(tree.texts)
        if self.children[owner] or owner in self.lone:
            owner = self._child(TEXT, owner, [])
        else:
            self.lone[owner] = number
        tree.owners.append(owner)
        tree.texts.append(text)
        tree.linked.append(min(linked, len(text)))

    def _pop_to(self, level: int) -> None:
        self.flush()
        for node in self.stack[level:]:
            self.open[self.tree.tags[node]] -= 1
        del self.stack[level:]
        if self.link_level > level:
            self.link_level = 0

    def _close(self, closing: set[str], walls) -> None:
        """Close the innermost open element among `closing`, if no wall is in between."""
        if not any(self.open[tag] for tag in closing):
            return
        tags = self.tree.tags
        for level in range(len(self.stack) - 1, 0, -1):
            tag = tags[self.stack[level]]
            if tag in closing:
                self._pop_to(level)
                return
            if tag in walls:
                return

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if self.silent == ["head"] and tag not in _IN_HEAD:
            self.silent.clear()
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            elif not closed and tag not in _VOID:
                self.unseen[tag] += 1
            return
        if tag in _CONTROLS:
            self.tree.controls[self.stack[-1]] += 1
        if tag in _SILENT:
            self.silent.append(tag)
        elif tag in ("html", "body"):
            self.flush()
            self.tree.tokens[0] += attribute_tokens(attributes)
        elif tag == "br":
            self.text(" ")
        elif tag == "a":
            self.link_level = len(self.stack)
        elif tag in _INLINE:
            return
        else:
            self.flush()
            if tag in _ENDS_PARAGRAPH:
                self._close({"p"}, _WALLS)
            if tag in _ENDED_BY:
                closing, walls = _ENDED_BY[tag]
                for _ in closing:
                    self._close(closing, walls)
            if len(self.stack) >= DEEPEST:
                self.deeper[tag] += 1
            elif tag != "hr":
                self.open[tag] += 1
                self.stack.append(self._child(tag, self.stack[-1], attribute_tokens(attributes) if attributes else []))

    def end(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif self.unseen[tag]:
                self.unseen[tag] -= 1
            elif self.open[tag]:
                self.silent.clear()  # One that was never closed ends with what it is in.
            if self.silent or not self.open[tag]:
                return
        if tag == "a":
            self.link_level = 0
        elif tag == "br":
            self.text(" ")
        elif tag not in _INLINE and tag not in ("html", "body"):
            self.flush()
            if self.deeper[tag]:
                self.deeper[tag] -= 1
                return
            self._close({tag}, () if tag in _WALLS else _WALLS)


def parse(html: str) -> Tree:
    """Tree of a page. A comment without end reaches to the end of the page, as does unparsed content."""
    builder = _Builder()
    at, size = 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            builder.text(html[at:])
            break
        if mark > at:
            builder.text(html[at:mark])
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 2)
            at = size if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), mark):
            end = html.find(">", mark)
            at = size if end < 0 else end + 1
        else:
            found = _TAG.match(html, mark)
            if not found:
                following = html[mark + 1 : mark + 3]
                if following[:1].isalpha() or following[:1] == "/" and following[1:].isalpha():
                    break  # A tag that the end of the page cuts off.
                builder.text("<")
                at = mark + 1
                continue
            at = found.end()
            closing, tag, attributes = found.groups()
            tag = tag.lower()
            if closing:
                builder.end(tag)
                continue
            builder.start(tag, attributes, attributes.endswith("/"))
            if tag in _RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.start() if end else size
    builder.silent.clear()
    builder.flush()
    return builder.tree
