"""A forgiving HTML tree, built with the standard library's tokenizer."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open element of the same line, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that stand as blocks of their own; their start ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas".split())
#: Elements that are never main text.
DROPPED = RAW | frozenset("nav footer aside form button select input dialog menu head audio video embed map".split())
#: Elements nested deeper than this are read as if they stood one after another.
DEPTH = 150


class Node:
    """An element (tag, attributes, children) or a text (tag "#", its text)."""

    __slots__ = ("attrs", "children", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text, self.children = tag, attrs or {}, text, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.deeper: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.close_to({"p"}, {"article", "section", "div", "td", "th", "li", "body", "main", "aside", "blockquote", "figure", "button"})
        if tag in CLOSES:
            self.close_to(CLOSES[tag], HOLDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            if len(self.open) < DEPTH or tag in DROPPED:
                self.open.append(node)
            else:
                self.deeper.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def close_to(self, tags, stop):
        """Closes the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                self.deeper.clear()
                return
            if self.open[k].tag in stop:
                return

    def handle_endtag(self, tag):
        if tag in self.deeper:
            while self.deeper.pop() != tag:
                pass
            if tag in BLOCKS:  # what follows is another block
                self.open[-1].children.append(Node(tag))
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                self.deeper.clear()
                return
            # An end tag of an inline element doesn't reach beyond its block.
            if tag not in BLOCKS and self.open[k].tag in BLOCKS:
                return

    def handle_data(self, data):
        here = self.open[-1].children
        if here and here[-1].tag == "#":
            here[-1].text += data
        else:
            here.append(Node("#", text=data))


def parse(html: str | None) -> Node:
    """The tree of a page; anything is accepted."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
