"""A tree of an HTML page from the standard tokenizer, by the main rules of the HTML standard.

Supported: void and raw-text elements, the implied head and body, implied ends of p, li, dt, dd, tr, td, th, option,
headings, the reopening of formatting elements that a block left open, and what stands loose in a table going before it. Not
supported: the adoption agency for interleaved formatting, templates and frames.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Classes of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD = frozenset("base link meta title style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPE = frozenset("html table td th caption button object body".split())
#: Elements between which nothing but parts of a table may stand, and those parts.
IN_TABLE = frozenset("table thead tbody tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
#: Parts that a table has though the markup leaves them out, and where.
_IMPLIED = {"tr": ("tbody",), "td": ("tbody", "tr"), "th": ("tbody", "tr")}
_IMPLIED_IN = {"tbody": {"table"}, "tr": {"tbody", "thead", "tfoot"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one ends an open one of these, unless an element of the second set is open in between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}


class Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    # Trees may be deeper than Python's stack, so nothing here recurses.
    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return "".join(out)

    def elements(self):
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self):
        """Descendants in document order."""
        todo = self.elements()[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.elements()[::-1]

    def inner(self) -> str:
        """Markup of the content; & < > and no-break spaces of text are escaped."""
        out, todo = [], [(c, self.tag) for c in reversed(self.children)]
        while todo:
            node, around = todo.pop()
            if isinstance(node, Element):
                out.append(node.start())
                if node.tag not in VOID:
                    todo.append((f"</{node.tag}>", None))
                    todo += ((c, node.tag) for c in reversed(node.children))
            elif around is None or around in ("script", "style"):
                out.append(node)
            else:
                out.append(node.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        return "".join(out)

    def start(self) -> str:
        return f"<{self.tag}" + "".join(' {}="{}"'.format(k, v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")) for k, v in self.attrs.items()) + ">"

    def outer(self) -> str:
        return self.start() + ("" if self.tag in VOID else f"{self.inner()}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Element("html"), Element("head"), Element("body")
        self.html.children = [self.head, self.body]
        self.open, self.in_head, self.again = [self.head], True, []

    def _into_body(self):
        if self.in_head:
            self.in_head, self.open = False, [self.body]

    def _append(self, node):
        last = self.open[-1]
        if last.tag in IN_TABLE and not (isinstance(node, Element) and node.tag in TABLE_PARTS):
            self._foster(node)
        else:
            last.children.append(node)

    def _foster(self, node):
        """What may not stand in a table goes before it."""
        at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == "table")
        around = self.open[at - 1].children
        place = next(i for i in range(len(around) - 1, -1, -1) if around[i] is self.open[at])
        if isinstance(node, str) and place and isinstance(around[place - 1], str):
            around[place - 1] += node
        else:
            around.insert(place, node)

    def _close(self, at: int):
        for e in self.open[at:]:
            if e.tag in FORMATTING and e is not self.open[at]:
                self.again.append(e)
        del self.open[at:]

    def _find(self, tags, stop=SCOPE):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in stop:
                return None
        return None

    def _reopen(self):
        again, self.again = self.again, []
        for e in again:
            new = Element(e.tag, e.attrs)
            self._append(new)
            self.open.append(new)

    def handle_starttag(self, tag, attrs):
        found = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._into_body()
                self.body.attrs = found | self.body.attrs
            return
        if self.in_head and tag not in HEAD:
            self._into_body()
        if not self.in_head:
            if tag in ENDS_P and (at := self._find({"p"})) is not None:
                self._close(at)
            if tag in SIBLINGS and (at := self._find(SIBLINGS[tag][0], SIBLINGS[tag][1])) is not None:
                ends, stop = SIBLINGS[tag]
                while at is not None:
                    self._close(at)
                    at = self._find(ends, stop)
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self._close(len(self.open) - 1)
            if tag not in ENDS_P and tag not in SIBLINGS and tag not in HEAD:
                self._reopen()
            for part in _IMPLIED.get(tag, ()):
                if self.open[-1].tag in _IMPLIED_IN[part]:
                    made = Element(part)
                    self._append(made)
                    self.open.append(made)
        e = Element(tag, found)
        self._append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._into_body()
            return
        if tag in FORMATTING and any(e.tag == tag for e in self.again):
            self.again.remove(next(e for e in reversed(self.again) if e.tag == tag))
            return
        names = HEADINGS if tag in HEADINGS else {tag}
        if (at := self._find(names, frozenset() if tag not in ("p", "li") else SCOPE)) is not None:
            self._close(at)
        elif tag == "p":
            self._append(Element("p"))

    def handle_data(self, data):
        if self.in_head and self.open[-1] is self.head:
            if not data.strip():
                return
            self._into_body()
        if not self.in_head and self.open[-1].tag not in ("script", "style", "table", "tbody", "thead", "tfoot", "tr"):
            self._reopen()
        if self.open[-1].tag in IN_TABLE and data.strip():
            self._foster(data)
            return
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def parse(markup: str) -> Element:
    """The html element, with a head and a body."""
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.html
