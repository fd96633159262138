"""FictionBook files: one Arrow function reads the tree of a file; titles, ids and order of sections are columns.

Malformed XML is read as HTML, where ``image`` elements aren't pictures, so those files have none. Text is put into the
markup as it is unless ``escaped``. Presentation classes of the usual reader are left out. A null content gives null
fields and no sections; a tree too deep to walk gives a row with ``error``.
"""

from __future__ import annotations

from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import arrow_function, trimmed
from vellumspark.operators.html_tree import Element, parse

# Elements of the output, names of the link attribute, and texts.
OUTPUT = {
    "title": "h2", "p": "p", "subtitle": "h3", "emphasis": "em", "v": "em", "strong": "strong", "epigraph": "blockquote",
    "cite": "div", "empty-line": "div", "poem": "div", "stanza": "div",
}
LINKS = ("l:href", "xlink:href", "{http://www.w3.org/1999/xlink}href", "href")
NO_AUTHOR, COVER, CHAPTER = "Ismeretlen szerző", "Borító", ". Fejezet"
NOTICE = "<p>A dokumentum nem tartalmaz olvasható fejezetet.</p>"

BOOK = "title string, author string, cover string, sections array<struct<parent int, label string, html string>>, error string"


def _of_xml(node: ElementTree.Element) -> Element:
    made = Element(node.tag.rpartition("}")[2].lower(), dict(node.attrib))
    made.children = [node.text] if node.text else []
    for child in node:
        made.children.append(_of_xml(child))
        if child.tail:
            made.children.append(child.tail)
    return made


def _first(root: Element, *path: str) -> Element | None:
    """The first element, in document order, of the last name that is a child of the names before it."""
    for e in root.walk():
        if e.tag == path[0]:
            found = next((c for c in e.elements() if c.tag == path[1]), None) if len(path) > 1 else e
            if found:
                return found
    return None


def _words(e: Element | None) -> str:
    return trimmed(e.text()) if e else ""


class _Book:
    def __init__(self, text: str, escaped: bool):
        self.escaped = escaped
        try:
            self.root = _of_xml(ElementTree.fromstring(text))
            self.whole, self.pictures = self.root, True
        except ElementTree.ParseError:
            self.root = parse(text)
            self.whole, self.pictures = _first(self.root, "body") or self.root, False
        self.binaries = {}
        for e in self.root.walk():
            if e.tag == "binary" and e.attrs.get("id") and (data := e.text()):
                self.binaries[e.attrs["id"]] = f"data:{e.attrs.get('content-type') or 'image/jpeg'};base64,{''.join(data.split())}"

    def picture(self, e: Element | None) -> str | None:
        if e is None or not self.pictures:
            return None
        link = next((v for k in LINKS if (v := e.attrs.get(k))), "")
        return self.binaries.get(link.removeprefix("#"))

    def markup(self, e: Element, section: bool = False) -> str:
        """Content of an element; directly in a section its title and inner sections are left out."""
        out = []
        for c in e.children:
            if isinstance(c, str):
                if trimmed(c):
                    out.append(escape(c, quote=False) if self.escaped else c)
            elif section and c.tag in ("section", "title"):
                continue
            elif c.tag == "image":
                if uri := self.picture(c):
                    out.append(f'<img src="{uri}" alt="" />')
            elif name := OUTPUT.get(c.tag):
                out.append(f"<{name}></{name}>" if c.tag == "empty-line" else f"<{name}>{self.markup(c)}</{name}>")
            else:
                out.append(self.markup(c))
        return "".join(out)

    def sections(self) -> list[dict]:
        """Sections of the first body, each before those inside it, with the place of the one around it or -1."""
        rows, body = [], _first(self.root, "body")
        todo = [(-1, s) for s in reversed(body.elements())] if body else []
        while todo:
            parent, e = todo.pop()
            if e.tag != "section":
                continue
            label = _words(next((c for c in e.elements() if c.tag == "title"), None))
            todo += [(len(rows), s) for s in reversed(e.elements())]
            rows.append({"parent": parent, "label": label, "html": self.markup(e, section=True)})
        return rows

    def row(self) -> dict:
        name = " ".join(filter(None, (_words(_first(self.root, "author", n)) for n in ("first-name", "last-name"))))
        page = _first(self.root, "coverpage")
        cover = self.picture(_first(page, "image")) if page else None
        rows = self.sections()
        if not rows and not cover:
            rows = [{"parent": -2, "label": "", "html": self.markup(self.whole) or NOTICE}]
        return {"title": _words(_first(self.root, "book-title")), "author": name or NO_AUTHOR, "cover": cover, "sections": rows, "error": None}


def _read(text: str | None, escaped: bool) -> dict:
    if text is None:
        return dict.fromkeys(("title", "author", "cover", "sections", "error"))
    try:
        return _Book(trimmed(text), escaped).row()
    except RecursionError:
        return dict.fromkeys(("title", "author", "cover", "sections")) | {"error": "the elements are nested too deeply"}


@arrow_function(BOOK)
def _books(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(t, False) for t in text], columns=["title", "author", "cover", "sections", "error"])


@arrow_function(BOOK)
def _escaped_books(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(t, True) for t in text], columns=["title", "author", "cover", "sections", "error"])


def books(df: DataFrame, name: Column, text: Column, escaped: bool = False) -> DataFrame:
    """df with ``fb2``: title (or the stem of the file name), author, cover, sections, error."""
    book = (_escaped_books if escaped else _books)(text)
    stem = F.regexp_replace(name, r"(?i)\.fb2$", "")
    return df.withColumn("fb2", book).withColumn("fb2", F.col("fb2").withField("title", F.when(F.col("fb2.title") == "", stem).otherwise(F.col("fb2.title"))))


def sections(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, ord, id, title, html): the cover first, if there is one, then the sections in document order. A title has
    the title of the section around it before its own, if both have one."""
    book, one = F.col("fb2"), "id string, title string, html string"
    shift = F.when(book["cover"].isNotNull(), 1).otherwise(0)

    def section(s: Column, n: Column) -> Column:
        around = F.when(s["parent"] >= 0, F.get(book["sections"], s["parent"])["label"]).otherwise("")
        numbered = F.concat((n + shift + 1).cast("string"), F.lit(CHAPTER))
        title = F.when(s["parent"] == -2, book["title"]).when(s["label"] == "", numbered).when(around == "", s["label"]).otherwise(F.concat(around, F.lit(" - "), s["label"]))
        return F.struct(F.concat(F.lit("sec-"), (n + shift).cast("string")).alias("id"), title.alias("title"), s["html"].alias("html"))

    picture = F.concat(F.lit('<img src="'), book["cover"], F.lit(f'" alt="{COVER}" />'))
    cover = F.array(F.struct(F.lit("cover").alias("id"), F.lit(COVER).alias("title"), picture.alias("html")))
    none = F.array().cast(f"array<struct<{one.replace(' string', ':string')}>>")
    rows = F.concat(F.when(book["cover"].isNotNull(), cover).otherwise(none), F.transform(book["sections"], section))
    return found.select(*keys, F.posexplode(rows).alias("ord", "s")).select(*keys, "ord", "s.id", "s.title", "s.html")
