"""Pages of compiled help: clean-up of their markup, and their pictures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import arrow_function
from vellumspark.operators.html_tree import Element, parse

# Words that mark links to neighbouring pages, the share of such links, elements that go, types of pictures.
ALT_WORDS, HREF_WORDS = ("previous", "prev", "next", "forward"), ("prev", "next", "back", "forward")
SHARE = 0.3
DROPPED = frozenset("object embed applet".split())
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "ico": "image/x-icon"}
OTHER = "application/octet-stream"
OUTSIDE = ("data:", "blob:", "http://", "https://")


def _leads_on(link: Element) -> bool:
    href = link.attrs.get("href", "").lower()
    picture = next((e for e in link.walk() if e.tag == "img"), None)
    if not href or picture is None:
        return False
    alt = picture.attrs.get("alt", "").lower()
    return any(w in alt for w in ALT_WORDS) or any(w in href for w in HREF_WORDS)


def _without(root: Element, drop) -> None:
    """Takes out the elements below root for which ``drop`` holds."""
    todo = [root]
    while todo:
        e = todo.pop()
        e.children = [c for c in e.children if isinstance(c, str) or not drop(c)]
        todo += e.elements()


def cleaned(markup: str) -> str:
    """A page without tables of links to its neighbours, without a table of one cell around all of it, and without objects."""
    root = parse(markup)
    body, tables = root.elements()[-1], set()
    for table in body.walk():
        if table.tag == "table":
            links = [e for e in table.walk() if e.tag == "a"]
            leading = sum(map(_leads_on, links))
            if leading and leading / len(links) > SHARE:
                tables.add(id(table))
    _without(body, lambda e: id(e) in tables)
    around = body.elements()
    if len(around) == 1 and around[0].tag == "table":
        cells = [e for e in around[0].walk() if e.tag == "td"]
        if len(cells) == 1:
            inside = Element("div")
            inside.children = cells[0].children
            body.children = [inside]
    _without(body, lambda e: e.tag in DROPPED)
    return root.outer()


@arrow_function("html string, error string")
def _cleaned(markup: pd.Series) -> pd.DataFrame:
    def one(m):
        if m is None:
            return None, None
        try:
            return cleaned(m), None
        except Exception as fault:  # the page stays as it is, and says why
            return m, f"{type(fault).__name__}: {fault}"

    return pd.DataFrame([one(m) for m in markup], columns=["html", "error"])


def cleanup(markup: Column) -> Column:
    """Struct (html, error) of a page; one that can't be parsed stays as it is, with an error. Null gives nulls."""
    return _cleaned(markup)


def path_of(base: Column, ref: Column) -> Column:
    """A reference as a path of the archive: beside its page unless it begins with a slash, without ``.`` and ``..``."""
    whole = F.when(F.substring(F.translate(ref, "\\", "/"), 1, 1) == "/", ref).otherwise(F.concat(F.regexp_replace(base, r"[^/\\]*$", ""), ref))
    parts = F.filter(F.split(whole, "/"), lambda p: p != ".")

    def step(acc: Column, p: Column) -> Column:
        return F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def pictures(refs: DataFrame, files: DataFrame, archive: str, base: str = "base", src: str = "src") -> DataFrame:
    """refs with ``uri``: of files (``archive``, path, content) the one that src names as a data URI, looked for as the path and then
    with slashes for backslashes and none at the start. A reference to the outside, null, empty or without a file stays as it is. Of
    files with one path the first in byte order counts. What is looked up are distinct paths, each with its file once."""
    outside = (F.col(src) == "") | F.greatest(*(F.col(src).startswith(x).cast("int") for x in OUTSIDE)).cast("boolean")
    rows = refs.withColumn("_path", F.when(~outside, path_of(F.col(base), F.col(src))))
    rows = rows.withColumn("_other", F.regexp_replace(F.translate("_path", "\\", "/"), "^/+", ""))
    asked = rows.select(archive, F.explode(F.array_distinct(F.array("_path", "_other"))).alias("_asked")).where("_asked is not null").distinct()
    held = files.select(archive, F.col("path").alias("_asked"), "content").join(asked, [archive, "_asked"], "left_semi").groupBy(archive, "_asked").agg(F.min("content").alias("_content"))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair)), F.lower(F.substring_index("_asked", ".", -1)))
    held = held.select(archive, "_asked", F.concat(F.lit("data:"), F.coalesce(kind, F.lit(OTHER)), F.lit(";base64,"), F.replace(F.replace(F.base64("_content"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))).alias("_uri"))
    out = rows.join(held.toDF(archive, "_path", "_first"), [archive, "_path"], "left").join(held.toDF(archive, "_other", "_second"), [archive, "_other"], "left")
    return out.withColumn("uri", F.coalesce("_first", "_second", src)).select(*refs.columns, "uri")
