"""Style sheets of Word files: one Arrow function reads the sheet; inheritance is resolved in columns.

A row holds all styles of its file, so that resolving needs no join and no shuffle: from each style a fold walks along
``based_on`` and keeps of each property the nearest value. ``spacing``, ``ind`` and ``num`` are groups: the nearest one that is
there counts as a whole. A cycle ends where it would visit a style again; an unknown base ends it too.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import arrow_function

# The name space of the elements (two editions), and the attributes of the groups.
SPACES = ("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://purl.oclc.org/ooxml/wordprocessingml/main}")
SHEET = "word/styles.xml"
SPACING = {"line": "line", "before": "before", "after": "after", "line_rule": "lineRule"}
INDENT = {"left": "left", "right": "right", "first_line": "firstLine", "hanging": "hanging"}
RUN_FIELDS = ("bold", "italic", "underline", "strike", "vert_align", "font_size", "font_family", "color", "highlight", "bg")
PARAGRAPH_FIELDS = ("jc", "spacing", "ind", "num")

RUN = "struct<bold:boolean,italic:boolean,underline:boolean,strike:boolean,vert_align:string,font_size:string,font_family:string,color:string,highlight:string,bg:string>"
PARAGRAPH = "struct<jc:string,spacing:struct<line:string,before:string,after:string,line_rule:string>,ind:struct<left:string,right:string,first_line:string,hanging:string>,num:struct<num_id:string,ilvl:string>>"
STYLE = f"struct<id:string,type:string,based_on:string,run:{RUN},paragraph:{PARAGRAPH}>"


class _Sheet:
    def __init__(self, root: ElementTree.Element):
        self.root = root
        self.space = next((s for s in SPACES if root.tag.startswith(s)), SPACES[0])

    def first(self, around: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
        """The first element of the name below another, in document order."""
        return None if around is None else next((e for e in around.iter(self.space + name) if e is not around), None)

    def value(self, e: ElementTree.Element | None, name: str = "val") -> str | None:
        return None if e is None else e.get(self.space + name)

    def run(self, e: ElementTree.Element | None) -> dict | None:
        """Run properties; what has no element is null."""
        if e is None:
            return None
        on = lambda name, *off: None if (found := self.first(e, name)) is None else self.value(found) not in off
        text = lambda name, *attrs: None if (found := self.first(e, name)) is None else next(filter(None, (self.value(found, a) for a in attrs)), "")
        return {
            "bold": on("b", "0", "false"), "italic": on("i", "0", "false"), "underline": on("u", "none"), "strike": on("strike", "0", "false"),
            "vert_align": text("vertAlign", "val"), "font_size": text("sz", "val"), "font_family": text("rFonts", "ascii", "hAnsi"),
            "color": text("color", "val"), "highlight": text("highlight", "val"), "bg": text("shd", "fill"),
        }

    def paragraph(self, e: ElementTree.Element | None) -> dict | None:
        if e is None:
            return None
        group = lambda name, names: None if (found := self.first(e, name)) is None else {k: self.value(found, a) or None for k, a in names.items()}
        num, jc = self.first(e, "numPr"), self.first(e, "jc")
        return {
            "jc": None if jc is None else self.value(jc) or "", "spacing": group("spacing", SPACING), "ind": group("ind", INDENT),
            "num": None if num is None else {"num_id": self.value(self.first(num, "numId")) or None, "ilvl": self.value(self.first(num, "ilvl")) or None},
        }

    def row(self) -> dict:
        defaults, found = self.first(self.root, "docDefaults"), {}
        for e in self.root.iter(self.space + "style"):
            if ident := self.value(e, "styleId"):  # of equal ids the last counts
                found[ident] = {"id": ident, "type": self.value(e, "type"), "based_on": self.value(self.first(e, "basedOn")), "run": self.run(self.first(e, "rPr")), "paragraph": self.paragraph(self.first(e, "pPr"))}
        return {
            "styles": list(found.values()), "default_run": self.run(self.first(self.first(defaults, "rPrDefault"), "rPr")),
            "default_paragraph": self.paragraph(self.first(self.first(defaults, "pPrDefault"), "pPr")), "error": None,
        }


def _read(content: bytes | None) -> dict:
    nothing = dict.fromkeys(("styles", "default_run", "default_paragraph", "error"))
    if content is None:
        return nothing
    try:
        if content[:2] == b"PK":
            content = zipfile.ZipFile(io.BytesIO(content)).read(SHEET)
        return _Sheet(ElementTree.fromstring(content)).row()
    except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, ValueError, NotImplementedError, EOFError) as fault:
        return nothing | {"error": f"{type(fault).__name__}: {fault}"}


@arrow_function(f"styles array<{STYLE}>, default_run {RUN}, default_paragraph {PARAGRAPH}, error string")
def _sheets(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(None if c is None else bytes(c)) for c in content], columns=["styles", "default_run", "default_paragraph", "error"])


def sheets(df: DataFrame, content: str = "content") -> DataFrame:
    """df with ``docx``: styles, default_run, default_paragraph, error. The content is a Word file or its styles.xml. Null gives
    nulls; what can't be read gives an error."""
    return df.withColumn("docx", _sheets(F.col(content).cast("binary")))


def _nearest(own: Column, base: Column, fields: tuple[str, ...]) -> Column:
    return F.struct(*(F.coalesce(own[f], base[f]).alias(f) for f in fields))


def resolved(styles: Column) -> Column:
    """Array of the styles with all that they inherit; ``based_on`` stays, and the type is a style's own."""
    by_id = F.map_from_entries(F.transform(styles, lambda s: F.struct(s["id"], s)))

    def one(style: Column) -> Column:
        start = F.struct(style["based_on"].alias("next"), F.array(style["id"]).alias("seen"), _nearest(style["run"], style["run"], RUN_FIELDS).alias("run"), _nearest(style["paragraph"], style["paragraph"], PARAGRAPH_FIELDS).alias("paragraph"))

        def step(acc: Column, _: Column) -> Column:
            base = F.try_element_at(by_id, acc["next"])
            go = base.isNotNull() & ~F.array_contains(acc["seen"], acc["next"])
            further = F.struct(base["based_on"].alias("next"), F.concat(acc["seen"], F.array(acc["next"])).alias("seen"), _nearest(acc["run"], base["run"], RUN_FIELDS).alias("run"), _nearest(acc["paragraph"], base["paragraph"], PARAGRAPH_FIELDS).alias("paragraph"))
            return F.when(F.coalesce(go, F.lit(False)), further).otherwise(acc.withField("next", F.lit(None).cast("string")))

        end = F.aggregate(F.sequence(F.lit(1), F.size(styles)), start, step)
        return F.struct(style["id"].alias("id"), style["type"].alias("type"), style["based_on"].alias("based_on"), end["run"].alias("run"), end["paragraph"].alias("paragraph"))

    return F.when(F.size(styles) > 0, F.transform(styles, one)).otherwise(styles)


def style_of(styles: Column, ident: Column) -> Column:
    """Of resolved styles the one of the id; an id that is null or unknown gives a bare paragraph."""
    bare = F.struct(ident.alias("id"), F.lit("paragraph").alias("type"), F.lit(None).cast("string").alias("based_on"), F.lit(None).cast(RUN).alias("run"), F.lit(None).cast(PARAGRAPH).alias("paragraph"))
    return F.coalesce(F.get(F.filter(styles, lambda s: s["id"] == ident), F.lit(0)), bare)


def merged_run(*runs: Column) -> Column:
    """Run properties put together, later ones before earlier; absent ones don't count."""
    return F.struct(*(F.coalesce(*(r[f] for r in reversed(runs))).alias(f) for f in RUN_FIELDS))
