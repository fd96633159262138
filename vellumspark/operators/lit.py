"""LIT books, from the container's public description: header, directory, sections with their transforms, manifest, marked-up
items. One Arrow function opens the container; spine, contents and style sheets are put together in columns.

Experimental: no real files were at hand. The tables of element and attribute codes (``Tags``) aren't part of this package:
they are a parameter. Without them the container, its manifest and style sheets can be read, and items have an error.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import lzx
from vellumspark.functions.text import arrow_function, trim

# Marks, paths, transforms, states of the manifest, texts.
MAGIC, DIRECTORY, CHUNK, CONTENT = b"ITOLITLS", b"IFCM", b"AOLL", b"ITSF"
NAMES, STORAGE = "::DataSpace/NameList", "::DataSpace/Storage/"
ENCRYPTED, PACKED = "{67F6E4A2-60BF-11D3-8540-00C04F58C3CF}", "{0A9007C6-4076-11D3-8789-0000F8105754}"
LICENCES = ("/DRMStorage/Licenses/EUL", "/DRMStorage/DRMBookplate")
STATES = ("spine", "not spine", "css", "images")
NO_AUTHOR, PROTECTED = "Ismeretlen szerző", "DRM-védett LIT fájl nem támogatott"


class LitError(ValueError):
    pass


def u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def u16(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def variable(data: bytes, at: int) -> tuple[int, int]:
    """(number, next place): seven bits a byte, the highest first; the high bit says that more follow."""
    value = 0
    while at < len(data):
        value, more, at = value << 7 | data[at] & 0x7F, data[at] & 0x80, at + 1
        if not more:
            break
    return value, at


def guid(data: bytes) -> str:
    return "{" + str(uuid.UUID(bytes_le=data[:16])).upper() + "}"


@dataclass
class Tags:
    """Codes of the markup: names of elements; names of attributes of each element, and of all of them."""

    elements: dict[int, str]
    attributes: dict[int, dict[int, str]] = field(default_factory=dict)
    common: dict[int, str] = field(default_factory=dict)


class Container:
    def __init__(self, data: bytes):
        self.data = data
        if data[:8] != MAGIC:
            raise LitError("Not a valid LIT file")
        if u32(data, 8) != 1:
            raise LitError(f"Unknown LIT version {u32(data, 8)}")
        header, n, second = u32(data, 12), u32(data, 16), u32(data, 20)
        at = data.find(CONTENT, header + 16 * n, header + 16 * n + second)
        self.content = (u32(data, at + 16) or u32(data, at + 20)) if at >= 0 else 0
        if not self.content:
            raise LitError("Could not find content offset")
        places = [(u32(data, header + 16 * k), u32(data, header + 16 * k + 8)) for k in range(min(n, len(data) // 16))]
        pieces = [data[a : a + size] for a, size in places if a or size]
        if len(pieces) < 2:
            raise LitError("Missing directory piece")
        if pieces[1][:4] != DIRECTORY:
            raise LitError("Invalid directory piece")
        self.entries = self._entries(pieces[1])
        names = self.entries.get(NAMES)
        if names is None:
            raise LitError("No NameList in LIT file")
        self.names, self.sections = self._names(self.file(names)), {}

    @staticmethod
    def _entries(piece: bytes) -> dict[str, tuple[int, int, int]]:
        """name -> (section, offset, size), of all chunks; of equal names the first counts."""
        begin, size, n = (32, u32(piece, 8), u32(piece, 24) or 1) if u32(piece, 4) == 1 else (u16(piece, 6) or 24, u32(piece, 16), u32(piece, 20))
        found: dict[str, tuple[int, int, int]] = {}
        for at in range(begin, min(begin + n * size, len(piece)), size or len(piece)):
            chunk = piece[at : at + size]
            if chunk[:4] != CHUNK:
                continue
            end, place = len(chunk) - u32(chunk, 4), 44
            for _ in range(u16(chunk, size - 2)):
                if place >= end:
                    break
                length, place = variable(chunk, place)
                name, place = chunk[place : place + length].decode("utf-8", "replace"), place + length
                section, place = variable(chunk, place)
                offset, place = variable(chunk, place)
                length, place = variable(chunk, place)
                found.setdefault(name, (section, offset, length))
        return found

    @staticmethod
    def _names(raw: bytes) -> list[str]:
        """Names of the sections: a number of them, and each as a length and UTF-16 with a nought behind it."""
        at, out = 4, []
        for _ in range(u16(raw, 2)):
            size = 2 * u16(raw, at) + 2
            if at + 2 + size > len(raw):
                break
            out.append(raw[at + 2 : at + 2 + size].decode("utf-16-le", "replace").replace("\0", ""))
            at += 2 + size
        return out

    def file(self, entry: tuple[int, int, int]) -> bytes:
        section, offset, size = entry
        if section == 0:
            return self.data[self.content + offset : self.content + offset + size]
        if section not in self.sections:
            self.sections[section] = self._section(section)
        return self.sections[section][offset : offset + size]

    def _part(self, path: str) -> bytes | None:
        entry = self.entries.get(path)
        return None if entry is None or entry[0] != 0 else self.file(entry)  # the parts of a section lie outside all sections

    def _section(self, k: int) -> bytes:
        path = STORAGE + (self.names[k] if k < len(self.names) else "")
        content, control, transforms = (self._part(f"{path}/{x}") for x in ("Content", "ControlData", "Transform/List"))
        if content is None or control is None or transforms is None:
            return b""
        while len(transforms) >= 16:
            kind, transforms = guid(transforms), transforms[16:]
            if kind == ENCRYPTED:
                raise LitError(PROTECTED)
            if kind != PACKED:
                raise LitError(f"Unrecognized transform: {kind}")
            table = self._part(f"{path}/Transform/{PACKED}/InstanceData/ResetTable")
            if table is None:
                raise LitError("Missing LZX ResetTable")
            content = self._unpacked(content, control, table)
        return content

    @staticmethod
    def _unpacked(content: bytes, control: bytes, table: bytes) -> bytes:
        """The table has, behind its header, the place of each frame's data; a window's frames make a stream of their own."""
        bits = 14 + u32(control, 12).bit_length()
        if not 15 <= bits <= 21:
            raise LitError(f"Invalid LZX window {bits}")
        size, begin = u32(table, 16), u32(table, 12) + 8
        ends = [u32(table, at) for at in range(begin, len(table) - 3, 8)]
        return lzx.decompress(content, size, bits, [e for e in ends if 0 < e < len(content)], (1 << bits) // lzx.FRAME)

    def manifest(self) -> list[dict]:
        """(internal, original, mime_type, offset, root, state, path) of each item; paths without what all share."""
        entry = self.entries.get("/manifest")
        if entry is None:
            raise LitError("No manifest in LIT file")
        raw, at, items = self.file(entry), 0, []

        def text() -> str:
            nonlocal at
            end = raw.find(b"\0", at)
            end = len(raw) if end < 0 else end
            found, at = raw[at:end].decode("utf-8", "replace"), end + 1
            return found

        while at < len(raw) and raw[at]:
            root, at = raw[at + 1 : at + 1 + raw[at]].decode("utf-8", "replace"), at + 1 + raw[at]
            for state in STATES:
                n, at = u32(raw, at), at + 4
                for _ in range(n):
                    if at + 4 > len(raw):
                        break
                    offset, at = u32(raw, at), at + 4
                    internal, original, mime = text(), text(), text().lower()
                    path = re.sub(r"^[A-Za-z]:/", "", original.replace("\\", "/")).replace("../", "")
                    items.append({"internal": internal, "original": original, "mime_type": mime, "offset": offset, "root": root, "state": state, "path": path})
        if len(items) > 1:
            shared = common_folder([i["path"] for i in items])
            for i in items:
                i["path"] = i["path"][shared:]
        return items


def common_folder(paths: list[str]) -> int:
    """Length of what all paths begin with, up to a slash; of equal paths all of it."""
    a, b = min(paths), max(paths)
    if a == b:
        return len(a)
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return len(a) if n == len(a) and a == paths[0] else a.rfind("/", 0, n) + 1


def marked_up(data: bytes, tags: Tags) -> str:
    """Markup from its codes. Text is UTF-8; a nought begins an element: flags (1 opens, 2 closes), its code, attributes up to
    a nought. Codes and lengths are characters; names that the tables lack are written out behind the code 0x8000."""
    text = data.decode("utf-8", "replace")
    out, opened, at = [], [], 0
    safe = str.maketrans({"<": "&lt;", ">": "&gt;", "\x0b": "\n"})

    def code() -> int:
        nonlocal at
        at += 1
        return ord(text[at - 1]) if at <= len(text) else 0

    def string() -> str:
        nonlocal at
        n = code() - 1  # a length counts from one, and 0xFFFE says that a nought ends the string
        if n == 0xFFFD:
            end = text.find("\0", at)
            end = len(text) if end < 0 else end
            found, at = text[at:end], end + 1
        else:
            found, at = text[at : at + max(0, n)], at + max(0, n)
        return found

    while at < len(text):
        end = text.find("\0", at)
        end = len(text) if end < 0 else end
        out.append(text[at:end].translate(safe))
        at = end + 1
        flags = code() if at < len(text) else 0
        if not flags:
            continue
        if not flags & 1:  # the end of the element that was opened last
            if opened:
                out.append(f"</{opened.pop()}>")
            code()
            continue
        tag = code()
        name = string() if tag == 0x8000 else tags.elements.get(tag)
        if not name:
            raise LitError(f"Unknown tag {tag}")
        out.append(f"<{name}")
        while (attribute := code()) != 0:
            if attribute == 0x8000:
                known = string()
            else:
                known = tags.attributes.get(tag, {}).get(attribute) or tags.common.get(attribute)
            value = string()
            if not known or known.startswith("%"):
                continue
            if known in ("href", "src"):
                value = value[1:]  # its first character tells the kind of the link
            out.append(' {}="{}"'.format(known, value.replace('"', "&quot;").replace("<", "&lt;")))
        if flags & 2:
            out.append(" />")
        else:
            out.append(">")
            opened.append(name)
    return "".join(out) + "".join(f"</{n}>" for n in reversed(opened))


ITEM = "struct<ord:int,internal:string,original:string,mime_type:string,offset:bigint,root:string,state:string,path:string,text:string,error:string>"
BOOK = f"entries array<struct<name:string,section:bigint,offset:bigint,size:bigint>>, items array<{ITEM}>, meta string, meta_error string, error string"


def _open(data: bytes | None, html: Tags | None, meta: Tags | None) -> dict:
    nothing = dict.fromkeys(("entries", "items", "meta", "meta_error", "error"))
    if data is None:
        return nothing
    try:
        box = Container(data)
        entries = [{"name": n, "section": s, "offset": o, "size": z} for n, (s, o, z) in box.entries.items()]
        if any(k in box.entries for k in LICENCES):
            raise LitError(PROTECTED)
        items = box.manifest()
    except (LitError, lzx.LzxError) as fault:
        return nothing | {"error": str(fault)}

    def read(path: str, tags: Tags | None, plain: bool = False) -> tuple[str | None, str | None]:
        entry = box.entries.get(path)
        if entry is None:
            return None, None
        try:
            raw = box.file(entry)
            if plain:
                return raw.decode("utf-8", "replace"), None
            return (None, "no tables of markup codes") if tags is None else (marked_up(raw, tags), None)
        except (LitError, lzx.LzxError) as fault:
            return None, str(fault)

    for k, item in enumerate(items):
        css = item["state"] == "css"
        item["ord"] = k
        item["text"], item["error"] = read(f"/data/{item['internal']}" + ("" if css else "/content"), html, css) if item["state"] in ("spine", "css") else (None, None)
    found, fault = read("/meta", meta)
    return {"entries": entries, "items": items, "meta": found, "meta_error": fault, "error": None}


def containers(df: DataFrame, content: str = "content", html: Tags | None = None, meta: Tags | None = None) -> DataFrame:
    """df with ``lit``: entries, items, meta, meta_error, error. Null gives nulls; what isn't a readable, unprotected book gives an
    error; an item that can't be read has an error of its own."""

    @arrow_function(BOOK)
    def opened(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_open(None if c is None else bytes(c), html, meta) for c in found], columns=["entries", "items", "meta", "meta_error", "error"])

    return df.withColumn("lit", opened(F.col(content)))


def _named(pattern: str, text: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, f"(?i)<{pattern}[^>]*>([^<]+)</{pattern}>", 1), F.lit("")), other)


def books(df: DataFrame, key: str, name: str = "name", content: str = "content", html: Tags | None = None, meta: Tags | None = None) -> DataFrame:
    """(key, title, author, html, toc array of (id, label, level), error): spine items in order, their first headings, style
    sheets; the stem of the name where the book has no title."""
    rows = containers(df, content, html, meta).withColumn("_stem", F.regexp_replace(name, r"(?i)\.lit$", ""))
    spine = F.filter("lit.items", lambda i: (i["state"] == "spine") & i["text"].isNotNull())
    heading = r"(?i)<h([1-6])[^>]*>([^<]+)</h\1>"
    entries = F.filter(F.transform(spine, lambda i: F.struct(F.regexp_extract(i["text"], heading, 2).alias("label"), F.regexp_extract(i["text"], heading, 1).alias("level"))), lambda e: e["level"] != "")
    toc = F.transform(entries, lambda e, n: F.struct(F.concat(F.lit("lit-"), n.cast("string")).alias("id"), trim(e["label"]).alias("label"), e["level"].cast("int").alias("level")))
    body = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), F.when(F.regexp_like(t, F.lit(r"(?is)<body[^>]*></body>")), "").otherwise(t))
    css = F.transform(F.filter("lit.items", lambda i: (i["state"] == "css") & i["text"].isNotNull()), lambda i: i["text"])
    rows = rows.withColumns({"_title": _named("dc:Title", F.col("lit.meta"), F.col("_stem")), "_author": _named("dc:Creator", F.col("lit.meta"), F.lit(NO_AUTHOR))})
    head = F.array(F.lit("<html><head>"), F.when(F.col("_title") != "", F.concat(F.lit("<title>"), F.replace("_title", F.lit("<"), F.lit("&lt;")), F.lit("</title>"))).otherwise(""), F.when(F.size(css) > 0, F.concat(F.lit("<style>"), F.array_join(css, "\n"), F.lit("</style>"))).otherwise(""), F.lit("</head><body>"))
    whole = F.array_join(F.concat(head, F.transform(spine, lambda i: body(i["text"])), F.array(F.lit("</body></html>"))), "\n")
    good = F.col("lit.items").isNotNull()
    of = lambda c: F.when(good, c)
    return rows.select(key, of(F.col("_title")).alias("title"), of(F.col("_author")).alias("author"), of(whole).alias("html"), of(toc).alias("toc"), F.coalesce("lit.error", "lit.meta_error").alias("error"))
