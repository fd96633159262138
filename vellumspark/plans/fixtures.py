"""Containers written from ``documents``, so that queries can read them back. Deterministic and without a shuffle."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.operators import comic


def tcr(text: bytes) -> bytes:
    return b"!!8-Bit!!" + b"\0" + b"".join(bytes((1, i)) for i in range(1, 256)) + text


def pdb(identity: bytes, records: list[bytes], title: bytes = b"book") -> bytes:
    at, index = 78 + 8 * len(records), b""
    for r in records:
        index += struct.pack(">II", at, 0)
        at += len(r)
    return title.ljust(32, b"\0") + bytes(28) + identity + bytes(8) + struct.pack(">H", len(records)) + index + b"".join(records)


def pack(data: bytes) -> bytes:
    """PalmDoc compression by literals, space pairs and back references."""
    out, i, seen = bytearray(), 0, {}
    while i < len(data):
        at, n = seen.get(data[i : i + 3], -1), 0
        if at >= 0 and i - at <= 2047 and i + 3 <= len(data):
            n = 3
            while n < 10 and i + n < len(data) and at + n < i and data[at + n] == data[i + n]:
                n += 1
        for k in range(i, i + max(n, 1)):
            seen[data[k : k + 3]] = k
        if n and i - at >= n:
            out += struct.pack(">H", 0x8000 | (i - at) << 3 | n - 3)
            i += n
        elif data[i] == 0x20 and i + 1 < len(data) and 0x40 <= data[i + 1] <= 0x7F:
            out.append(data[i + 1] ^ 0x80)
            i += 2
        elif data[i] == 0 or 9 <= data[i] <= 0x7F:
            out.append(data[i])
            i += 1
        else:
            run = data[i : i + 8]
            out += bytes((len(run),)) + run
            i += len(run)
    return bytes(out)


def _cut(raw: bytes) -> list[bytes]:
    return [raw[i : i + 4096] for i in range(0, len(raw), 4096)] or [b""]


def container(kind: str, text: Column) -> Column:
    """Bytes of a container of the kind that holds the text in windows-1252."""

    def one(t: str) -> bytes:
        raw = t.encode("cp1252")
        if kind == "tcr":
            return tcr(raw)
        parts = _cut(raw)
        head = struct.pack(">HHIHHI", 2 if kind == "palmdoc" else 1, 0, len(raw), len(parts), 4096, 0)
        body = [pack(p) if kind == "palmdoc" else zlib.compress(p) if kind == "ztxt" else p for p in parts]
        return pdb(b"zTXTGPlm" if kind == "ztxt" else b"TEXtREAd", [head, *body])

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(t) for t in texts])

    return made.asNondeterministic()(text)


def fiction_book(doc_id: Column, text: Column) -> Column:
    """XML with the text in one section, which two of three documents title, and a second section inside it."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    label = F.when(doc_id % 3 == 0, "").otherwise(F.concat(F.lit("<title><p>Part "), doc_id, F.lit("</p></title>")))
    inner = F.concat(F.lit("<section><title><p>Notes</p></title><subtitle>"), doc_id, F.lit("</subtitle><p><emphasis>end</emphasis></p></section>"))
    return F.concat(F.lit("<FictionBook><body><section>"), label, F.lit("<p>"), safe, F.lit("</p>"), inner, F.lit("</section></body></FictionBook>"))


def style_sheet(doc_id: Column) -> Column:
    """styles.xml with doc_id % 5 + 1 styles, each based on the one before it; the first is based on the last where doc_id % 7 is 0
    (a cycle), and on an unknown one where it is 1. Which properties a style has follows from its number."""
    sid = lambda i: F.concat(F.lit("s"), i.cast("string"))
    last = (doc_id % 5).cast("int")

    def style(i: Column) -> Column:
        base = F.when(i > 0, sid(i - 1)).when(doc_id % 7 == 0, sid(last)).when(doc_id % 7 == 1, "missing")
        k = doc_id + i
        bold = F.when(k % 3 == 0, '<w:b w:val="0"/>').when(k % 3 == 1, "<w:b/>").otherwise("")
        size = F.when(k % 4 == 0, F.concat(F.lit('<w:sz w:val="'), (k % 40).cast("string"), F.lit('"/>'))).otherwise("")
        spacing = F.when(k % 5 == 0, F.concat(F.lit('<w:spacing w:line="'), (k % 100).cast("string"), F.lit('"/>'))).when(k % 5 == 1, '<w:spacing w:before="6"/>').otherwise("")
        jc = F.when(i % 2 == 1, F.concat(F.lit('<w:jc w:val="j'), i.cast("string"), F.lit('"/>'))).otherwise("")
        return F.concat(
            F.lit('<w:style w:type="'), F.when(i % 2 == 0, "paragraph").otherwise("character"), F.lit('" w:styleId="'), sid(i), F.lit('">'),
            F.when(base.isNotNull(), F.concat(F.lit('<w:basedOn w:val="'), base, F.lit('"/>'))).otherwise(""),
            F.lit("<w:pPr>"), spacing, jc, F.lit("</w:pPr><w:rPr>"), bold, size, F.lit("</w:rPr></w:style>"),
        )

    body = F.array_join(F.transform(F.sequence(F.lit(0), last), style), "")
    return F.concat(F.lit('<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'), body, F.lit("</w:styles>"))


def grey_png(doc_id: Column) -> Column:
    """A grey picture of doc_id % 30 + 1 by doc_id % 12 + 1 whose row r has the letters of md5(doc_id-r) as its pixels."""

    @F.pandas_udf("binary")
    def made(ids: pd.Series) -> pd.Series:
        def one(i: int) -> bytes:
            rows = [np.frombuffer(hashlib.md5(f"{i}-{r}".encode()).hexdigest()[: i % 30 + 1].encode(), np.uint8) for r in range(i % 12 + 1)]
            return comic.png(np.stack(rows)[:, :, None], 0)

        return pd.Series([None if i is None else one(int(i)) for i in ids], dtype=object)

    return made.asNondeterministic()(doc_id)


def letters_of(png: Column) -> Column:
    """The rows of such a picture as text, a slash between them."""

    @F.pandas_udf("string")
    def read(found: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else "/".join(r.tobytes().decode() for r in comic.pixels(bytes(c))[0]) for c in found], dtype=object)

    return read(png)


def ereader(doc_id: Column) -> Column:
    """An eReader database with two text pages, a chapter, and a record of title and author."""

    @F.pandas_udf("binary")
    def made(ids: pd.Series) -> pd.Series:
        def one(i: int) -> bytes:
            r0 = bytearray(132)
            for at, v in ((0, 2), (12, 3), (14, 1), (24, 1), (32, 3), (40, 4), (44, 4)):
                r0[at : at + 2] = struct.pack(">H", v)
            return pdb(b"PNRdPPrs", [bytes(r0), pack(f'\\C0="One"{i}\n'.encode()), pack(b"\\Bend\\b"), b"\0\0\0\1One\0", f"Title {i}\0Author {i}\0".encode()])

        return pd.Series([None if i is None else one(int(i)) for i in ids], dtype=object)

    return made.asNondeterministic()(doc_id)
