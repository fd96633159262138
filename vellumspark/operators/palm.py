"""Palm databases (PalmDoc and zTXT) and TCR files.

The header and record directory are relational (substrings, lead); only the bytes of a record are decoded in Arrow
functions, each record on its own, so that a large file spreads over tasks.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import arrow_function, trim


def number(content: Column, at: int | Column, n: int) -> Column:
    """Big-endian unsigned number of n bytes at a 0-based place."""
    place = at + 1 if isinstance(at, int) else at + F.lit(1)
    return F.conv(F.hex(F.substring(content, place, n) if isinstance(place, int) else content.substr(place, F.lit(n))), 16, 10).cast("long")


def headers(df: DataFrame, content: str = "content") -> DataFrame:
    """df with title, identity and n_records of each database."""
    raw = F.col(content)
    latin = lambda a, n: F.decode(F.substring(raw, a + 1, n), "iso-8859-1")
    return df.withColumns({"title": F.trim(F.translate(latin(0, 32), "\0", "")), "identity": latin(60, 8), "n_records": number(raw, 76, 2).cast("int")})


def _directory(content: Column) -> Column:
    """Array (idx, start, next_start) from the directory of a database: a record ends where the next begins, the last at the end."""
    n = F.coalesce(number(content, 76, 2).cast("int"), F.lit(0))
    start = lambda i: number(content, F.lit(78) + 8 * i, 4)
    entry = lambda i: F.struct(i.alias("idx"), start(i).alias("start"), F.when(i == n - 1, F.length(content).cast("long")).otherwise(start(i + 1)).alias("next_start"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), entry)).otherwise(F.array().cast("array<struct<idx:int,start:bigint,next_start:bigint>>"))


def _sliced(content: Column, entry: Column) -> Column:
    length = F.greatest(entry["next_start"] - entry["start"], F.lit(0)).cast("int")
    return content.substr((entry["start"] + 1).cast("int"), length)


def records(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, identity, n_records, idx, start, next_start, bytes) of every record. They are cut within their row, so no
    shuffle carries a file."""
    raw = F.col(content)
    rows = headers(df, content).select(key, "identity", "n_records", F.transform(_directory(raw), lambda e: e.withField("bytes", _sliced(raw, e))).alias("_r"))
    return rows.select(key, "identity", "n_records", F.inline("_r"))


def unpack(data: bytes) -> bytes:
    """PalmDoc compression. Bytes beyond the end count as nought, and so does what a distance before the start names."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif c >= 0x80:
            pair = c << 8 | (data[i] if i < len(data) else 0)
            i += 1
            distance = (pair & 0x3FFF) >> 3
            for _ in range((pair & 7) + 3):
                out.append(out[-distance] if 0 < distance <= len(out) else 0)
        elif 1 <= c <= 8:
            out += data[i : i + c].ljust(c, b"\0")
            i += c
        else:
            out.append(c)
    return bytes(out)


def expand_tcr(data: bytes) -> bytes | None:
    """TCR: a dictionary of 256 entries, then one entry for each byte; None without the magic, empty if cut short."""
    if not data.startswith(b"!!8-Bit!!"):
        return None
    entries, at = [], 9
    for _ in range(256):
        if at >= len(data):
            return b""
        entries.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(map(entries.__getitem__, data[at:]))


def latin(data: bytes) -> str:
    """windows-1252 as the web has it: the five free bytes are their code points."""
    try:
        return data.decode("cp1252")
    except UnicodeDecodeError:
        return "".join(bytes((b,)).decode("cp1252", "ignore") or chr(b) for b in data)


@arrow_function("string")
def _joined_text(data: pd.Series, how: pd.Series) -> pd.Series:
    """The texts of a database's records in a row; each record is decoded on its own."""

    def one(raw: bytes, form: str) -> str:
        if form == "palmdoc":
            raw = unpack(raw)
        elif form == "zlib":
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                pass  # a record that can't be inflated stays as it is
        return latin(raw)

    return pd.Series([None if parts is None or form is None else "".join(one(bytes(p), form) for p in parts) for parts, form in zip(data, how, strict=True)], dtype=object)


@arrow_function("string")
def tcr_text(content: pd.Series) -> pd.Series:
    """Text of TCR bytes; null if they aren't TCR."""
    return pd.Series([None if c is None or (t := expand_tcr(bytes(c))) is None else latin(t) for c in content])


# Identities, and texts.
EREADER = ("PNRdPPrs", "PNPdPPrs")
UNKNOWN = "Nem támogatott PDB formátum: {}. Támogatott: TEXtREAd (PalmDoc), PNRdPPrs/PNPdPPrs (eReader), zTXTGPlm (zTXT)"
NOT_TCR = "Invalid TCR header: missing !!8-Bit!! magic"


def books(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, title, author, html, error) of every row but eReader's. PalmDoc and zTXT databases have a book even without
    text records; others are read as PalmDoc records, and if that gives no text, or the content is null or too short, the row has an ``error``.
    Only compression 2 (or a header too short to say) is unpacked; any other is taken as it is."""
    raw = F.col(content)
    kind = F.when(F.col("identity").startswith("TEXT") | (F.col("identity") == "TEXtREAd"), "palmdoc").when(F.col("identity") == "zTXTGPlm", "zlib").otherwise("other")
    rows = headers(df, content).where(~F.coalesce(F.col("identity"), F.lit("")).isin(*EREADER)).withColumn("_kind", kind).withColumn("_d", _directory(raw))
    r0 = F.when(F.size("_d") > 0, _sliced(raw, F.col("_d")[0]))
    rows = rows.withColumns({"_packed": F.when(F.length(r0) >= 2, number(r0, 0, 2)).otherwise(2), "_count": F.when(F.length(r0) >= 10, number(r0, 8, 2)), "_rest": F.size("_d") - 1})
    count = F.when(F.col("_kind") == "palmdoc", F.least(F.coalesce("_count", "_rest"), F.col("_rest"))).otherwise(F.col("_rest")).cast("int")
    form = F.when(F.col("_kind") == "zlib", "zlib").when((F.col("_kind") == "palmdoc") & (F.col("_packed") != 2), "raw").otherwise("palmdoc")
    parts = F.transform(F.slice("_d", 2, F.greatest(count, F.lit(0))), lambda e: _sliced(raw, e))
    rows = rows.select(key, "title", "identity", "_kind", _joined_text(F.when(F.col("identity").isNotNull(), parts), form).alias("_text"))
    safe = F.replace(F.replace(F.replace("_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    fits = F.coalesce((F.col("_kind") != "other") | (trim("_text") != ""), F.lit(False))
    html = F.when(fits, F.concat(F.lit("<html><body><pre>"), safe, F.lit("</pre></body></html>")))
    before, after = UNKNOWN.split("{}")
    return rows.select(key, F.when(fits, F.col("title")).alias("title"), F.when(fits, F.lit("")).alias("author"), html.alias("html"), F.when(~fits, F.concat(F.lit(before), F.coalesce("identity", F.lit("")), F.lit(after))).alias("error"))


def texts(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, html) of the books of ``books`` that have text."""
    return books(df, key, content).where("error is null").select(key, "html")


def tcr_books(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, text, error) of TCR files: without the magic (or null) text is null and error says so."""
    text = tcr_text(content)
    return df.select(key, text.alias("text")).select(key, "text", F.when(F.col("text").isNull(), F.lit(NOT_TCR)).alias("error"))
