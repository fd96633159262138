"""Pages of comics: landscape PNG pages are cut into halves. Pixels are read and written here, with zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import arrow_function

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type: grey, RGB, palette, grey and alpha, RGBA.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: A page may have so many bytes of pixels.
MOST = 1 << 28


def chunks(png: bytes):
    at = len(MAGIC)
    while at + 8 <= len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        yield kind, png[at + 8 : at + 8 + size]
        at += size + 12


def pixels(png: bytes) -> tuple[np.ndarray, int, list[tuple[bytes, bytes]]]:
    """(rows x width x bytes of a pixel, colour type, palette chunks) of an 8-bit PNG without interlacing."""
    if not png.startswith(MAGIC):
        raise ValueError("no PNG")
    found = list(chunks(png))
    head = next((d for k, d in found if k == b"IHDR"), b"")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in SAMPLES or not width or not height or width * height * SAMPLES[colour] > MOST:
        raise ValueError(f"not supported: {width} x {height}, {depth} bits, colour {colour}, interlaced {interlaced}")
    n = SAMPLES[colour]
    inflater = zlib.decompressobj()
    raw = inflater.decompress(b"".join(d for k, d in found if k == b"IDAT"), height * (width * n + 1))
    if len(raw) != height * (width * n + 1):
        raise ValueError("pixels are missing")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * n + 1)
    out, above = np.zeros((height, width * n), np.uint8), np.zeros(width * n, np.uint8)
    for y, line in enumerate(lines):
        above = out[y] = _unfiltered(int(line[0]), line[1:], above, n)
    return out.reshape(height, width, n), colour, [(k, d) for k, d in found if k in (b"PLTE", b"tRNS")]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), 0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"filter {kind}")
    out = [0] * n + line.tolist()
    up = [0] * n + above.tolist()
    for i in range(n, len(out)):
        a, b, c = out[i - n], up[i], up[i - n]
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[n:], np.uint8)


def png(rows: np.ndarray, colour: int, palette: list[tuple[bytes, bytes]] = ()) -> bytes:
    """A PNG of 8-bit rows x width x samples."""
    height, width, _ = rows.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows.reshape(height, -1)], 1).tobytes()
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)), *palette, (b"IDAT", zlib.compress(raw)), (b"IEND", b"")]
    return MAGIC + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def halves(content: bytes, right_to_left: bool) -> list[bytes]:
    """The two halves of a landscape page in reading order; none of other pages."""
    rows, colour, palette = pixels(content)
    width = rows.shape[1]
    if width <= rows.shape[0]:
        return []
    parts = [rows[:, : width // 2], rows[:, width // 2 :]]
    return [png(p, colour, palette) for p in (reversed(parts) if right_to_left else parts)]


@arrow_function("parts array<binary>, error string")
def _halves(content: pd.Series, right_to_left: pd.Series) -> pd.DataFrame:
    def one(c, rtl):
        if c is None:
            return [], None
        try:
            return halves(bytes(c), bool(rtl)), None
        except (ValueError, struct.error, zlib.error) as fault:
            return [], f"{type(fault).__name__}: {fault}"

    return pd.DataFrame([one(c, r) for c, r in zip(content, right_to_left, strict=True)], columns=["parts", "error"])


def pages(df: DataFrame, book: str, right_to_left: Column | None = None, split: bool = True, index: str = "index", name: str = "name", content: str = "content") -> DataFrame:
    """(book, ord, index, name, content, error): the pages of each book in the order of their index, landscape ones as two.

    ``ord`` counts the pages that come out. ``index`` is that of the page, but of halves their place, so that two pages
    may share one. A page that can't be read stays whole and says why; without ``split`` all stay whole. Null contents stay; of pages
    with one index the name decides the order.
    """
    rtl = F.lit(False) if right_to_left is None else right_to_left
    rows = df.select(book, F.col(index).cast("int").alias("index"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"), rtl.alias("_rtl"))
    rows = rows.withColumn("_h", _halves("content", "_rtl") if split else F.struct(F.array().cast("array<binary>").alias("parts"), F.lit(None).cast("string").alias("error")))
    before = Window.partitionBy(book).orderBy("index", "name").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum(F.greatest(F.size("_h.parts"), F.lit(1))).over(before), F.lit(0)).cast("int"))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    part = lambda p, i: F.struct((F.col("_first") + i).alias("ord"), (F.col("_first") + i).alias("index"), F.concat(stem, F.lit("_"), (i + 1).cast("string"), F.lit(".png")).alias("name"), p.alias("content"))
    whole = F.array(F.struct(F.col("_first").alias("ord"), "index", "name", "content"))
    out = rows.select(book, F.explode(F.when(F.size("_h.parts") > 0, F.transform("_h.parts", part)).otherwise(whole)).alias("_p"), F.col("_h.error").alias("error"))
    return out.select(book, "_p.ord", "_p.index", "_p.name", "_p.content", "error")
